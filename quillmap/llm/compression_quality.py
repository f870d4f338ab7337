"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A text is compressed with each; the
difference of the two sizes per byte of text says which it resembles, and a logistic curve turns it into a score. The
curve is fitted on labelled texts that the dictionaries have not seen, with the classes weighted as they are in the
labels.

Bounds. The dictionaries and the curve are fitted on the driver from at most `sample` texts of each class, each of at
most `sample_bytes` bytes (both documented limits of the fit alone); two dictionaries of `dictionary_bytes` go to the
executors. Every text is scored whole, in the scan, without a shuffle.

Learning reads only rows whose crc32(id as text) mod 5 is not 0. Labels, language, source and id are not inputs.

Defined results: null and empty texts have difference 0. Rows with a null label or id teach nothing. Without labels of
both classes every score is the share of good labels (1/2 without any). Ids may repeat. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL, SEED = 3000, 16 << 10, 64 << 10, 3, 5
FOLDS = 5


def fold(ident: Column) -> Column:
    return F.crc32(ident.cast("string").cast("binary")) % FOLDS


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    level: int = LEVEL

    def scorer(self):
        compressors = []
        for content in (self.good, self.bad):
            options = dict(level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False)
            if content:
                options["dict_data"] = held = zstandard.ZstdCompressionDict(content)
                held.precompute_compress(level=self.level)
            compressors.append(zstandard.ZstdCompressor(**options))
        good, bad = compressors

        def score(data: bytes) -> float:
            x = (len(bad.compress(data)) - len(good.compress(data))) / len(data) if data and self.slope else 0.0
            z = min(30.0, max(-30.0, self.offset + self.slope * x))
            return 1 / (1 + math.exp(-z))

        return score

    def difference(self, data: bytes) -> float:
        p = CompressionModel(self.good, self.bad, 1.0, 0.0, self.level).scorer()(data)
        return math.log(p / (1 - p))


def _dictionary(texts: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, texts)) // 2)), texts).as_bytes()
    except zstandard.ZstdError:  # too few or too even texts to train on
        return b""


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a little ridge on the (standardised) slope."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - np.array([1e-2, 1e-6]) * b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL,
) -> CompressionModel:
    """A model of the labelled rows outside fold 0, from at most `sample` rows of each class."""
    marks = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label"))
    marks = marks.filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & (fold(F.col("_id")) != 0))
    counts = {r["_label"]: r["n"] for r in marks.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("_id", F.lit(SEED))
    chosen = None
    for label in (0, 1):
        top = marks.filter(F.col("_label") == label).orderBy(order, "_id").limit(sample)
        chosen = top if chosen is None else chosen.unionByName(top)
    texts = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    texts = texts.filter(F.length("_text").between(1, sample_bytes))
    rows = texts.join(F.broadcast(chosen), "_id").orderBy(order, "_id", "_text").limit(2 * sample).collect()
    classes = {k: [bytes(r["_text"]) for r in rows if r["_label"] == k] for k in (0, 1)}
    total = sum(counts.values())
    if not all(len(v) >= 2 for v in classes.values()):
        share = min(0.999, max(0.001, counts.get(1, 0) / total)) if total else 0.5
        return CompressionModel(b"", b"", 0.0, math.log(share / (1 - share)), level)
    seen = {k: max(1, len(v) * 2 // 3) for k, v in classes.items()}
    model = CompressionModel(_dictionary(classes[1][: seen[1]], dictionary_bytes), _dictionary(classes[0][: seen[0]], dictionary_bytes), 1.0, 0.0, level)
    fresh = [(t, k) for k, v in classes.items() for t in v[seen[k] :]]
    x = np.array([model.difference(t) for t, _ in fresh])
    y = np.array([float(k) for _, k in fresh])
    weight = np.array([counts[k] / total / (len(classes[k]) - seen[k]) * len(fresh) for _, k in fresh])
    slope, offset = _logistic(x, y, weight)
    return CompressionModel(model.good, model.bad, slope, offset, level)


def score_texts(df: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 from `threshold` on) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = [score(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["doc_id", "score", "predicted"],
            )

    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, predicted int")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_texts(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
