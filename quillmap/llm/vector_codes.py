"""Compression of vectors to product codes: annular norm pruning.

Components become integers, floor(1024 x); a vector is cut into four equal parts, each with a codebook of 256 entries.
The codebooks start with the vectors of the smallest ids and are refined by four rounds (assign every part to its nearest
entry, replace each entry by the floor of the mean of its parts); a last assignment gives the codes. All of it is integer
arithmetic, so results depend on neither order nor partitions.

Method. The entries of a codebook are sorted by norm. A part's first distances are those to the entries whose norms are
next to its own; by the triangle inequality an entry that is at least as near has a norm within that distance of the
part's norm, so a binary search gives the annulus, its bounds inclusive (an entry on them may tie and have the lower
index), and only the annulus is evaluated, exactly. Parts are taken in the order of their norms, so that the annuli of
neighbours overlap and one matrix product serves `TOGETHER` of them.

Distribution. The integers are written once. Each round is one pass without a shuffle of vectors: a task sums its parts by
entry and returns at most 4 x 256 rows, which are added up by (part, entry); the driver gets 4 x 256 rows, and the
codebooks (256 vectors) travel with the tasks.

Defined results: rows whose vector is null or has a null or non-finite component are dropped. Null ids count as the
largest, equal ids are ordered by vector. With fewer than 256 vectors there are as many entries as vectors. Shorter
vectors, and those whose length is no multiple of four, are filled up with zeros; empty vectors have no distance. Components
whose distances would not fit 64 bits saturate (for 64 components beyond 180,000). No rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries next to a part's norm that give its first distance, and parts that share a matrix product.
FIRST, TOGETHER = 8, 128
#: Labels up to which their sums are broadcast.
BROADCAST_LABELS = 100_000


class Codebook:
    """Entries of one part, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        squared = np.einsum("ij,ij->i", entries, entries)
        self.index = np.argsort(squared, kind="stable")
        self.entries, self.squared = entries[self.index], squared[self.index]
        self.norms = np.sqrt(self.squared.astype(float))
        self.largest = int(np.abs(entries).max(initial=0))
        self.evaluated = 0  # distances so far

    def _products(self, rows: np.ndarray, begin: int, end: int) -> np.ndarray:
        entries = self.entries[begin:end]
        # sums of products below 2^53 are whole in floating point, which is much the faster product
        if self.largest * int(np.abs(rows).max(initial=0)) * max(1, rows.shape[1]) < 2**53:
            return (rows.astype(float) @ entries.T.astype(float)).astype(np.int64)
        return rows @ entries.T

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row; the lower index of equally near ones."""
        squared = np.einsum("ij,ij->i", rows, rows)
        order = np.argsort(squared, kind="stable")
        index, error = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        size = len(self.norms)
        for at in range(0, len(rows), TOGETHER):
            some = order[at : at + TOGETHER]
            part, own = rows[some], squared[some]
            norms = np.sqrt(own.astype(float))
            place = np.searchsorted(self.norms, norms)
            begin, end = max(0, int(place.min()) - FIRST // 2), min(size, int(place.max()) + FIRST // 2)
            first = (own[:, None] - 2 * self._products(part, begin, end) + self.squared[None, begin:end]).min(axis=1)
            # a margin for the rounding of roots keeps the bounds inclusive
            reach = np.sqrt(first.astype(float)) * (1 + 1e-12) + 1e-6 + norms * 1e-12
            low, high = np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")
            begin, end = int(low.min()), int(high.max())
            far = own[:, None] - 2 * self._products(part, begin, end) + self.squared[None, begin:end]
            places = np.arange(begin, end)
            inside = (places >= low[:, None]) & (places < high[:, None])
            self.evaluated += int(inside.sum())
            far = np.where(inside, far, np.iinfo(np.int64).max)
            best = far.min(axis=1)
            error[some] = best
            index[some] = np.where(far == best[:, None], self.index[begin:end], size).min(axis=1)
        return index, error


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows of dim integers, filled up with zeros, saturated so that distances fit 64 bits."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    most = math.isqrt(2**61 // max(1, dim))
    flat = np.clip(flat, -most, most)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


def whole_vectors(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """df with `_q`, the integers of the vector, without the rows whose vector has none."""
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(vector.isNotNull() & finite).withColumn("_q", F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def _means(table: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The codebooks after one round over table(_q)."""
    width = dim // PARTS
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [Codebook(b) for b in books]
        sums = [np.zeros_like(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            rows = _matrix(batch.column(0), dim)
            for p in range(PARTS):
                part = np.ascontiguousarray(rows[:, p * width : (p + 1) * width])
                index, _ = coded[p].nearest(part)
                np.add.at(sums[p], index, part)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
        out = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(PARTS) for e in np.flatnonzero(counts[p])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["part", "entry", "n", "sums"])

    each = table.select("_q").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    new = [b.copy() for b in books]
    for row in totals.collect():  # at most 4 x 256
        new[row["part"]][row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return new


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The vectors' codes (id, label, code, error) as a table, and the codebooks, an array of entries per part.

    code: two hex digits per part. error: squared distances, summed over the parts.
    """
    named = lambda c: F.col(f"`{c}`")
    slim = df.select(named(id_col).alias("_id"), named(label_col).alias("_label"), named(vector_col).alias("_vector"))
    table = written(whole_vectors(slim, "_vector").drop("_vector"), "vectors")
    longest = table.agg(F.max(F.size("_q"))).first()[0] or 0
    dim = -(-longest // PARTS) * PARTS
    width = dim // PARTS
    firsts = [r["_q"] for r in table.orderBy(F.col("_id").asc_nulls_last(), "_q").limit(ENTRIES).select("_q").collect()]
    start = _matrix(pa.array(firsts, pa.list_(pa.int64())), dim)
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(PARTS)]
    for _ in range(rounds if len(start) else 0):
        books = _means(table, books, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [Codebook(b) for b in books]
        for batch in batches:
            rows = _matrix(batch.column(2), dim)
            found = [coded[p].nearest(np.ascontiguousarray(rows[:, p * width : (p + 1) * width])) for p in range(PARTS)]
            bytes_ = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            codes = pa.array([row.tobytes().hex() for row in bytes_], pa.string())
            errors = pa.array(sum(error for _, error in found), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, errors], names=["_id", "_label", "code", "error"])

    kinds = dict(table.dtypes)
    coded = table.select("_id", "_label", "_q").mapInArrow(run, f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long")
    return written(coded, "codes").select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), "code", "error"), books


def label_errors(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """codes with label_error, the error of all rows of the same label; null is a label."""
    label = F.col(f"`{label_col}`")
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = written(codes.groupBy(label.alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")), "labels")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return codes.join(sums, label.eqNullSafe(F.col("_label"))).drop("_label")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def op12(spark, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    parts = [
        """k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "p AS MATERIALIZED (SELECT vec_id, label, j, v[j * (len(v) // 4) + 1 : (j + 1) * (len(v) // 4)] AS x FROM k, range(4) t(j))",
        "f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k)",
        "c0 AS MATERIALIZED (SELECT j, e, x FROM p JOIN f USING (vec_id) WHERE e < 256)",
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, label, p.j, any_value(p.x) AS x, min({{'d': list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x), 'e': e}}) AS m"
            f" FROM p JOIN c{r} c ON p.j = c.j GROUP BY vec_id, label, p.j)"
        )
        if r < ROUNDS:
            parts.append(
                f"u{r} AS (SELECT j, e, list(m ORDER BY i) AS x FROM (SELECT j, m.e AS e, i, floor(sum(x[i]) / count(*)) AS m FROM a{r}, range(1, (SELECT max(len(x)) + 1 FROM p)) t(i) GROUP BY ALL) GROUP BY ALL)"
            )
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, c.e, coalesce(u.x, c.x) AS x FROM c{r} c LEFT JOIN u{r} u ON u.j = c.j AND u.e = c.e)")
    return "WITH " + ",\n".join(parts) + f""",
b AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY j) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(list_aggregate(list_transform(x, lambda y: y::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY j, e)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM b, h"""


SQL = _sql()
