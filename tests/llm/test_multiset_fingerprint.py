"""Multiset fingerprints against a plain version, and what sums allow: any order, insertion, deletion."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmap.llm import multiset_fingerprint as P

SCHEMA = "doc_id long, text string, fingerprint string, n_chars string, edited string"


def plain(text):
    """The components of a text's fingerprint."""
    lanes, buckets = [0] * 16, [0] * 256
    for para in (text or "").split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", para)
        if not words:
            continue
        digest = hashlib.sha256(("0" + para).encode()).hexdigest() + hashlib.sha256(("1" + para).encode()).hexdigest()
        lanes = [(x + int(digest[8 * i : 8 * i + 8], 16)) % 2**32 for i, x in enumerate(lanes)]
        for i in range(len(words)):
            code = int(hashlib.md5(" ".join(words[max(0, i - 2) : i + 1]).encode()).hexdigest()[:3], 16) % 512
            buckets[code // 2] += 1 - 2 * (code % 2)
    return lanes, buckets


def digits(v):
    return "".join(f"{x % 2**32:08x}" for x in v[0] + v[1])


def alike(a, b):
    size = sum(x * x for x in a[1] + b[1])
    return 1.0 if a == b else max(0.0, 1 - sum((x - y) ** 2 for x, y in zip(a[1], b[1])) / size) if size else 0.0


def texts(rng, n):
    words = ["alpha", "beta", "é", "gamma\t", "x" * 50, "delta", "中文", "q"]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(0, 12)))
    return [rng.choice([None, "", "\n \n", "one", "\n".join(line() for _ in range(rng.randint(1, 9))), "\n".join(line() for _ in range(rng.randint(1, 9)))]) for _ in range(n)]


@pytest.mark.parametrize("n,blocks", [(1, 4), (2, 4), (150, 1), (150, 40)])
def test_against_plain(spark, tmp_path, monkeypatch, n, blocks):
    rng = random.Random(n + blocks)
    ids = rng.sample(range(-500, 500), n)
    rows = [(i, t, "f", "n", "e") for i, t in zip(ids, texts(rng, n))]
    if n > 2:
        rows += [(max(ids) + 1, "a b c\n" * 3000, "f", "n", "e"), (-(2**63), "low", "f", "n", "e"), (2**63 - 1, "high é", "f", "n", "e")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    whole = P.edited_halves
    monkeypatch.setattr(P, "edited_halves", lambda df: whole(df, blocks=blocks))
    got = {r["doc_id"]: r for r in P.op11(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new, next_ = plain(text), plain(edited), plain(after)
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(own), digits(new), alike(own, new), alike(own, next_))
        assert tuple(got[i])[1:] == want, (i, text, edited)


def test_null_and_repeated_rows(spark):
    rows = [(None, "z", "", "", ""), (None, None, "", "", "")] + [(5, "same text here", "", "", "")] * 3 + [(5, "other", "", "", ""), (9, None, "", "", "")]
    for blocks in (1, 30):
        out = P.edited_halves(spark.createDataFrame(rows, SCHEMA).repartition(2), blocks=blocks).collect()
        assert len(out) == len(rows) and all(r["_next"] is not None for r in out)
        same = [r for r in out if r["n_chars"] == 14]
        assert sum(r["_own"] == r["_next"] for r in same) == 2  # of three copies two are followed by a copy
    assert P.edited_halves(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sums(spark):
    texts = {
        "a": "first one\nsecond two", "b": "third three words here\n", "c": "second two",
        "turned": "third three words here\nsecond two\n\nfirst one", "rest": "first one", "twice": "first one\nfirst one",
    }
    v = {k: F.col(k) for k in texts}
    r = P.with_vectors(spark.range(1), {k: F.lit(t) for k, t in texts.items()}).select(
        P.fingerprint(P.add(v["a"], v["b"])).alias("joined"), P.fingerprint(v["turned"]).alias("other_order"),
        P.fingerprint(P.subtract(v["a"], v["c"])).alias("less"), P.fingerprint(v["rest"]).alias("rest"), P.fingerprint(v["twice"]).alias("twice"),
        P.likeness(v["a"], v["a"]).alias("same"), P.likeness(v["a"], v["c"]).alias("half"),
    ).first()
    assert r["joined"] == r["other_order"] and r["less"] == r["rest"] != r["twice"] and r["same"] == 1.0
    assert 0.5 < r["half"] < 0.9
