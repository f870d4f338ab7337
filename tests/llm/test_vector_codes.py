"""Vector codes against a plain version in Python's integers, and the pruned search against a full one."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from quillmap.llm import vector_codes as V


def plain(rows, rounds=4):
    """rows: (vec_id, vector, label) -> (vec_id, code, error, label_error, digest)."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    kept = [(i, v + [0] * (dim - len(v)), label) for i, v, label in kept]
    cut = lambda v: [tuple(v[p * dim // 4 : (p + 1) * dim // 4]) for p in range(4)]
    firsts = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[cut(v)[p] for _, v, _ in firsts] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(4):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[best(p, cut(v)[p])[1]].append(cut(v)[p])
            for k, xs in members.items():
                new[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs))
        books = new
    out = [(i, [best(p, cut(v)[p]) for p in range(4)], label) for i, v, label in kept]
    totals = defaultdict(int)
    for _, found, label in out:
        totals[label] += sum(d for d, _ in found)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), totals[label], digest) for i, found, label in out]


@pytest.mark.parametrize("case", ["many", "few", "odd", "large"])
def test_against_plain(spark, tmp_path, case):
    rng = random.Random(case)
    vector = lambda n=8, s=1.0: [rng.gauss(0, s) for _ in range(n)]
    if case == "many":
        rows = [(i, vector(), rng.choice([1, 1, 1, 2, None])) for i in range(400)]
    elif case == "few":  # ties and repeated vectors, ids that repeat or are null
        some = [vector(), [0.0] * 8, [0.5] * 8]
        rows = [(rng.choice([i, 3, None]), rng.choice(some), rng.choice([1, None])) for i in range(40)]
    elif case == "odd":  # no rows that count, other lengths
        rows = [(1, None, 1), (2, [float("nan")] * 8, 1), (3, [1.0, None], 1), (4, [float("-inf")], 2), (5, [], None), (6, [0.25] * 7, 2), (7, vector(), 2)]
    else:  # products beyond 2^53
        rows = [(i, vector(8, 5e4), 1) for i in range(60)]
    df = spark.createDataFrame([(v, i, y, "x", "y") for i, v, y in rows], "embedding array<double>, vec_id long, label int, code string, error string")
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r) for r in V.op12(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert V.op12(spark, str(tmp_path)).collect() == []


def test_pruned_search():
    rng = np.random.default_rng(3)
    for spread in (1, 30, 4000):
        entries = rng.integers(-spread, spread + 1, (256, 16)) * rng.integers(1, 5, (256, 1))
        entries[200:] = entries[:56]  # ties
        rows = np.concatenate([rng.integers(-spread, spread + 1, (500, 16)) * rng.integers(0, 6, (500, 1)), entries])
        book = V.Codebook(entries)
        index, error = book.nearest(rows)
        far = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (error == far.min(axis=1)).all() and (index == far.argmin(axis=1)).all()
        assert book.evaluated < 0.9 * far.size  # the annulus is less than everything
