"""The two-level prefix scan against plain running figures."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillmap.operators.prefix_scan import numbered, prefix_scan


def test_against_plain(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["big"] * 6 + ["a", "b", None]), i, rng.choice([None, rng.randint(-50, 50)])) for i in range(700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(5)
    groups = defaultdict(list)
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        groups[k].append((at, v))
    for inclusive in (True, False):
        figures = {"n": ("count", "v"), "total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")}
        got = prefix_scan(df, ["k"], ["at"], figures, inclusive=inclusive, totals=True, block_bits=4).collect()
        assert len(got) == len(rows)
        by = {(r["k"], r["at"]): r for r in got}
        for k, items in groups.items():
            every = [v for _, v in items if v is not None]
            for i, (at, v) in enumerate(items):
                seen = [x for _, x in items[: i + inclusive] if x is not None]
                r = by[k, at]
                assert r["v"] == v and r["n"] == len(seen) and r["n_all"] == len(every)
                assert (r["total"], r["low"], r["high"]) == ((sum(seen), min(seen), max(seen)) if seen else (None, None, None))
                assert (r["total_all"], r["low_all"], r["high_all"]) == (sum(every), min(every), max(every))


def test_numbered_and_empty(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("x"))
    got = numbered(df, [], ["x"], "i").collect()
    assert all(r["i"] == r["x"] and r["i_all"] == 1000 for r in got) and len(got) == 1000
    assert numbered(df.limit(0), [], ["x"], "i").collect() == []
