"""Containment, overlap and prefix joins against plain loops, and their plans."""

import random

from pyspark.sql import functions as F

from quillmap.operators import joins as J


def nested(df):
    return any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoop", "Cartesian"))


def test_automaton():
    rng = random.Random(1)
    for _ in range(500):
        words = ["".join(rng.choices("abé", k=rng.randint(0, 5))) for _ in range(rng.randint(1, 12))]
        text = "".join(rng.choices("abé", k=rng.randint(0, 30)))
        assert J.Automaton(words).found(text) == {k for k, w in enumerate(words) if w in text}


def test_containing(spark):
    rng = random.Random(2)
    words = [(k, rng.choice([None, "", "abc", "".join(rng.choices("abcé ", k=rng.randint(2, 6)))])) for k in range(60)]
    texts = [(k, rng.choice([None, "", "abc" * 50, "".join(rng.choices("abcé ", k=rng.randint(0, 200)))])) for k in range(80)] + [(7, "abc")]
    a = spark.createDataFrame(texts, "text_id long, text string")
    b = spark.createDataFrame(words, "pattern_id long, pattern string")
    want = sorted((i, k) for i, t in texts for k, w in words if t is not None and w is not None and w in t)
    for shard, block in ((4_000_000, 64_000_000), (40, 1000)):
        assert sorted(map(tuple, J.containing(a, b, shard, block).collect())) == want
    assert J.containing(a, b.limit(0)).collect() == [] and J.containing(a.limit(0), b).collect() == []


def test_overlapping(spark):
    rng = random.Random(3)
    # points, empty, very long and negative intervals, and rows that repeat
    def rows(n):
        out = []
        for _ in range(n):
            start = rng.randint(-100, 1000)
            out.append((rng.choice(["k", "k", "l", None]), start, start + rng.choice([0, 1, 2, 7, 64, 65, 10**6]), rng.randint(0, 9)))
        return out

    x, y = rows(150), rows(150)
    schema = "key string, start long, end long, tag int"
    got = J.overlapping(spark.createDataFrame(x, schema), spark.createDataFrame(y, schema), ["key"])
    want = sorted((a[0], *a[1:], *b[1:]) for a in x for b in y if a[0] is not None and a[0] == b[0] and max(a[1], b[1]) < min(a[2], b[2]))
    assert sorted(map(tuple, got.select("key", "a_start", "a_end", "a_tag", "b_start", "b_end", "b_tag").collect())) == want
    assert not nested(got)
    points = spark.createDataFrame([(r[0], r[1]) for r in x], "key string, at long")
    held = J.covering(points, spark.createDataFrame(y, schema), ["key"]).collect()
    assert len(held) == sum(a[0] is not None and a[0] == b[0] and b[1] <= a[1] < b[2] for a in x for b in y)
    none = spark.createDataFrame([], schema)
    assert J.overlapping(none, none, ["key"]).collect() == []


def test_below(spark):
    rng = random.Random(4)
    part = lambda: "".join(rng.choices("ab", k=rng.randint(1, 2)))
    paths = list({(rng.choice(["h", "i"]), "/" + "/".join(part() for _ in range(rng.randint(0, 4))) + rng.choice(["", "/"])) for _ in range(200)})
    prefixes = list({(rng.choice(["h", "i"]), rng.choice(["", "/" + "/".join(part() for _ in range(rng.randint(1, 2)))])) for _ in range(25)})
    a, b = spark.createDataFrame(paths, "host string, path string"), spark.createDataFrame(prefixes, "host string, prefix string")
    for segments in (True, False):
        want = set()
        for h, p in paths:
            fits = [q for g, q in prefixes if g == h and (p.rstrip("/") == q.rstrip("/") or p.startswith(q.rstrip("/") + "/") if segments else p.startswith(q))]
            if fits:
                want.add((h, p, max(fits, key=len)))
        assert set(map(tuple, J.below(a, b, ["host"], segments).collect())) == want


def test_below_many_prefixes(spark):
    """100,000 prefixes: no nested loop, and each path finds its own."""
    prefixes = spark.range(100_000).select(F.lit("h").alias("host"), F.concat(F.lit("/p"), F.col("id")).alias("prefix"))
    paths = spark.range(0, 100_000, 10).select(F.lit("h").alias("host"), F.concat(F.lit("/p"), F.col("id"), F.lit("/page")).alias("path"))
    got = J.below(paths, prefixes, ["host"])
    assert not nested(got)
    assert got.filter(F.col("path") == F.concat("prefix", F.lit("/page"))).count() == 10_000 == got.count()
