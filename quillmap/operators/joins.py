"""Joins that are no equality on whole values, as equi-joins: texts that contain passages, intervals that overlap, paths
below prefixes.

Each takes tables of any size on both sides: nothing is collected but a total or a list of lengths, and no plan has a nested
loop. What is matched is the same as with `contains`, `a.start < b.end AND b.start < a.end` and `startswith`.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.session import cut


# ------------------------------------------------------------------------------------------------ containment
class Automaton:
    """Aho-Corasick: all patterns in one pass over a text, whatever their number.

    A state is a prefix of a pattern. `goto` has its next characters, `fail` the longest proper suffix that is a state as
    well, `output` the patterns that end there, and `longer` the next state on the way of failures that has any.
    """

    def __init__(self, patterns: list[str]):
        self.goto: list[dict[str, int]] = [{}]
        self.output: list[list[int]] = [[]]
        for k, pattern in enumerate(patterns):
            state = 0
            for c in pattern:
                nxt = self.goto[state].get(c)
                if nxt is None:
                    nxt = self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.output.append([])
                state = nxt
            self.output[state].append(k)
        self.fail, self.longer = [0] * len(self.goto), [0] * len(self.goto)
        queue = deque(self.goto[0].values())
        while queue:
            state = queue.popleft()
            for c, nxt in self.goto[state].items():
                at = self.fail[state]
                while at and c not in self.goto[at]:
                    at = self.fail[at]
                self.fail[nxt] = self.goto[at].get(c, 0)
                queue.append(nxt)
            back = self.fail[state]
            self.longer[state] = back if self.output[back] else self.longer[back]

    def found(self, text: str) -> set[int]:
        """The patterns that the text contains; the empty one is in every text."""
        goto, fail, output, longer = self.goto, self.fail, self.output, self.longer
        out, state, seen = set(output[0]), 0, {0}
        for c in text:
            while state and c not in goto[state]:
                state = fail[state]
            state = goto[state].get(c, 0)
            at = state if output[state] else longer[state]
            while at not in seen:  # what a state and its suffixes give is given once
                seen.add(at)
                out.update(output[at])
                at = longer[at]
        return out


def containing(texts: DataFrame, patterns: DataFrame, shard_chars: int = 4_000_000, block_chars: int = 64_000_000) -> DataFrame:
    """(text_id, pattern_id) of texts(text_id, text) that contain patterns(pattern_id, pattern).

    Patterns are dealt to shards of about `shard_chars` characters, whose automaton fits a task, and texts to blocks of
    about `block_chars`; each (shard, block) is one group, so an automaton is built once per block and every text passes
    each shard once. Equal patterns are one in the automaton. Null texts and patterns match nothing.
    """
    patterns, texts = patterns.filter("pattern is not null"), texts.filter("text is not null")
    distinct = patterns.groupBy("pattern").agg(F.lit(1)).select("pattern", F.xxhash64("pattern").alias("_hash"))
    sizes = distinct.agg(F.sum(F.length("pattern"))).crossJoin(texts.agg(F.sum(F.length("text").cast("long")))).first()
    shards, blocks = max(1, -(-(sizes[0] or 0) // shard_chars)), max(1, -(-(sizes[1] or 0) // block_chars))
    blocks = max(blocks, texts.sparkSession.sparkContext.defaultParallelism if (sizes[1] or 0) > 1_000_000 else 1)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = distinct.select(F.pmod("_hash", F.lit(shards)).cast("int").alias("_shard"), numbers(blocks).alias("_block"), "pattern")
    right = texts.select(F.pmod(F.xxhash64("text_id", "text"), F.lit(blocks)).cast("int").alias("_block"), numbers(shards).alias("_shard"), "text_id", "text")

    def one(some: pd.DataFrame, bodies: pd.DataFrame) -> pd.DataFrame:
        words = some["pattern"].tolist()
        automaton = Automaton(words)
        rows = [(i, words[k]) for i, text in zip(bodies["text_id"], bodies["text"]) for k in sorted(automaton.found(text))] if words else []
        return pd.DataFrame(rows, columns=["text_id", "pattern"])

    kind = dict(texts.dtypes)["text_id"]
    hits = left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block")).applyInPandas(one, f"text_id {kind}, pattern string")
    return hits.join(patterns, "pattern").select("text_id", "pattern_id")


# ------------------------------------------------------------------------------------------------ intervals
def _level(length: Column) -> Column:
    """The power of two that is at least the length."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)))).cast("int")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows of a and b, both with `keys`, `start` and `end` (exclusive), whose intervals share a point.

    Columns: the keys, a_<column> and b_<column>. An interval of level l (as long as 2^l at most) touches two bins of that
    level or of a higher one. It goes into its bins of every level from its own up to the highest that either side has; a
    pair meets at the higher of its two levels, in the bin where the later of the two starts lies, and only there. So no
    pair comes twice, and a long interval costs no more rows than a short one. Empty intervals and null keys match nothing.
    """

    def binned(df: DataFrame, side: str) -> DataFrame:
        rows = df.filter(F.col("end") > F.col("start")).withColumn("_own", _level(F.col("end") - F.col("start")))
        rows = rows.select(*[F.col(k) for k in keys], "_own", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys])
        return rows.withColumnRenamed("_own", f"_{side}_own")

    left, right = binned(a, "a"), binned(b, "b")
    most = left.agg(F.max("_a_own")).crossJoin(right.agg(F.max("_b_own"))).first()
    if most[0] is None or most[1] is None:
        top = 0
    else:
        top = max(most)

    def spread(df: DataFrame, side: str) -> DataFrame:
        levels = df.withColumn("_level", F.explode(F.sequence(F.col(f"_{side}_own"), F.lit(top))))
        first, last = F.expr(f"shiftright(cast({side}_start as bigint), _level)"), F.expr(f"shiftright(cast({side}_end as bigint) - 1, _level)")
        return levels.withColumn("_bin", F.explode(F.sequence(first, last)))

    pairs = spread(left, "a").join(spread(right, "b"), [*keys, "_level", "_bin"])
    meet = (F.col("_level") == F.greatest("_a_own", "_b_own")) & (F.col("_bin") == F.expr("shiftright(cast(greatest(a_start, b_start) as bigint), _level)"))
    return pairs.filter(meet & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))).drop("_level", "_bin", "_a_own", "_b_own")


def covering(points: DataFrame, intervals: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """Pairs of points and the intervals that hold them: a_<column> of the point, b_<column> of the interval."""
    return overlapping(points.withColumns({"start": F.col(at), "end": F.col(at) + 1}), intervals, keys).drop("a_start", "a_end")


# ------------------------------------------------------------------------------------------------ prefixes
def below(paths: DataFrame, prefixes: DataFrame, keys: list[str], segments: bool = True) -> DataFrame:
    """(keys, path, prefix): for each distinct path the longest of its keys' prefixes; no row where none fits.

    segments: a prefix ends where a segment of the path does (`/a` holds `/a/b`, not `/ab`); a slash at its end counts for
    nothing. Without, any leading part counts. A path is exploded to its own leading parts, whose number its length bounds
    (without segments only to the lengths that prefixes have), and these meet the prefixes by equality.
    """
    paths = paths.select(*keys, "path").filter("path is not null").distinct()
    prefixes = prefixes.select(*keys, "prefix").filter("prefix is not null").distinct()
    if segments:
        prefixes = prefixes.withColumn("_part", F.rtrim(F.col("prefix"), F.lit("/")))
        cuts = F.filter(F.sequence(F.lit(0), F.length("path")), lambda n: (n == F.length("path")) | (F.substring(F.col("path"), n + 1, F.lit(1)) == "/"))
        parts = F.array_distinct(F.transform(cuts, lambda n: F.rtrim(F.substring(F.col("path"), F.lit(1), n), F.lit("/"))))
    else:
        prefixes = cut(prefixes.withColumn("_part", F.col("prefix")))
        lengths = sorted(r[0] for r in prefixes.select(F.length("_part")).distinct().collect())  # as many as a path has characters
        parts = F.transform(F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    found = paths.withColumn("_part", F.explode(parts)).join(prefixes, [*keys, "_part"])
    best = F.max(F.struct(F.length("_part").alias("n"), F.col("prefix"))).alias("_best")
    return found.groupBy(*keys, "path").agg(best).select(*keys, "path", F.col("_best.prefix").alias("prefix"))
