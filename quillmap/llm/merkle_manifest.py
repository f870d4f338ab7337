"""Merkle manifest of a dataset: superblock reduction.

Every row is a leaf, the SHA-256 of its columns. The leaves of a group (a source) form a tree, and the groups' roots,
in the order of groups, one more tree above them. While a tree has several nodes, every `fanout` consecutive ones (the
last run may be shorter, even a single node) become the hash of their concatenated digests.

Method. Rows are numbered within their group by a two-level prefix scan, so that a group of any size is spread over
tasks. Numbers are bucketed by fanout^levels; applyInPandas collapses `levels` levels of a bucket at once and gives each
of its nodes the siblings on the way up to the bucket's root. The bucket roots are the nodes of the next reduction,
which is fanout^levels times as short; this repeats until each group has one node. Then proofs are put together from the
top: those of the group's root to each group's last buckets, those of a bucket to its nodes, down to the rows. Each of
these joins is by (group, bucket), so no key has more than fanout^levels rows. Tables between the steps are written to
the shared folder, so a lost executor costs its tasks alone. Nothing is collected but the number of reductions.

A proof is (path_at, path_of, proof): per level the node's position in its run, the length of the run, and the digests of
the run's other nodes, left to right, as one string. `fold` recomputes the root from a leaf and a proof.

Defined results: a null value is hashed as such and is unlike an empty one. A null group is a group and the first one;
null ids come first in their group; rows of one id are ordered by their leaf, so repeated rows are neighbours that share
a digest. A group of one row has its leaf as its root; a table of one group has that group's root. No rows give no rows.
Other input columns are dropped unless `carry` names them.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.operators.prefix_scan import numbered

from .common import documents, written

FANOUT, LEVELS = 3, 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "path_at array<int>, path_of array<int>, proof string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """SHA-256 of the columns: each `-` if null, else its length in bytes, `:` and the value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def depth(n: Column, fanout: int) -> Column:
    """Levels above n nodes: the smallest t with fanout^t >= n."""
    steps, power = [], 1
    while power < 2**62:
        steps.append((F.lit(power) < n).cast("int"))
        power *= fanout
    return reduce(lambda a, b: a + b, steps)


def collapse(digests: list[str], levels: int, fanout: int) -> tuple[str, list[tuple[list[int], list[int], str]]]:
    """The root of consecutive nodes after so many levels, and each node's proof (positions, run lengths, siblings)."""
    heights, steps = [digests], []
    for _ in range(levels):
        nodes = heights[-1]
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        steps.append([(p, len(run), "".join(run[:p] + run[p + 1 :])) for run in runs for p in range(len(run))])
        heights.append([digest(*run) for run in runs])
    if len(heights[-1]) != 1:
        raise ValueError("the nodes span more than one bucket")
    proofs: list[tuple[list[int], list[int], str]] = [([], [], "")]
    for step in reversed(steps):
        above = proofs
        proofs = []
        for i, (p, of, siblings) in enumerate(step):
            at_, of_, rest = above[i // fanout]
            proofs.append(([p, *at_], [of, *of_], siblings + rest))
    return heights[-1][0], proofs


def _reduced(nodes: DataFrame, levels: int, fanout: int) -> DataFrame:
    """Nodes (_key, _index, _depth, _digest, ...) with the proof up to their bucket's root, and that root as _top."""
    size = fanout**levels

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_index", kind="stable")
        top, proofs = collapse(pdf["_digest"].tolist(), min(levels, int(pdf["_depth"].iloc[0])), fanout)
        at, of, siblings = zip(*proofs)
        return pdf.assign(path_at=at, path_of=of, proof=siblings, _top=top)

    buckets = nodes.withColumn("_bucket", F.expr(f"_index div {size}"))
    return buckets.groupBy("_key", "_bucket").applyInPandas(one, f"{_schema(buckets)}, {PROOF}, _top string")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def forest(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """The reductions of trees (_key, _index from 0 without gaps, _count, _digest): tables of nodes with _depth (levels
    from here to the tree's root), their proofs up to their bucket's root and that root as _top, the leaves first."""
    nodes = nodes.withColumn("_depth", depth(F.col("_count"), fanout)).drop("_count")
    out = [written(_reduced(nodes, levels, fanout), "merkle")]
    most = out[0].agg(F.max("_depth")).first()[0] or 0
    for _ in range(levels, most, levels):
        up = out[-1].filter((F.col("_depth") > levels) & (F.col("_index") % fanout**levels == 0))
        nodes = up.select("_key", F.col("_bucket").alias("_index"), F.col("_top").alias("_digest"), (F.col("_depth") - levels).alias("_depth"))
        out.append(written(_reduced(nodes, levels, fanout), "merkle"))
    return out


def roots(stages: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """(_key, _root) of each tree of a forest."""
    ends = [s.filter((F.col("_depth") <= levels) & (F.col("_index") == 0)).select("_key", F.col("_top").alias("_root")) for s in stages]
    return reduce(DataFrame.unionAll, ends)


def _joined(stages: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The forest's leaves with whole proofs. above: (_key, <proof>, ...) from each tree's root on; its columns come along."""
    more = [c for c in above.columns if c not in ("_key", "path_at", "path_of", "proof")]
    upper = None
    for stage in reversed(stages):
        ends = stage.filter((F.col("_depth") <= levels) & (F.col("_index") == 0)).select("_key").join(above, "_key")
        ends = ends.select("_key", F.lit(0).cast("long").alias("_bucket"), "path_at", "path_of", "proof", *more)
        upper = ends if upper is None else ends.unionByName(upper)
        known = upper.select("_key", "_bucket", *[F.col(c).alias(f"_up_{c}") for c in ("path_at", "path_of", "proof")], *more)
        whole = stage.join(known, ["_key", "_bucket"]).withColumns({c: F.concat(c, f"_up_{c}") for c in ("path_at", "path_of", "proof")})
        upper = whole.select("_key", F.col("_index").alias("_bucket"), "path_at", "path_of", "proof", *more)
    return whole.drop("_up_path_at", "_up_path_of", "_up_proof")


def fold(leaf_col: Column, path_at: Column, path_of: Column, proof: Column) -> Column:
    """The root that a leaf (hex digest) and a proof lead to."""

    @F.pandas_udf("string")
    def folded(leaves: pd.Series, at: pd.Series, of: pd.Series, siblings: pd.Series) -> pd.Series:
        return pd.Series([fold_one(*row) for row in zip(leaves, at, of, siblings)], dtype=object)

    return folded(leaf_col, path_at, path_of, proof)


def fold_one(node: str, path_at, path_of, proof: str) -> str:
    begin = 0
    for at, of in zip(path_at, path_of):
        cut, end = begin + 64 * int(at), begin + 64 * (int(of) - 1)
        node = digest(proof[begin:cut], node, proof[cut:end])
        begin = end
    return node


def manifest(
    df: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = COLUMNS,
    carry: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """id, group, leaf, subroot, root, path_at, path_of and proof of every row, and the columns of `carry`."""
    named = lambda c: F.col(f"`{c}`")
    extra = carry or {}
    rows = df.select(
        named(id_col).alias("_id"), named(group_col).cast("string").alias("_group"), leaf(*[named(c) for c in columns]).alias("_digest"),
        *[c.alias(f"_more_{name}") for name, c in extra.items()],
    )
    # leaves are hashed once: what follows reads digests, not texts
    ranked = numbered(written(rows, "leaves"), ["_group"], ["_id", "_digest"])
    # a group's key is never null, so that joins need no null-safe comparison
    key = F.coalesce(F.concat(F.lit("="), F.col("_group")), F.lit("null"))
    nodes = ranked.withColumn("_key", key).withColumnRenamed("_index_all", "_count")
    stages = forest(nodes, fanout, levels)

    group = F.when(F.col("_key") != "null", F.substring("_key", 2, 2**31 - 1))
    tops = roots(stages, levels).withColumn("_group", group)
    sources = numbered(tops, [], ["_group"]).select(F.lit("").alias("_key"), "_index", F.col("_index_all").alias("_count"), F.col("_root").alias("_digest"), F.col("_key").alias("_tree"))
    upper = forest(sources, fanout, levels)
    root = roots(upper, levels).select("_key", F.array().cast("array<int>").alias("path_at"), F.array().cast("array<int>").alias("path_of"), F.lit("").alias("proof"), F.col("_root").alias("root"))
    above = _joined(upper, root, levels).select(F.col("_tree").alias("_key"), "path_at", "path_of", "proof", F.col("_digest").alias("subroot"), "root")
    out = _joined(stages, written(above, "merkle"), levels)
    return out.select(
        F.col("_id").alias(id_col), F.col("_group").alias(group_col), F.col("_digest").alias("leaf"), "subroot", "root", "path_at", "path_of", "proof",
        *[F.col(f"_more_{name}").alias(name) for name in extra],
    )


def op13(spark, sf_dir: str) -> DataFrame:
    cut_text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = leaf(*[cut_text if c == "text" else F.col(c) for c in COLUMNS])
    rows = manifest(documents(spark, sf_dir), carry={"tampered": tampered})
    rows = rows.withColumn("folded_root", fold(F.col("tampered"), F.col("path_at"), F.col("path_of"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(most: int = 14) -> str:
    """Levels are written out, `most` for the leaves of a source (3^most of them) and for sources."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf_of = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in COLUMNS) + ")"
    crc = "list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)))"
    cut_text = f"(CASE WHEN ({crc}) % 2 = 1 THEN replace(text, chr(10), '') ELSE text END)"  # the checksum is the complement
    parts = [
        f"d AS (SELECT doc_id, source, {leaf_of('text')} AS leaf, {leaf_of(cut_text)} AS t FROM documents)",
        "a0 AS MATERIALIZED (SELECT source AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, doc_id, t, leaf AS h FROM d)",
        "p0 AS MATERIALIZED (SELECT s, i, doc_id, h AS leaf, '' AS proof, t AS f FROM a0)",
        "n0 AS MATERIALIZED (SELECT s, i, n, h FROM a0)",
    ]

    def climb(node: str, proof: str, step: int, carried: str) -> None:
        # one level: nodes of trees with several become runs of three; the others stay
        parts.append(
            f"{node}{step + 1} AS MATERIALIZED (SELECT s, i // 3 AS i, (n + 2) // 3 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {node}{step} WHERE n > 1 GROUP BY s, i // 3, n"
            f" UNION ALL SELECT s, i, n, h FROM {node}{step} WHERE n = 1)"
        )
        parts.append(
            f"{proof}{step + 1} AS MATERIALIZED (SELECT p.s, CASE WHEN any_value(q.n) > 1 THEN p.i // 3 ELSE p.i END AS i, {carried}, p.proof || coalesce(string_agg(q.h, '' ORDER BY q.i) FILTER (q.i <> p.i), '') AS proof,"
            f" CASE WHEN any_value(q.n) > 1 THEN sha256(string_agg(CASE WHEN q.i = p.i THEN p.f ELSE q.h END, '' ORDER BY q.i)) ELSE p.f END AS f"
            f" FROM {proof}{step} p JOIN {node}{step} q ON p.s IS NOT DISTINCT FROM q.s AND p.i // 3 = q.i // 3 GROUP BY p.s, p.i, p.proof, p.f, {carried})"
        )

    for step in range(most):
        climb("n", "p", step, "p.doc_id, p.leaf")
    parts.append(f"m0 AS MATERIALIZED (SELECT 0 AS s, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, s AS source FROM n{most})")
    parts.append(f"r0 AS MATERIALIZED (SELECT 0 AS s, m0.i, p.doc_id, p.leaf, m0.h AS subroot, p.proof, p.f FROM p{most} p JOIN m0 ON p.s IS NOT DISTINCT FROM m0.source)")
    for step in range(most):
        climb("m", "r", step, "p.doc_id, p.leaf, p.subroot")
    return "WITH " + ",\n".join(parts) + (
        f"\nSELECT doc_id, leaf, subroot, m.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = m.h AS verified FROM r{most}, m{most} m"
    )


SQL = _sql()
