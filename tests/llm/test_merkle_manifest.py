"""The Merkle manifest against a plain tree, over awkward rows and several reductions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillmap.llm import merkle_manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, proof int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    fields = [row[0], row[3], row[2], row[4], text]
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(nodes):
    """The root, and per node the siblings (before, after) of each level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, i in enumerate(at):
            run, p = runs[i // 3], i % 3
            paths[k].append((run[:p], run[p + 1 :]))
        at, level = [i // 3 for i in at], [sha(*run) for run in runs]
    return (level or [None])[0], paths


def climb(node, path):
    for before, after in path:
        node = sha(*before, node, *after)
    return node


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, plain_leaf(r, r[1]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, paths = {}, {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        subs[s], paths[s] = tree([x[2] for x in groups[s]])
    root, above = tree([subs[s] for s in order])
    out = []
    for k, s in enumerate(order):
        for (_, _, leaf, r), path in zip(groups[s], paths[s]):
            whole = path + above[k]
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = climb(plain_leaf(r, text), whole)
            out.append((r[0], leaf, subs[s], root, sha(*[x for b, a in whole for x in b + a]), folded, folded == root))
    return out


def rows_of(n, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "one line", "a\nb", "é\n\n" * 3, "x\n" * 4000])
    source = lambda: rng.choice(["hot"] * 5 + ["b", "é", "Z", "", None, f"s{rng.randint(0, 20)}"])
    rows = [(rng.choice([i, i, i, None, 7]), text(), rng.choice(["en", None]), source(), rng.choice([3, None]), "l", "r", 1) for i in range(n)]
    return rows + rows[: n // 10]  # repeated rows


@pytest.mark.parametrize("n,levels", [(160, 1), (160, 2), (90, 7)])
def test_against_a_plain_tree(spark, tmp_path, monkeypatch, n, levels):
    rows = rows_of(n, n + levels)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    whole = M.manifest
    monkeypatch.setattr(M, "manifest", lambda df, **more: whole(df, levels=levels, **more))
    got = [tuple(r) for r in M.op13(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))
    assert {r[6] for r in got} == {True, False}


def test_small_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert M.manifest(df([])).collect() == []
    (one,) = M.manifest(df([(1, "a", None, None, 1, "", "", 1)])).collect()
    assert one["leaf"] == one["subroot"] == one["root"] and (one["path_at"], one["path_of"], one["proof"]) == ([], [], "")
    three = M.manifest(df([(i, "a", None, "s", 1, "", "", 1) for i in range(4)]), carry={"n": F.col("n_chars")}, levels=1).collect()
    assert len({r["subroot"] for r in three}) == 1 and [r["n"] for r in three] == [1] * 4
    assert all(M.fold_one(r["leaf"], r["path_at"], r["path_of"], r["proof"]) == r["root"] for r in three)
