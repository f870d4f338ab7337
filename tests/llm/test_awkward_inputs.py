"""Columns of the input that are named like results, long conversations, and rows that repeat."""

import hashlib
import random
from collections import Counter

from quillmap.llm import chat_format, exact_dedup, mixing, packing, secret_scan, simhash_dedup, suffix_dedup, token_counts

CLASH = "doc_id long, text string, source string, fp string, fingerprint string, component_id string, keep_id string, group_size string, kept string, text_sha256 string, piece string, start string, sequence_id string, n_bytes string, spans string, n_tokens string, n_assign string, key string, t1 string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "s", *["x"] * 16) for i, t in rows], CLASH)


ROWS = [(1, "Hello world"), (1, "Hello world"), (2, "HELLO WORLD"), (None, None), (3, ""), (3, ""), (4, "a b c d " * 200), (5, "a b c d " * 200)]


def test_columns_named_like_results(spark):
    df = clashing(spark, ROWS)
    exact = exact_dedup.exact_dedup(df, keep="largest")
    assert set(exact.columns) == {*df.columns} and Counter(r["kept"] for r in exact.collect())[True] == 3
    assert {r["group_size"] for r in exact.collect()} == {2, 3}
    near = simhash_dedup.simhash_components(df).collect()
    assert len(near) == len(ROWS) and {len(r["fingerprint"]) for r in near} == {16}
    assert {r["component_id"] for r in near if r["doc_id"] in (1, 2)} == {1}
    packed = packing.pack_documents(df).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(i for i, _ in ROWS)
    cut = {r["doc_id"]: r for r in suffix_dedup.repeated_passages(df).collect()}
    assert cut[4]["spans"] == cut[5]["spans"] and cut[4]["spans"][0]["end"] == 1600 and cut[1]["spans"] == []
    assert all(r["n_tokens"] == 2 for r in token_counts.token_counts(df).collect() if r["doc_id"] == 1)
    assert len(secret_scan.secret_spans(df).collect()) == len(ROWS)


def test_ties_of_common_texts(spark):
    """Ids of a common text that are all null or all equal: one row stays, whatever the partitions."""
    for rows in ([(None, "same")] * 60 + [(1, "other")], [(7, "same")] * 60 + [(1, "other")]):
        for parts in (1, 5):
            out = exact_dedup.exact_dedup(clashing(spark, rows).repartition(parts), hot_rows=5).collect()
            assert len(out) == 61 and Counter(r["kept"] for r in out)[True] == 2
            assert Counter(r["text"] for r in out if r["kept"]) == Counter(["same", "other"])


def test_many_common_texts(spark, monkeypatch):
    """More common texts than are broadcast: the same rows by plain joins."""
    rows = [(i, f"text {i % 40}") for i in range(400)] + [(1000 + i, f"alone {i}") for i in range(40)]
    few = sorted(map(str, exact_dedup.exact_dedup(clashing(spark, rows), hot_rows=5).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 3)
    assert sorted(map(str, exact_dedup.exact_dedup(clashing(spark, rows), hot_rows=5).collect())) == few


def test_long_conversation(spark):
    rng = random.Random(17)
    turns = [(9, k, "assistant" if k % 2 else "user", "".join(rng.choices("ab<|\\\n é", k=40))) for k in range(301)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    examples = chat_format.chat_examples(df)
    assert examples.filter("target_turn is not null").count() == 150
    got = chat_format.read_back(examples).first()
    everything = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
    loss = "".join(text for _, _, role, text in turns if role == "assistant")
    assert (got["n_turns"], got["turns_sha256"]) == (301, hashlib.sha256(everything.encode()).hexdigest())
    assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_mix_orders_ties_by_text(spark):
    """Rows of one id and size with different texts: the same ones are taken in every order of the rows."""
    rows = [(1, f"w{k} w{k}", "a") for k in range(50)] + [(2, "x " * 30, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted((r["text"], r["taken"]) for r in mixing.mix_sources(df.repartition(n)).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]


def test_mix_of_many_sources(spark, monkeypatch):
    """More sources than are broadcast: the same rows by a plain join."""
    rows = [(i, "w " * (i % 30), f"s{i % 20}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = sorted(map(str, mixing.mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(str, mixing.mix_sources(df).collect())) == few
