"""Suffix order and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from quillmap.llm import suffix_dedup as sd


@pytest.mark.parametrize("alphabet", [1, 2, 4, 200])
def test_suffix_array(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in [*range(0, 40), 300, 301, 302]:
        s = rng.integers(1, alphabet + 1, n)
        assert sd.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def plain(rows, length):
    where = {}
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            where.setdefault(b[i : i + length], []).append((k, i))
    masks = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                masks[k][i : i + length] = True
    out = []
    for (doc, t), m in zip(rows, masks):
        b = (t or "").encode()
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out.append((doc, len(b), int(m.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(6)] + ["To " * 90, "x" * 500]
    rows = [(None, None), (1, ""), (2, shared[0]), (2, shared[0]), (3, "To " * 200), (4, "y" * (length - 1)), (5, "z" * (length + 1))]
    for i in range(60):
        rows.append((10 + i, text(rng.randint(0, 80)) + rng.choice(shared)[rng.randint(0, 40):] + text(rng.randint(0, 80)) + rng.choice(shared)))
    return rows


@pytest.mark.parametrize("length,hot,bits", [(400, 4096, 64), (100, 4096, 64), (100, 3, 64), (100, 4096, 4), (100, 40, 4)])
def test_repeated_passages(spark, length, hot, bits):
    """With hashes of 4 bits all dealing collides, and results are the same."""
    rows = random_rows(length + hot, length)
    df = spark.createDataFrame([(t, i, "s") for i, t in rows], "text string, doc_id long, spans string")
    got = []
    for r in sd.repeated_passages(df, length=length, hot=hot, task_bytes=20_000, bits=bits).collect():
        got.append((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]))
    assert sorted(got, key=str) == plain(rows, length)


def test_a_passage_in_every_text(spark):
    """One passage of 150 bytes in 300 contexts: its keys are split, and no sort sees more than `hot` of its stretches."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = word(150)
    rows = [(i, f"{word(120)}{passage if i % 10 else word(20) + passage[:90]}{word(130)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for r in sd.repeated_passages(df, length=100, hot=20).collect():
        got.append((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]))
    assert sorted(got, key=str) == plain(rows, 100)


def test_passages_of_over_50_words(spark):
    """The contract counts bytes, not words: a passage that two texts share stays at 399 bytes and goes at 400."""
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    short, long = words(80)[:399], words(80)[:400]
    assert len(short.split()) > 50 and len(long.split()) > 50
    rows = [(i, f"{words(90)} {a}{p}{b} {words(90)}") for i, (p, a, b) in enumerate([(short, "(", ")"), (short, "[", "]"), (long, "(", ")"), (long, "[", "]")])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for r in sd.repeated_passages(df).collect():
        got.append((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]))
    assert [g[2] for g in sorted(got)] == [0, 0, 400, 400]
    assert sorted(got, key=str) == plain(rows, 400)


def test_texts_over_a_segment(spark):
    """Segments end inside a repeated passage."""
    rng = random.Random(10)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    shared = word(3000)
    rows = [(1, word(9000) + shared + word(500)), (2, word(100) + shared), (3, word(5000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for r in sd.repeated_passages(df, length=100, segment=1000).collect():
        got.append((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]))
    assert sorted(got, key=str) == plain(rows, 100)


def test_no_rows(spark):
    assert sd.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_segments_cover_every_start():
    covered = [s for a, b in sd._segments(333, 100, 50) for s in range(a, b - 99)]
    assert covered == list(range(234))
