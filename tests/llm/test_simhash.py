"""Fingerprints, Golay tables and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from quillmap.llm import simhash_dedup as sd


def plain_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", " \n", "One", "one TWO", "É é\x85x y z", "a b c d " * 700]
    texts += [" ".join(rng.choices(["the", "Cat", "sat", "ÀB", "x"], k=rng.randint(1, 600))) for _ in range(60)]
    assert sd.fingerprints([t.encode() for t in texts]).tolist() == [plain_print(t) for t in texts]
    assert sd.fingerprints([]).tolist() == []


def test_golay_code_is_perfect():
    g = sd.Golay()
    rng = np.random.default_rng(1)
    data = rng.integers(0, 4096, 3000)
    word = data << 11 | g.parity[data]
    for weight in range(4):
        errors = np.array([sum(1 << int(b) for b in rng.choice(23, weight, replace=False)) for _ in data])
        assert (g.index(word ^ errors) == data).all()


@pytest.mark.parametrize("weight", [1, 2, 3])
def test_tables_find_every_neighbour(weight):
    rng = np.random.default_rng(weight)
    g = sd.Golay()
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, weight, replace=False)) for _ in a], dtype=np.uint64)
    pair = np.concatenate([a, a ^ flips]).view(np.int64)
    key, at = sd.golay_rows(pair, g)
    of = [set() for _ in pair]
    for k, i in zip(key.tolist(), at.tolist()):
        of[i].add(k)
    assert all(of[i] & of[i + 400] for i in range(400))
    assert len(key) < 100 * len(pair)


def plain_components(rows):
    prints = [plain_print(t) for _, t in rows]
    parent = list(range(len(rows)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, f"{prints[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def test_components_of_documents(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choices("alpha beta gamma delta eps zeta eta theta".split(), k=200)) for _ in range(12)]
    rows = [(None, None), (5, ""), (7, " "), (8, "one two"), (8, "one two")]
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["x", "y"])
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame([(t, i, "c") for i, t in rows], "text string, doc_id long, fp string")
    got = sorted((tuple(r) for r in sd.simhash_components(df).collect()), key=str)
    assert got == plain_components(rows)
    assert sd.simhash_components(df.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(9).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(299)], "u long, v long")
    got = sd.components(links).collect()
    assert {r["node"] for r in got} == set(range(1, 300)) and {r["root"] for r in got} == {0}


def test_near_pairs_span_a_bucket():
    fp = np.array([0, 1, 3, 7, 7 << 60, 0, 1], np.int64)
    key = np.array([1, 1, 1, 1, 1, 2, 2], np.int64)
    u, v = sd.near_pairs(key, fp, 1, hold=1)
    assert sorted(zip(u.tolist(), v.tolist())) == [(1, 0), (3, 0), (7, 0)]


def plain_roots(fp, radius):
    """Components by a grid of all pairs."""
    label = np.arange(len(fp))
    close = [np.flatnonzero(np.bitwise_count((fp ^ x).view(np.uint64)) <= radius) for x in fp]
    while True:
        low = np.array([label[c].min() for c in close])
        if (low == label).all():
            return label
        label = low


@pytest.mark.parametrize("free", [12, 30, 64])
def test_large_buckets_lose_no_link(free):
    """One bucket whose members differ in `free` bits: sparse, dense and clustered."""
    rng = np.random.default_rng(free)
    centres = rng.integers(0, 1 << min(free, 62), 40)
    fp = rng.integers(0, 1 << min(free, 62), 1500)
    flips = np.array([sum(1 << int(b) for b in rng.choice(free, rng.integers(0, 5), replace=False)) for _ in range(1500)], np.uint64).view(np.int64)
    fp = np.unique(np.concatenate([fp, rng.choice(centres, 1500) ^ flips]))
    u, v = sd.near_pairs(np.zeros(len(fp), np.int64), fp, 3, small=32)
    want = fp[plain_roots(fp, 3)]
    root = dict(zip(u.tolist(), v.tolist()))
    assert [root.get(x, x) for x in fp.tolist()] == want.tolist()


def test_work_in_a_bucket_is_about_linear(monkeypatch):
    """100,000 fingerprints that share 22 bits: far fewer comparisons than the square."""
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 1 << 42, 100_000))
    near = fp[:20_000] ^ (1 << rng.integers(0, 42, 20_000))
    fp = np.unique(np.concatenate([fp, near]))
    compared = []
    real = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: compared.append(len(x)) or real(x))
    u, v = sd.near_pairs(np.zeros(len(fp), np.int64), fp, 3)
    assert sum(compared) < 1000 * len(fp)
    root = dict(zip(u.tolist(), v.tolist()))
    there = set(fp.tolist())
    links = [(int(x), int(x) ^ 1 << k) for x in near[:300] for k in range(42) if int(x) ^ 1 << k in there]
    assert links and all(root.get(a, a) == root.get(b, b) for a, b in links)


def test_crowded_keys_take_a_further_round(spark):
    rng = np.random.default_rng(6)
    fp = np.unique(np.concatenate([rng.integers(0, 1 << 14, 600) << 40, rng.integers(0, 1 << 62, 100)]))
    prints = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    got = {r["node"]: r["root"] for r in sd.components(sd.fingerprint_links(prints, crowd=20)).collect()}
    assert [got.get(x, x) for x in fp.tolist()] == fp[plain_roots(fp, 3)].tolist()


def test_crowded_keys_take_several_rounds(spark):
    """Fingerprints that share 42 bits: crowded after the first and the second further round as well."""
    rng = np.random.default_rng(7)
    assert [bin(x & 2**64 - 1).count("1") for x in sd.open_blocks(-1)] == [16] * 4 and sum(x & 2**64 - 1 for x in sd.open_blocks(-1)) == 2**64 - 1
    fp = np.unique(np.concatenate([rng.integers(0, 1 << 22, 3000) << 20, (rng.integers(0, 1 << 22, 300) << 41) | 5, rng.integers(-(1 << 62), 1 << 62, 50)]))
    prints = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    got = {r["node"]: r["root"] for r in sd.components(sd.fingerprint_links(prints, crowd=60)).collect()}
    assert [got.get(x, x) for x in fp.tolist()] == fp[plain_roots(fp, 3)].tolist()
