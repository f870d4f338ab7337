"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint. A bit of the 64 is set where it is set in more than half of the XXH64 hashes (seed 42) of the text's
shingles, repeats included.

Candidates. A fingerprint is cut into three segments of 22, 21 and 21 bits, each padded with zeros to the 23 bits of
the binary Golay code. The code is perfect: every word is within 3 bits of exactly one codeword, whose 12 data bits are
the word's index. The keys of a word are the indices of the word and of its neighbours at one bit: about six. Two words
one bit apart share a key: one's index is among the other's keys. Of 3 differing bits or fewer over three segments,
either one segment has none, and then another has at most one; or each has exactly one. So two fingerprints within 3
bits always meet in one of seven tables: (segment equal, another's Golay key), six of them, with about 33 key bits, and
(Golay keys of all three), with 36. Of each pair of sides only one is expanded to its keys.

Links. Rows of a key are neighbours after sorting. Up to `SMALL` of them are compared in pairs. More are dealt out once
more: the bits that differ among them are cut into four blocks, and two fingerprints within 3 bits agree in one of the
blocks at least, so only those that do are compared, by the same rule again. A key with over `CROWD` rows is handed back
by its task as it comes, batch by batch, with the keys of four parts of the bits that are still open, for a further round on
all tasks; each round leaves three quarters of the open bits, and few bits have few values, so it ends. A task hands on a spanning
forest of the links that it found, not the links. Components then come from alternating large-star and small-star
steps, with a checkpoint each.

Distribution. Rows with equal fingerprints are one candidate. Hubs are summed with map-side aggregation and joined by
sort-merge joins that Spark may split. Nothing but counts comes to the driver.

Defined results: null and empty texts have fingerprint zero and link like others. Texts with fewer words than a shingle
are one shingle. A component's id is its smallest doc_id, null only if all its ids are null. Rows that repeat an id
each have a row. No rows give no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, documents

SHINGLE, RADIUS = 3, 3
SMALL, CROWD = 256, 200_000
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


# ---------------------------------------------------------------------------------------------- fingerprints
def _spread() -> np.ndarray:
    """For each byte, its bits as the 8 bytes of a 64-bit integer."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).reshape(256)


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text (UTF-8), as unsigned 64-bit integers."""
    import xxhash

    hash_, hashes, sizes = xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = text.lower().split()  # of bytes: A-Z only, and exactly the six separators
        if not found:
            continue
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        stop = (ends[min(shingle, len(found)) - 1 :] - 1).tolist()
        start = [0, *ends[: len(stop) - 1].tolist()]
        hashes += [hash_(joined[a:b], 42) for a, b in zip(start, stop)]
        sizes[k] = len(stop)
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    lanes = _spread()[np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)]
    # byte lanes hold sums up to 255: blocks of that many shingles first, then whole texts
    blocks = -(-sizes // 255)
    owner = np.repeat(np.arange(len(texts)), blocks)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = (np.cumsum(sizes) - sizes)[owner] + 255 * first
    sums = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(len(owner), 64).astype(np.int64)
    some = np.flatnonzero(blocks)
    counts = np.add.reduceat(sums, (np.cumsum(blocks) - blocks)[some], axis=0)
    bits = (2 * counts > sizes[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def simhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed integer) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held, size = [np.zeros(0, np.uint64)], [], 0
            for x in batch.column(1):
                held.append(x.as_py() or b"")
                size += len(held[-1])
                if size >= batch_bytes:
                    done.append(fingerprints(held, shingle))
                    held, size = [], 0
            done.append(fingerprints(held, shingle))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(done).view(np.int64))], names=["doc_id", "fp"])

    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------------------------------------- Golay keys
class Golay:
    def __init__(self):
        high = np.arange(4096, dtype=np.int64) << 11
        self.parity = self._remainder(high)
        self.error = np.zeros(2048, np.int64)
        bits = 1 << np.arange(23, dtype=np.int64)
        one = bits
        two = np.array([a | b for i, a in enumerate(bits) for b in bits[:i]])
        three = np.array([a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]])
        for errors in (one, two, three):
            self.error[self._remainder(errors)] = errors

    @staticmethod
    def _remainder(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for b in range(22, 10, -1):
            v = np.where((v >> b) & 1, v ^ (GENERATOR << (b - 11)), v)
        return v

    def index(self, v: np.ndarray) -> np.ndarray:
        """Data bits of the codeword within 3 bits of v."""
        return (v ^ self.error[(v & 0x7FF) ^ self.parity[v >> 11]]) >> 11

    def keys(self, v: np.ndarray, bits: int) -> np.ndarray:
        """[word, key]: the indices of v and its neighbours in the first `bits` bits; repeats are -1."""
        near = v[:, None] ^ np.append(0, 1 << np.arange(bits, dtype=np.int64))
        out = np.sort(self.index(near), axis=1)
        out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
        return out


def golay_rows(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in fp) of both sides of the seven tables."""
    u = fp.view(np.uint64)
    parts = [((u >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    own = [golay.index(p) for p in parts]
    near = [golay.keys(p, n) for p, (_, n) in zip(parts, SEGMENTS)]
    keys, at = [], []

    def add(key: np.ndarray, ok: np.ndarray) -> None:
        where = np.nonzero(ok)
        keys.append(key[where])
        at.append(where[0])

    table = 0
    for a in range(3):
        for b in range(3):
            if a != b:  # the side without neighbours has the key `own`, which is among `near` as well
                add((table << 36 | parts[a] << 12)[:, None] | near[b], near[b] >= 0)
                table += 1
    x, y, z = near
    left = (table << 36 | own[1] << 12)[:, None, None] | x[:, :, None] << 24 | z[:, None, :]
    add(left, (x >= 0)[:, :, None] & (z >= 0)[:, None, :])
    right = (table << 36 | own[0] << 24 | own[2])[:, None] | y << 12
    add(right, y >= 0)
    return np.concatenate(keys), np.concatenate(at)


# ---------------------------------------------------------------------------------------------- links
def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, smallest member) of the components of the links u, v."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            break
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[member], nodes[label[member]]


def _all_pairs(key: np.ndarray, fp: np.ndarray, radius: int, hold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of close rows with one key (rows sorted by key), by comparing all of them."""
    at = np.arange(len(key))
    us, vs, held, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 1
    while True:
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        a, b = fp[at], fp[at + d]
        close = (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= radius)
        us.append(a[close])
        vs.append(b[close])
        held += int(close.sum())
        if held > hold:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], 0
        d += 1
    return forest(np.concatenate(us), np.concatenate(vs))


def _blocks(fp: np.ndarray, radius: int) -> list[np.ndarray]:
    """The values of radius + 1 blocks of the bits that differ in fp, the evenest bits dealt out in turn."""
    words = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    share = words.mean(axis=0)
    bits = np.argsort(np.abs(share - 0.5), kind="stable")
    bits = bits[(share[bits] > 0) & (share[bits] < 1)]
    out = []
    for k in range(radius + 1):
        value = np.zeros(len(fp), np.int64)
        for j in bits[k :: radius + 1]:
            value = value << 1 | words[:, j]
        out.append(value)
    return out


def near_pairs(key: np.ndarray, fp: np.ndarray, radius: int, hold: int = 2_000_000, small: int = SMALL, depth: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the rows (sorted by key) that share a key and differ in at most `radius` bits."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    large = size > small if depth else np.zeros(len(size), bool)
    few = np.repeat(~large, size)
    u, v = _all_pairs(key[few], fp[few], radius, hold)
    for a, n in zip(first[large].tolist(), size[large].tolist()):
        group = np.unique(fp[a : a + n])
        if len(group) <= small:
            x, y = _all_pairs(np.zeros(len(group), np.int64), group, radius, hold)
            u, v = forest(np.concatenate([u, x]), np.concatenate([v, y]))
            continue
        for value in _blocks(group, radius):
            order = np.argsort(value, kind="stable")
            x, y = near_pairs(value[order], group[order], radius, hold, small, depth - 1)
            u, v = forest(np.concatenate([u, x]), np.concatenate([v, y]))
    return u, v


#: Open bits of a key up to which its fingerprints are compared in one task: 4,096 values at most.
FEW_BITS = 12


def open_blocks(mask: int) -> list[int]:
    """Four parts of the open bits: values that differ in three bits at most agree in one of them."""
    bits = [k for k in range(64) if mask >> k & 1]
    size, more = divmod(len(bits), 4)
    parts, at = [], 0
    for k in range(4):
        n = size + (k < more)
        part = sum(1 << b for b in bits[at : at + n])
        parts.append(part - (1 << 64) if part >> 63 else part)
        at += n
    return parts


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(u, v) with u > v: links among distinct fingerprints (column fp) that span their components."""
    if radius > RADIUS:
        raise ValueError(f"the tables find up to {RADIUS} differing bits")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for s in range(0, len(fp), 20_000):
                key, at = golay_rows(fp[s : s + 20_000], golay)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[s : s + 20_000][at])], names=["key", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (u, v, null), and for keys with over `crowd` rows (new key, fp, bits that are still open) for the next round."""
        key, fp, rest = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        us, vs, crowded = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], None

        def take(n: int) -> None:
            nonlocal key, fp, rest, us, vs
            u, v = near_pairs(key[:n], fp[:n], radius)
            u, v = forest(np.concatenate([*us, u]), np.concatenate([*vs, v]))
            us, vs, key, fp, rest = [u], [v], key[n:].copy(), fp[n:].copy(), rest[n:].copy()

        def hand_on(n: int) -> Iterator[pa.RecordBatch]:
            nonlocal key, fp, rest
            for mask in np.unique(rest[:n]):
                mine = rest[:n] == mask
                for block, part in enumerate(open_blocks(int(mask))):
                    mixed = (key[:n][mine] * 4 + block) * 0x9E3779B1 + (fp[:n][mine] & part) * 0x85EBCA6B
                    mixed ^= (mixed >> 29) & 0x7FFFFFFFF
                    left = np.full(int(mine.sum()), mask & ~part, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(mixed), pa.array(fp[:n][mine]), pa.array(left)], names=["u", "v", "rest"])
            key, fp, rest = key[n:].copy(), fp[n:].copy(), rest[n:].copy()

        for batch in batches:
            key, fp, rest = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((key, fp, rest)))
            if crowded is not None and len(key) and key[0] == crowded:
                yield from hand_on(int(np.searchsorted(key, crowded, "right")))
            if len(key) > min(crowd, 500_000):  # all but the last key, which may go on in the next batch
                take(int(np.searchsorted(key, key[-1])))
                # so few open bits allow few values, which are compared here
                if len(key) > crowd and (int(rest[0]) & 2**64 - 1).bit_count() > FEW_BITS:
                    crowded = key[-1]
                    yield from hand_on(len(key))
        take(len(key))
        yield pa.RecordBatch.from_arrays([pa.array(us[0]), pa.array(vs[0]), pa.nulls(len(us[0]), pa.int64())], names=["u", "v", "rest"])

    rows = prints.select("fp").mapInArrow(expand, "key long, fp long").withColumn("rest", F.lit(-1).cast("long"))
    links = None
    while True:  # a round leaves fewer bits open: 48, 36, 27, 20; 2^16 values are below any crowd
        found = checkpointed(rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(link, "u long, v long, rest long"))
        new, crowds = found.filter("rest is null").select("u", "v"), found.filter("rest is not null")
        links = new if links is None else links.unionByName(new)
        if crowds.isEmpty():
            return links.distinct()
        rows = crowds.select(F.col("u").alias("key"), F.col("v").alias("fp"), "rest").distinct()


# ---------------------------------------------------------------------------------------------- components
def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for every node that has a link (u > v or any order)."""
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = checkpointed(edges), None
    for _ in range(max_rounds):
        # large star: the larger neighbours of a node go to the smallest of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # tables of their own: then both sides of a join are plain shuffles, and Spark can split the rows of a hub
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = checkpointed(large)
        # small star: the smaller neighbours and the node itself go to the smallest
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = checkpointed(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = checkpointed(simhash(df, id_col, text_col, shingle))
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(each, radius))
    linked = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = checkpointed(linked)
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(ids, "root").select("fp", "component_id")
    out = prints.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9(spark, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
