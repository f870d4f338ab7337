"""Removal of long repeated passages by a difference-cover suffix sort.

A suffix array of all text at once would shuffle many rows per byte, so suffixes are dealt out first such that strings
that are equal for `length` bytes meet in one task, and each task sorts its suffixes by the difference-cover method:
the triples at two of three residues are sorted and named, the names are sorted by recursion, the remaining suffixes
are merged in by their first byte and the rank that follows, and neighbours are compared over `length` bytes.

Dealing out. The string of `length` bytes at a start has an anchor: the leftmost of its 64-byte substrings with the
least hash. Equal strings have equal anchors at equal places, the starts of one anchor are an interval, and on one side
of the anchor the string has enough bytes to make up a common passage of 232 bytes (for 400). Its hash is the key. Keys
that occur once hold no repeat and drop out before any text is moved. The starts of the others cover stretches of text;
equal stretches of a key are one row with a count, by aggregation before the shuffle, and only distinct stretches are
sorted. The verdicts go back to the occurrences by a join that Spark may split.

Common keys. A key with over `hot` occurrences is split into eight by the distance to the anchor, each part with a
common passage that is longer by as much. A part that still has over `hot` distinct stretches is split into single
starts, whose strings are counted by a digest of their `length` bytes, with aggregation before the shuffle. So no task
sorts more than `hot` stretches of one key, however common a passage is.

Hashes of anchors and keys only deal rows out; they may collide. What is equal is decided by the sort and by comparing
bytes, or where bytes do not travel (whole texts, stretches, single strings) by 128 bits of SHA-256 or BLAKE2b.

Equal texts are one text from the start, with map-side aggregation: of a text that occurs twice every string repeats.
The text itself is shuffled once.

Defined results: null texts are empty; texts shorter than `length` lose nothing. Ids may repeat or be null; each input
row has a row. No rows give no rows. Only id and text are read. Cuts are by bytes, so what is left need not be UTF-8.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, written

LENGTH, GRAM, HOT, SPLIT = 400, 64, 512, 8
SEGMENT = 1 << 22
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------------------------------------- suffix array
def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s (positive integers below 2^20), by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    bits = max(int(t.max()).bit_length(), 1)
    if bits <= 20:
        key = (t[sample] << 2 * bits) | (t[sample + 1] << bits) | t[sample + 2]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        a = [t[sample + k][order] for k in range(3)]
        fresh = np.append(True, (a[0][1:] != a[0][:-1]) | (a[1][1:] != a[1][:-1]) | (a[2][1:] != a[2][:-1]))
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(fresh)
    if not fresh.all():
        order = suffix_array(name)
        name[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name
    sampled = sample[order]
    sampled = sampled[sampled < n]
    wide = np.int64(n + 3)
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(t[zero] * wide + rank[zero + 1], kind="stable")]
    # a remaining suffix goes after the sampled ones that are smaller: counted apart for each residue
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    below = np.searchsorted(t[first] * wide + rank[first + 1], t[zero] * wide + rank[zero + 1])
    # by two characters and a rank; the pair of characters as one name keeps the key small
    pairs = np.unique(np.concatenate([t[second] * (1 << 31) + t[second + 1], t[zero] * (1 << 31) + t[zero + 1]]), return_inverse=True)[1]
    below = below + np.searchsorted(pairs[: len(second)] * wide + rank[second + 2], pairs[len(second) :] * wide + rank[zero + 2])
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + below
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sampled
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For a mask of starts (each with `length` bytes of its own after it): which have an equal string at another one."""
    order = suffix_array(text.astype(np.int64) + 1)
    p = order[starts[order]]
    words = np.zeros(len(text), np.uint64)
    for k in range(8):
        words[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(8 * k)
    a, same = np.arange(max(len(p) - 1, 0)), np.zeros(max(len(p) - 1, 0), bool)
    for j in [*range(0, length - 7, 8), length - 8]:
        a = a[words[p[a] + j] == words[p[a + 1] + j]]
    same[a] = True
    out = np.zeros(len(text), bool)
    out[p[:-1][same]] = True
    out[p[1:][same]] = True
    return out


# ---------------------------------------------------------------------------------------------- anchors
class Anchors:
    def __init__(self, length: int = LENGTH, gram: int = GRAM, bits: int = 64):
        """bits: of the hashes that deal rows out; fewer give larger groups and the same results."""
        if length < gram + 16:
            raise ValueError(f"passages have at least {gram + 16} bytes")
        self.length, self.gram, self.window = length, gram, length - gram + 1
        self.side = (length - gram) // 2
        self.drop = np.uint64(64 - bits)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, 2 * len(self.power))
            base, inverse = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            base[0] = inverse[0] = 1
            self.power, self.inverse = np.cumprod(base), np.cumprod(inverse)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        return np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64))

    def hashes(self, sums: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
        """Mixed hash of the `size` bytes at each place."""
        if isinstance(at, slice):
            n = len(sums) - size
            h = (sums[size:] - sums[:n]) * self.inverse[:n]
        else:
            h = (sums[at + size] - sums[at]) * self.inverse[at]
        h = (h ^ (h >> np.uint64(29))) * MIX
        return (h ^ (h >> np.uint64(32))) >> self.drop << self.drop

    def keys(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """key, first start, number of starts, anchor: the starts of `data`, each in one row."""
        n = len(data) - self.length + 1
        if n < 1:
            return (np.zeros(0, np.int64),) * 4
        w = self.window
        sums = self.sums(data)
        h = self.hashes(sums, slice(None), self.gram)
        h = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        blocks = -(-len(h) // w)
        padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(h)] = h
        grid = padded.reshape(blocks, w)
        before = np.minimum.accumulate(grid, axis=1).reshape(-1)
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        anchor = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        last = np.append(first[1:], n) - 1
        p = anchor[first]
        # the starts near the anchor have the passage from it on, the others the passage up to it
        a, b = np.maximum(first, p - self.side), last
        right = a <= b
        c, d = first, np.minimum(last, p - self.side - 1)
        left = c <= d
        key = np.concatenate([self.hashes(sums, p[right], self.length - self.side), self.hashes(sums, p[left] - self.side, self.side + self.gram) ^ np.uint64(1)])
        return key.view(np.int64), np.concatenate([a[right], c[left]]), np.concatenate([(b - a)[right], (d - c)[left]]) + 1, np.concatenate([p[right], p[left]])

    def split(self, data: np.ndarray, start: int, count: int, anchor: int) -> Iterator[tuple[int, int, int]]:
        """(key, start, count) of the parts of a row of `keys`: equal distances to the anchor, longer passages."""
        step = -(-(self.window) // (2 * SPLIT))
        s = start
        while s < start + count:
            part = (anchor - s) // step
            e = min(start + count, anchor - part * step + 1)
            # the passage that all strings of this part share, wherever the part lies in other texts
            low, high = anchor - part * step, anchor - (part + 1) * step + 1
            key = hashlib.blake2b(data[low : high + self.length].tobytes(), digest_size=8, salt=part.to_bytes(2, "little")).digest()
            yield int.from_bytes(key, "little", signed=True) >> int(self.drop) << int(self.drop), s, e - s
            s = e


def digest(data: bytes) -> tuple[int, int]:
    """128 bits that stand for the bytes."""
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _segments(n: int, length: int, segment: int) -> Iterator[tuple[int, int]]:
    """Parts of a text of n bytes that have every string of `length` bytes once."""
    for a in range(0, max(n - length + 1, 0), segment):
        yield a, min(n, a + segment + length - 1)


# ---------------------------------------------------------------------------------------------- the job
CONTENT = "key long, c1 long, c2 long"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _runs(mask: np.ndarray) -> list[dict]:
    """The maximal runs of a mask, as [start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _sorted_marks(distinct: DataFrame, length: int, task_bytes: int) -> DataFrame:
    """Of distinct stretches (key, c1, c2, n, stretch): the runs of starts whose strings repeat, by sorting suffixes."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        stretches = Counter(h[0] for h in held)
        # a stretch that is all there is of its key repeats as a whole: no sort can add to that
        whole = [n > 1 and stretches[key] == 1 for key, _, _, n, _ in held]
        pieces = [h[4] for h, w in zip(held, whole) if not w]
        text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        starts = np.zeros(len(text), bool)
        at = np.cumsum([0, *(len(p) + 1 for p in pieces)])
        for place, piece in zip(at.tolist(), pieces):
            starts[place : place + len(piece) - length + 1] = True
        dup = repeated_starts(text, starts, length)
        rows, place = [], iter(at.tolist())
        for (key, c1, c2, n, stretch), w in zip(held, whole):
            count, begin = len(stretch) - length + 1, None if w else next(place)
            runs = [{"start": 0, "end": count}] if n > 1 else _runs(dup[begin : begin + count])
            if runs:
                rows.append((key, c1, c2, runs))
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*(pa.int64(),) * 3, SPANS))], names=["key", "c1", "c2", "marks"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= task_bytes and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    rows = distinct.select("key", "c1", "c2", "n", "stretch").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(sort, f"{CONTENT}, marks array<struct<start: long, end: long>>")


def _counted_marks(distinct: DataFrame, length: int) -> DataFrame:
    """The same of stretches of the commonest keys, by counting digests of all their strings."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, c1, c2, n, stretch in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(key, c1, c2, n, at, *digest(stretch[at : at + length])) for at in range(len(stretch) - length + 1)]
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["key", "c1", "c2", "n", "at", "d1", "d2"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["key", "c1", "c2", "n", "at", "d1", "d2"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for found in batch.column(3).to_pylist():
                at = np.array(found)
                mask = np.zeros(int(at.max()) + 1, bool)
                mask[at] = True
                marks.append(_runs(mask))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(marks, SPANS)], names=["key", "c1", "c2", "marks"])

    each = written(distinct.select("key", "c1", "c2", "n", "stretch").mapInArrow(strings, f"{CONTENT}, n long, at long, d1 long, d2 long"))
    again = written(each.groupBy("d1", "d2").agg(F.sum("n").alias("_n")).filter("_n > 1").select("d1", "d2"))
    places = each.join(again, ["d1", "d2"]).groupBy("key", "c1", "c2").agg(F.collect_list("at").alias("at"))
    return places.mapInArrow(runs, f"{CONTENT}, marks array<struct<start: long, end: long>>")


def repeated_passages(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, task_bytes: int = 2_000_000, bits: int = 64,
    segment: int = SEGMENT,
) -> DataFrame:
    """doc_id, n_bytes, spans (removed [start, end) of bytes, in order), kept_sha256 of every row.

    hot: stretches of one key that one task sorts; bits: of the hashes that deal rows out; segment: bytes
    of a text that are hashed at a time. None changes results.
    """
    sha = F.sha2("_t", 256)
    half = lambda k: F.conv(F.substring(sha, k, 16), 16, -10).cast("long")
    data = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), data.alias("_t")).select("doc_id", "_t", half(1).alias("t1"), half(17).alias("t2"))
    texts = rows.groupBy("t1", "t2").agg(F.count("*").alias("times"), F.first("_t").alias("data"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(length, bits=bits)
        for batch in batches:
            parts = []
            for k, x in enumerate(batch.column(2)):
                whole = np.frombuffer(x.as_py(), np.uint8)
                for a, b in _segments(len(whole), length, segment):
                    key, start, count, anchor = find.keys(whole[a:b])
                    parts.append((key, np.full(len(key), k), start + a, count, anchor + a))
            if parts:
                key, row, start, count, anchor = (np.concatenate(c) for c in zip(*parts))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(count), pa.array(anchor)], names=["key", "t1", "t2", "start", "count", "anchor"])

    found = written(texts.select("t1", "t2", "data").mapInArrow(anchors, "key long, t1 long, t2 long, start long, count long, anchor long"))
    # a table of its own, so that both sides of the join are plain shuffles and Spark can split the rows of a common key
    often = written(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    again = found.join(often, "key").groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "start", "count", "anchor", (F.col("n") > hot).alias("hot"))).alias("rows"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(length, bits=bits)
        kinds = (*(pa.int64(),) * 6, pa.binary())
        for batch in batches:
            out, sent = [], set()
            for t1_, t2_, data_, rows_ in zip(*(batch.column(k) for k in (0, 1, 3, 4))):
                whole, t1, t2 = data_.as_py(), t1_.as_py(), t2_.as_py()
                array = np.frombuffer(whole, np.uint8)
                for r in rows_.as_py():
                    parts = find.split(array, r["start"], r["count"], r["anchor"]) if r["hot"] else [(r["key"], r["start"], r["count"])]
                    for key, start, count in parts:
                        stretch = whole[start : start + count + length - 1]
                        content = (key, *digest(stretch))
                        out.append((*content, t1, t2, start, None if content in sent else stretch))
                        sent.add(content)
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "c1", "c2", "t1", "t2", "start", "stretch"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "c1", "c2", "t1", "t2", "start", "stretch"])

    # `times` goes along unread: with the same columns as below, Spark shuffles the texts once for both
    dealt = written(texts.join(again, ["t1", "t2"]).select("t1", "t2", "times", "data", "rows").mapInArrow(
        stretches, f"{CONTENT}, t1 long, t2 long, start long, stretch binary"))
    distinct = dealt.groupBy("key", "c1", "c2").agg(F.count("*").alias("n"), F.first("stretch", ignorenulls=True).alias("stretch"))
    crowded = written(dealt.select("key", "c1", "c2").distinct().groupBy("key").agg(F.count("*").alias("_m")).filter(F.col("_m") > hot).select("key"))
    if crowded.isEmpty():
        marks = _sorted_marks(distinct, length, task_bytes)
    else:
        distinct = written(distinct)
        marks = _sorted_marks(distinct.join(crowded, "key", "left_anti"), length, task_bytes)
        marks = marks.unionByName(_counted_marks(distinct.join(crowded, "key", "left_semi"), length))
    spans = (
        dealt.select("key", "c1", "c2", "t1", "t2", "start").join(marks, ["key", "c1", "c2"])
        .select("t1", "t2", F.explode(F.transform("marks", lambda m: F.struct((F.col("start") + m["start"]).alias("start"), (F.col("start") + m["end"] + (length - 1)).alias("end")))).alias("span"))
        .groupBy("t1", "t2").agg(F.collect_list("span").alias("spans"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for times, data_, spans_ in zip(*(batch.column(k) for k in (2, 3, 4))):
                whole, removed = data_.as_py(), []
                if times.as_py() > 1 and len(whole) >= length:
                    removed = [[0, len(whole)]]
                else:
                    for a, b in sorted((x["start"], x["end"]) for x in spans_.as_py() or []):
                        if removed and a <= removed[-1][1]:
                            removed[-1][1] = max(b, removed[-1][1])
                        else:
                            removed.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in removed:
                    digest.update(whole[at:a])
                    at = b
                digest.update(whole[at:])
                out.append((len(whole), [{"start": a, "end": b} for a, b in removed], digest.hexdigest()))
            cols = list(zip(*out)) if out else [()] * 3
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["t1", "t2", "n_bytes", "spans", "kept_sha256"])

    done = texts.join(spans, ["t1", "t2"], "left").select("t1", "t2", "times", "data", "spans").mapInArrow(
        cut, "t1 long, t2 long, n_bytes long, spans array<struct<start: long, end: long>>, kept_sha256 string")
    return rows.select("doc_id", "t1", "t2").join(done, ["t1", "t2"]).select("doc_id", "n_bytes", "spans", "kept_sha256")


def op3(spark, sf_dir: str) -> DataFrame:
    out = repeated_passages(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
