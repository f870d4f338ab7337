"""The whole pipeline against plain versions of its stages."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmap.llm import tokenizer

from .test_native_operators import LOW, plain_rules, plain_targets
from .test_simhash import plain_print

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")


def plain_quality(rows):
    """rows: (doc_id, text, source). Lines in over a tenth, and over 20, of a source's distinct texts go."""
    texts, holders = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        texts[s].add(t or "")
        for line in (t or "").split("\n"):
            if normal(line):
                holders[s, normal(line)].add(t or "")
    gone = {k for k, v in holders.items() if len(v) > 20 and len(v) > 0.1 * len(texts[k[0]])}
    out = []
    for i, t, s in rows:
        n, chars, *_, failed = plain_rules(t)
        lines = (t or "").split("\n")
        lost = min(chars, sum(len(normal(x).replace(" ", "")) for x in lines if (s, normal(x)) in gone))
        if not failed and not (chars and chars - lost < 0.1 * chars):
            out.append((i, "\n".join(x for x in lines if (s, normal(x)) not in gone) if lost else t, s))
    return out


def plain_exact(rows):
    best = {}
    for i, t, s in rows:
        key = (t or "").translate(LOW)
        if key not in best or i < best[key][0]:
            best[key] = (i, t, s)
    return list(best.values())


def plain_near(rows):
    prints = [plain_print(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    first = {}
    for k, row in enumerate(rows):
        if label[k] not in first or row[0] < first[label[k]][0]:
            first[label[k]] = row
    return list(first.values())


def plain_mix(rows):
    size = {i: len(WORDS.findall(t or "")) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
    targets, out = plain_targets({s: sizes[s] for s in {s for _, _, s in rows}}, (5, 2, 1), 1.5, 2.0), []
    for source in targets:
        own = sorted((r for r in rows if r[2] == source), key=lambda r: hashlib.md5(f"11:{r[0]}".encode()).hexdigest())
        whole = int(targets[source] // sizes[source]) if sizes[source] else 0
        rest = int(targets[source] - whole * sizes[source] + 0.5)
        for r in own:
            part = max(0, min(size[r[0]], rest))
            rest -= size[r[0]]
            times = whole + (part == size[r[0]] and part > 0) + (0 < part < size[r[0]] and 2 * part >= size[r[0]])
            out += [r] * times
    return out


def plain_pieces(rows):
    """(doc_id, piece, start, length, crc) of each row; the first piece has what is over."""
    library, out = tokenizer.Vocabulary(), []
    for i, t, _ in rows:
        ids = library.library_ids([t or ""])[0] + [2]
        first = (len(ids) - 1) % 1024 + 1
        for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if piece == 0 else start + 1024]
            out.append((i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(31)
    words = [f"w{k}é"[: 2 + k % 4] + str(k) for k in range(900)]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(n))
    rows = []
    for i in range(170):
        source = rng.choice(["a", "b", "c", "d"])
        body = text(rng.randint(1, 40))
        rows.append((i, (f"Menu |  of  {source}\n" if source in "ab" else "") + body, source))
    rows += [(200 + i, rows[i][1].upper() if i % 2 else rows[i][1], "b") for i in range(15)]
    rows += [(300 + i, rows[30 + i][1] + " ", "c") for i in range(10)]  # near: other texts, the same words
    rows += [(330, "short", "a"), (331, "again " * 90, "a"), (332, "", "d"), (333, None, None), (334, text(120), None)]
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    want, docs = rows, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, ((_, stage), plain) in enumerate(zip(pipeline.STAGES[:4], [plain_quality, plain_exact, plain_near, plain_mix])):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs, before = spark.read.parquet(str(tmp_path / f"stage{k}")), len(want)
        want = plain(want)
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in docs.collect()) == Counter(want), stage
        assert len(want) != before  # each stage decides something here
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == Counter(plain_pieces(want))
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 1024
