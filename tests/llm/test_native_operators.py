"""Exact dedup, quality rules, chat formatting, mixing and the pipeline against plain versions, on awkward inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmap.llm import chat_format, exact_dedup, mixing, quality_rules

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Rows of (doc_id, text, source) with columns whose names clash with results."""
    return spark.createDataFrame([(t, i, s, 1, "k") for i, t, s in rows], "text string, doc_id long, source string, size int, kept string")


# ------------------------------------------------------------------------------------------------ exact dedup
@pytest.mark.parametrize("keep,hot_rows", [("smallest", 1000), ("largest", 1000), ("smallest", 3), ("largest", 3)])
def test_exact_dedup(spark, keep, hot_rows):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Hello", "hELLO", "É", "é", "", None, "x" * 5000, "tail " + str(i)]), "s") for i in range(200)]
    rows += [(5, "twice", "s"), (5, "twice", "s"), (None, "Hello", "s"), (None, "alone", "s")]
    out = exact_dedup.exact_dedup(docs(spark, rows), keep=keep, hot_rows=hot_rows)
    assert out.columns == ["text", "doc_id", "source", "size", "keep_id", "group_size", "kept", "text_sha256"]
    got = out.collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOW)].append(i)
    assert len(got) == len(rows)
    for r in got:
        norm = (r["text"] or "").translate(LOW)
        ids = groups[norm]
        known = [i for i in ids if i is not None]
        best = (None if None in ids else min(ids)) if keep == "smallest" else (max(known) if known else None)
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (best, len(ids), hashlib.sha256(norm.encode()).hexdigest())
    stays = Counter((r["text"] or "").translate(LOW) for r in got if r["kept"])
    assert stays == Counter(groups.keys())  # one of each group
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(docs(spark, [])).collect() == []


# ------------------------------------------------------------------------------------------------ quality rules
def plain_rules(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_quality_rules(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdé#|", k=rng.randint(1, 6)))
    rows = [(None, None, None), (1, "", "h"), (2, " \t\n", "h"), (3, "a b c d e f g h " * 30, "h"), (3, "a b c d e f g h " * 30, "h")]
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(1, 15))) for _ in range(rng.randint(1, 12))]
        parts += rng.choices(parts, k=rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((10 + i, rng.choice(["\n", "\x0b", "\n\n"]).join(parts), rng.choice(["h", None])))
    footer = "Home | About | Contact | " + "legal " * 30
    rows += [(100 + i, footer + ("\n" + " ".join(word() for _ in range(200)) if i % 2 else f"\n{word()} {i}"), "hot") for i in range(60)]
    got = quality_rules.quality_rules(docs(spark, rows), max_share=0.1, min_documents=20).collect()
    assert len(got) == len(rows)
    for r in got:
        figures = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert figures == plain_rules(r["text"]), r["text"]
    verdict = {r["doc_id"]: r["kept"] for r in got if (r["doc_id"] or 0) >= 100}
    assert all(verdict[100 + i] == (i % 2 == 1) for i in range(60))
    # a filter on the verdict gives the same rows
    assert sorted(str(r["doc_id"]) for r in got if r["kept"]) == sorted(str(r["doc_id"]) for r in quality_rules.quality_rules(docs(spark, rows), max_share=0.1, min_documents=20).filter("kept").collect())
    assert quality_rules.quality_rules(docs(spark, [])).collect() == []


def test_copies_do_not_make_a_line_frequent(spark):
    text = "\n".join(f"this is line {k} of a document that has many exact copies" for k in range(5))
    got = quality_rules.quality_rules(docs(spark, [(i, text, "h") for i in range(100)])).collect()
    assert not any(r["depleted"] for r in got)


def with_footer(n=40):
    """(doc_id, text, source) with a line of their host in each text, and the texts without it."""
    rng = random.Random(8)
    footer = "Home | About  us | Contact"
    bodies = ["\n".join(" ".join(f"w{rng.randrange(9999)}" for _ in range(20)) for _ in range(4)) for _ in range(n)]
    return [(i, f"{footer}\n{b}\n{footer.upper()}", "hot") for i, b in enumerate(bodies)], bodies


def test_lines_over_the_limit_leave_the_text(spark):
    rows, bodies = with_footer()
    rows += [(100, "Home | About us | Contact\n\n" + " ".join(f"w{k}" for k in range(30)), "cold"), (101, None, "hot")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert [got[i]["cleaned_text"] for i in range(40)] == bodies
    assert all(got[i]["text"] == rows[i][1] and got[i]["kept"] for i in range(40))
    assert got[100]["cleaned_text"] == got[100]["text"] and got[101]["cleaned_text"] is None
    pipeline = pytest.importorskip("corpus_pipeline")
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r for r in pipeline.quality(spark, frame, "").collect()}
    assert [kept[i]["text"] for i in range(40)] == bodies and set(kept) == {*range(40)} | {100}
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())


def test_repeated_rows_are_not_charged_for_each_other(spark):
    rows, _ = with_footer()
    once = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert all(r["kept"] and 0 < r["removed_chars"] < 0.5 * r["word_chars"] for r in once.values())
    more = rows + [rows[0]] * 30 + [(None, rows[1][1], "hot")] * 30
    for r in quality_rules.quality_rules(docs(spark, more)).collect():
        first = once[1 if r["doc_id"] is None else r["doc_id"]]
        assert (r["kept"], r["removed_chars"], r["cleaned_text"]) == (True, first["removed_chars"], first["cleaned_text"])


# ------------------------------------------------------------------------------------------------ chat
def test_chat_format(spark):
    rng = random.Random(3)
    parts = ["<|", "\\", "|>", "<|end|>", "<|text|>", "\n", "é", "a", "<", "|", "</s>[INST]"]
    text = lambda: rng.choice([None, "".join(rng.choices(parts, k=rng.randint(0, 9)))])
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "we<|ird"]), text(), 7))
    rows += [(1, 0, "assistant", "tie", 7), (1, None, "user", "first", 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    examples = chat_format.chat_examples(df)
    got = {r["conv_id"]: r for r in chat_format.read_back(examples).collect()}
    convs = defaultdict(list)
    for conv, turn, role, said, _ in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", said or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        turns.sort()
        everything = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256(everything.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    per = Counter(r["conv_id"] for r in examples.filter("target_turn is not null").collect())
    assert all(per[conv] == sum(r == "assistant" for _, _, r, _ in turns) for conv, turns in convs.items())
    assert chat_format.read_back(chat_format.chat_examples(df.limit(0))).collect() == []


# ------------------------------------------------------------------------------------------------ mixing
def plain_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("keep_columns", [True, False])
def test_mixing(spark, keep_columns):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 50), rng.choice(["a", "b", "c", "é", None, "a"])) for i in range(400)]
    rows += [(None, None, "empty"), (7, "again again", "b"), (7, "again again", "b"), (1000, "big " * 5000, "one")]
    out = mixing.mix_sources(docs(spark, rows), keep_columns=keep_columns).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    expect = plain_targets({s: sizes[s] for s in {s for _, _, s in rows}}, mixing.WEIGHTS, 1.5, 2.0)
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
        assert abs(r["target"] - expect[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] + r["part_words"] <= 2 * r["size"]
    assert all(abs(taken[s] - expect[s]) <= 0.5 + 1e-6 for s in expect)
    again = mixing.mix_sources(docs(spark, rows).repartition(7), keep_columns=keep_columns).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mix_sources(docs(spark, []), keep_columns=keep_columns).collect() == []


# ------------------------------------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    good = [" ".join(rng.choices(words, k=rng.randint(40, 120))) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)]
    rows += [(100, good[3].upper(), "en", "s0", 1), (101, "too short", "en", "s1", 2), (102, "again " * 200, "en", "s1", 2), (103, None, None, None, None), (104, good[5], "en", "s2", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for k, (_, stage) in enumerate(pipeline.STAGES[:4]):
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        kept = spark.read.parquet(str(tmp_path / f"{k}"))
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append(Counter(r["doc_id"] for r in kept.collect()))
    assert set(ids[0]) == set(range(40)) | {100, 104}  # clean documents stay, copies too
    assert ids[1] == Counter(range(40)) and ids[2] == Counter(range(40))
    size = {i: len(t.split()) for i, t in enumerate(good)}
    mixed = sum(n * size[i] for i, n in ids[3].items())
    assert abs(mixed - 1.5 * sum(size.values())) <= 3 * 120 and max(ids[3].values()) <= 2
    packed = pipeline.STAGES[4][1](spark, kept, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == ids[3]
    whole = pipeline.run(spark, str(tmp_path))
    strip = lambda rs: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rs)
    assert strip(whole.collect()) == strip(packed)


def test_near_dedup_goes_by_row(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(300))
    near = lambda t: t + "  "  # another text with the same fingerprint
    a, b, c, d, e, f, g = (text() for _ in range(7))
    rows = [(5, a), (None, near(a)), (None, b), (None, c)]  # b and c are clean, and have no id
    rows += [(1, d), (7, near(d)), (7, e)]  # e is clean, and shares its id
    rows += [(None, f), (None, near(f))]  # a group of null ids
    rows += [(3, g), (3, near(g)), (3, near(near(g))), (4, g + "\n")]  # the smallest id sits on several rows
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"].strip()) for r in pipeline.near(spark, frame.repartition(3), "").collect())
    assert got == Counter([(5, a), (None, b), (None, c), (1, d), (7, e), (None, f), (3, g)])
    assert pipeline.near(spark, frame.limit(0), "").collect() == []
