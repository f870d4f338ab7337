"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns up to it are rendered, and only its text is trainable.
Turns after the last assistant turn (or a conversation without one) would appear in no example, so one more example
without a target carries them; the last example of a conversation therefore holds all its turns.

Template, a turn: ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. Inside roles and texts each backslash is doubled and
then ``<|`` becomes ``<\\|``, so that no control string survives inside a text, and the two steps undone in reverse order
give the text back, whatever it holds.

Everything is built-in column expressions: one shuffle by conversation, and the digests that are read back group by the
same key without another one.

Defined results: null roles, texts and ids count as empty, empty and one conversation of their own. Turns with the same
number are ordered by role, then text; null turn numbers come first. Repeated rows are repeated turns. No rows give no
rows. Other input columns are dropped, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def render(turns: Column) -> Column:
    """Turns (an array of structs with role and text) in the template."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))))


def chat_examples(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, example (from 0), target_turn (position of the trained turn, null without one), formatted,
    loss_start and loss_end (code points of `formatted`, end exclusive; null without a target)."""
    named = lambda c: F.col(f"`{c}`")
    conversations = (
        df.select(
            named(conv_col).alias("conv_id"),
            F.struct(
                named(turn_col).alias("turn"),
                F.coalesce(named(role_col), F.lit("")).alias("role"),
                F.coalesce(named(text_col), F.lit("")).alias("text"),
            ).alias("_turn"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    )
    last = F.size("_turns") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("_turns", i)["role"] == TARGET_ROLE)
    untrained = F.get("_turns", last)["role"] != TARGET_ROLE
    spans = (
        conversations.withColumn("_targets", targets)
        .withColumn("_targets", F.when(untrained, F.concat("_targets", F.array(F.lit(None).cast("int")))).otherwise(F.col("_targets")))
        .select("conv_id", "_turns", F.posexplode("_targets").alias("example", "target_turn"))
        .withColumn("_upto", F.coalesce(F.col("target_turn"), F.size("_turns") - 1))
        .withColumn("formatted", render(F.slice("_turns", F.lit(1), F.col("_upto") + 1)))
    )
    end = F.length("formatted") - len(END)
    start = end - F.length(escape(F.get("_turns", F.col("_upto"))["text"]))
    trained = F.col("target_turn").isNotNull()
    return spans.select(
        "conv_id", "example", "target_turn", "formatted",
        F.when(trained, start).alias("loss_start"), F.when(trained, end).alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say: its turns, its trained text and how much was rendered."""
    trained = F.when(
        F.col("loss_start").isNotNull(),
        unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))),
    )
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("_all"),
        F.sort_array(F.collect_list(F.struct("example", trained.alias("text")))).alias("_loss"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    rendered = F.slice(F.split("_all", r"<\|end\|>"), F.lit(1), F.size(F.split("_all", r"<\|end\|>")) - 1)
    parts = lambda t: F.split(F.substring(t, len(TURN) + 1, F.lit(2**31 - 1)), r"<\|text\|>")
    said = F.concat_ws("", F.transform(rendered, lambda t: F.concat(unescape(F.get(parts(t), F.lit(0))), F.lit("\n"), unescape(F.get(parts(t), F.lit(1))), F.lit("\n"))))
    loss = F.concat_ws("", F.transform("_loss", lambda x: F.coalesce(x["text"], F.lit(""))))
    return per.select(
        "conv_id",
        F.size(rendered).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(extra).alias("text"),
    )
    return read_back(chat_examples(rows.unionByName(more)))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
             count(*) OVER (PARTITION BY conv_id) AS n,
             length('<|turn|><|text|><|end|>')
             + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars
      FROM c),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY p) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR p = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
