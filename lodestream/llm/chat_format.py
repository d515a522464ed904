r"""Relational chat formatting with Spark expressions only.

Each conversation's turns are collected as structs and sorted; each run of turns of one role is merged into a block by
aggregating its part of the array, and the pieces are concatenated::

    ### role: text</turn>\n            one turn
    ### role: text<+>text</turn>\n     adjacent turns of the same role, merged

Inside roles and texts a backslash is written ``\b``, ``#`` is ``\h``, ``<`` is ``\l`` and, in roles,
``:`` is ``\c``. So ``### ``, ``</turn>`` and ``<+>`` can't occur in a text, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import read

END, JOINT = "</turn>\n", "<+>"


def _replaced(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _replaced(c, (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")))


def unescape(c: Column) -> Column:
    """The backslash comes last: no earlier replacement can have produced ``\\b``."""
    return _replaced(c, (("\\c", ":"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\")))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments array<struct<text, loss>>.

    ``formatted`` is the concatenation of the segments; ``loss`` marks the text of ``learn`` turns alone,
    without headers, joints and ends. Turns come by (turn, role, text) as they are before escaping, a null turn first, so ties
    are settled and repeated rows stay. A null text or role is empty. Rows with a null conv_id can't be told to belong together:
    each is a conversation of its own, so they are no hot key. An empty table gives no rows, extra columns
    are ignored. A conversation is one string by definition, so it must fit a task; nothing else is gathered.
    """
    said = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    ordered = said.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    first = lambda i: (i == 1) | (F.get("turns", i - 2)["role"] != F.get("turns", i - 1)["role"])
    starts = ordered.withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("turns")), first))

    def block(start: Column, k: Column) -> Column:
        """A run of turns of one role, merged: its role and the array of its texts."""
        end = F.coalesce(F.get("starts", k + 1), F.size("turns") + 1)
        said = F.get("turns", start - 1)["role"]
        return F.struct(said.alias("role"), F.transform(F.slice("turns", start, end - start), lambda t: escape(t["text"])).alias("texts"))

    def segments(b: Column) -> Column:
        plain = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
        head = F.concat(F.lit("### "), F.replace(escape(b["role"]), F.lit(":"), F.lit("\\c")), F.lit(": "))
        texts = F.transform(b["texts"], lambda t, i: F.array(plain(F.when(i > 0, F.lit(JOINT)).otherwise(F.lit(""))), F.struct(t.alias("text"), (b["role"] == learn).alias("loss"))))
        return F.concat(F.array(plain(head)), F.flatten(texts), F.array(plain(F.lit(END))))

    blocks = starts.select("conv_id", F.transform("starts", block).alias("blocks"))
    out = blocks.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, END), lambda b: F.startswith(b, F.lit("### ")))

    def turns(block: Column) -> Column:
        body = F.substring(block, F.lit(5), F.length(block))
        at = F.locate(": ", body)
        texts = F.split(F.substring(body, at + 2, F.length(body)), r"<\+>", -1)
        return F.transform(texts, lambda t: F.struct(unescape(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoof = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", spoof), (-7, 1, "assistant", spoof)], "conv_id bigint, turn bigint, role string, text string")
    out = format_conversations(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    out = out.select(
        "conv_id",
        "formatted",
        read_back(F.col("formatted")).alias("turns"),
        unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', NULL
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', NULL
), near AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
         length(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l')) AS n_text,
         length(replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c')) AS n_role
  FROM said WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n_text + CASE WHEN before = role THEN 3 ELSE 6 + n_role END + CASE WHEN after = role THEN 0 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM near GROUP BY conv_id, alone
"""
