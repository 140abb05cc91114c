"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns up to it are the text, and
only its reply is under the loss mask. Turns behind the last assistant turn make
one more example without a target, so that no turn is lost.

A turn is written ``<|turn|>role``, line feed, text, ``<|end|>``, line feed. Inside
texts and roles ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``; in roles a line
feed becomes ``&#10;``. So no text can hold a marker, and reading back is exact.

Defined results: null text and null role count as empty; turns are ordered by
turn, role, text (null turn first), so ties and repeated rows are kept in a fixed
order; a null conv_id is a conversation of its own; further columns are ignored.
An empty table gives no rows. The text of examples grows with the square of a
conversation's length, as the method has it; each is made and passed on alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def expand(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Examples: conv_id, example (from 0), text, loss_start (code points before the reply), loss_chars (0: no target)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    last = F.size("ts")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (F.element_at("ts", i)["role"] == target_role) | (i == last))
    parts = whole.select("conv_id", "ts", F.posexplode(ends).alias("example", "upto"))
    before = F.aggregate(F.slice("ts", 1, F.col("upto") - 1), F.lit(0), lambda n, t: n + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE))
    reply = F.element_at("ts", F.col("upto"))
    is_target = reply["role"] == target_role
    return parts.select(
        "conv_id",
        "example",
        F.concat_ws("", F.transform(F.slice("ts", 1, F.col("upto")), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))).alias("text"),
        F.when(is_target, before + F.length(reply["head"])).cast("long").alias("loss_start"),
        F.when(is_target, F.length(reply["body"])).otherwise(0).cast("long").alias("loss_chars"),
    )


def parse(text: Column) -> Column:
    """Turns of a formatted text, as an array of (role, text)."""
    cut = F.split(text, r"<\|end\|>\n", -1)
    return F.transform(
        F.slice(cut, 1, F.size(cut) - 1),
        lambda s: F.struct(
            unescape(F.substring_index(F.substr(s, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(s, F.instr(s, "\n") + 1)).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """What the formatted examples say of each conversation, read back from them alone."""
    reply = F.when(F.col("loss_start").isNotNull(), unescape(F.substr("text", F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int"))))
    by = examples.select("conv_id", "example", "text", reply.alias("reply")).groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    trained = F.concat_ws("", F.transform("replies", lambda r: F.coalesce(r["reply"], F.lit(""))))
    read = by.select("conv_id", parse(F.col("longest")).alias("ts"), trained.alias("trained"), "formatted_chars")
    said = F.concat_ws("", F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, 17 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;'))
    + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS n FROM t
), w AS (
  SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS size,
    sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
  FROM f WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY i)) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR i = size THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""
