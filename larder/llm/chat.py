"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example holds all turns before the target as context and only the target's text under the loss mask,
given as ``loss_start`` and ``loss_end`` in code points of the formatted text. Turns after the last assistant
turn are no context of any reply; they close a last example without a target, so no turn is lost.

A turn is written ``<turn ROLE>``, a new line, its text, ``</turn>`` and a new line. In roles and texts a
backslash is doubled and a ``<`` becomes ``<`` and a backslash, so no marker can occur inside them; in roles
``>`` becomes a backslash and ``g``, and a new line a backslash and ``n``. All of it is undone on reading.

Defined cases: null text and null role count as empty; equal turn numbers are ordered by role, then text;
a null turn number comes first; conversations with a null id form one conversation; no assistant turn
gives one example without a target; texts of any length are kept whole; an empty table gives no example; other
columns than the four named ones are not read. A conversation's turns are gathered into one row, as its prefixes are
its output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
CLOSE = "</turn>\n"
UNESCAPE = r"(<)\\|\\(\\)"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Doubled backslashes are set aside first, so that the letters after them stay letters.
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\g"), F.lit(">")), F.lit("<\\"), F.lit("<")))
    return F.array_join(parts, "\\")


def examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (from 1), formatted, loss_start and loss_end (null without a target)."""
    own_role, own_text = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    head = F.concat(F.lit("<turn "), escape_role(own_role), F.lit(">\n"))
    lines = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.struct(
        F.col(f"`{turn}`").alias("turn"), own_role.alias("role"), own_text.alias("text"), F.concat(head, escape(own_text), F.lit(CLOSE)).alias("line"),
        F.char_length(head).alias("head")).alias("t"))
    told = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).withColumn("n", F.size("t"))
    last = lambda x, i: (x["role"] == ASSISTANT) | (i == F.col("n") - 1)
    ends = F.filter(F.transform("t", lambda x, i: F.when(last(x, i), i + 1)), lambda i: i.isNotNull())
    each = told.select("conv_id", "t", F.posexplode(ends).alias("k", "end"))
    target = F.get("t", F.col("end") - 1)
    formatted = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("end")), lambda x: x["line"]), "")
    each = each.select("conv_id", (F.col("k") + 1).alias("example"), formatted.alias("formatted"), target.alias("target"))
    size = F.char_length("formatted")
    start = size - F.char_length(F.col("target.line")) + F.col("target.head")
    replied = F.col("target.role") == ASSISTANT
    return each.select("conv_id", "example", "formatted", F.when(replied, start).alias("loss_start"), F.when(replied, size - len(CLOSE)).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted example."""
    lines = F.filter(F.split(formatted, CLOSE), lambda line: line != "")
    end = lambda line: F.instr(line, ">\n")
    return F.transform(lines, lambda line: F.struct(
        unescape_role(F.substring(line, F.lit(7), end(line) - 7)).alias("role"), unescape(F.substring(line, end(line) + 2, F.char_length(line))).alias("text")))


def digest(written: DataFrame) -> DataFrame:
    """One row per conversation, from its examples alone."""
    masked = F.when(F.col("loss_start").isNotNull(), unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    slim = written.select("conv_id", "example", F.char_length("formatted").cast("long").alias("chars"), masked.alias("loss"), "formatted")
    whole = slim.groupBy("conv_id").agg(F.max("example").alias("example"), F.sum("chars").alias("formatted_chars"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("loss"))
    # The last example has every turn; only its text is needed whole.
    widest = slim.select(F.col("conv_id").alias("id"), F.col("example").alias("k"), "formatted").join(whole, F.col("id").eqNullSafe(F.col("conv_id")) & (F.col("k") == F.col("example")))
    told = widest.withColumn("told", read_turns(F.col("formatted")))
    joined = F.array_join(F.transform("told", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id", F.size("told").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
