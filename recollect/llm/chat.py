"""Chat formatting with a grammar round trip, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A turn is OPEN role newline text CLOSE.
OPEN, CLOSE = "<s>", "</s>"


def escape(c: Column) -> Column:
    """Without ``<`` and newline; each backslash starts a code, so that it can be undone."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("\n"), F.lit("\\n"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """The deterministic parser: array of (role, text) of a rendered conversation."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substr(part, F.length(role) + 2)
        return F.struct(unescape(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"), unescape(text).alias("text"))

    return F.transform(F.filter(F.split(formatted, CLOSE), lambda part: part.startswith(OPEN)), turn)


def survives(role: Column, text: Column, source_role: Column, source_text: Column) -> Column:
    """Whether the rendered turn is read back as this one turn."""
    whole = render(role, text)
    return (F.size(F.split(whole, CLOSE)) == 2) & (parse(whole) == F.array(F.struct(source_role.alias("role"), source_text.alias("text"))))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask, loss_spans, round_trip from rows (conv_id, turn, role, text).

    Each turn is rendered as it is, read back by the parser and compared; a role or text that doesn't come back is
    escaped and rendered again, and then always does. loss_mask says for each turn whether it counts for the loss
    (those of the assistant); loss_spans gives the places of their (possibly escaped) texts in ``formatted``, in code
    points. round_trip compares the parsed conversation with its source.

    Turns go by turn, then role, then text; equal rows stay as many turns. Null roles and texts are empty strings;
    rows with a null conv_id are one conversation, null turns come first. A conversation is one string in the end, so
    its turns meet in one row; turns are rendered and checked before that. Other columns are ignored.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    as_is = F.struct(role.alias("role"), text.alias("text"))
    escaped = F.struct(escape(role).alias("role"), escape(text).alias("text"))
    t = t.withColumn("written", F.when(survives(role, text, role, text), as_is).otherwise(escaped))
    t = t.withColumn("rendered", render(F.col("written.role"), F.col("written.text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("rendered")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before + len(OPEN) + F.length("written.role") + 1
    t = t.select("conv_id", F.struct("turn", "role", "text", "rendered", F.row_number().over(order).alias("at"),
                                     start.alias("start"), F.length("written.text").alias("length")).alias("t"))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("t.at"), F.col("t")))).alias("ts"))
    said = F.transform("ts", lambda x: F.struct(x["t"]["role"].alias("role"), x["t"]["text"].alias("text")))
    c = c.select("conv_id", F.array_join(F.transform("ts", lambda x: x["t"]["rendered"]), "").alias("formatted"),
                 F.transform("ts", lambda x: x["t"]["role"] == "assistant").alias("loss_mask"),
                 F.transform(F.filter("ts", lambda x: x["t"]["role"] == "assistant"), lambda x: F.struct(x["t"]["start"].alias("start"), x["t"]["length"].alias("length"))).alias("loss_spans"),
                 said.alias("said"))
    return c.select("conv_id", "formatted", "loss_mask", "loss_spans", (parse(F.col("formatted")) == F.col("said")).alias("round_trip"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from ``formatted`` and ``loss_mask``."""
    c = chats.select("conv_id", "formatted", "loss_mask", parse(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter(F.arrays_zip("turns", F.col("loss_mask").alias("loss")), lambda x: x["loss"]), lambda x: x["turns"]["text"]), "")
    c = c.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.length("formatted").cast("long").alias("formatted_chars"), loss.alias("loss"),
                 F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"))
    return c.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
