"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as one string by the grammar

    conversation = *turn          turn = "### " role ": " text NEWLINE "</turn>" NEWLINE

Inside a role, backslash, colon and newline are escaped. An escaped text has one more backslash in front of each
control string ("### ", letters, ": ", or "</turn>") than the text itself, so it holds no bare control string and
the added backslash can be taken away again. A whole conversation is rendered plain first and read back by the
deterministic parser, for which a bare control string inside a text is an error. Turns that don't come back as
they were are escaped, and the conversation is rendered and read once more, at last with every turn escaped. A
conversation that even then isn't identical raises an error; none is passed on unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\n</turn>\n"
#: A control string with the backslashes in front of it.
CONTROL = r"(\\*)(### [A-Za-z]{1,20}: |</turn>)"
ESCAPED = r"\\(\\*)(### [A-Za-z]{1,20}: |</turn>)"
BARE = r"(?<!\\)(### [A-Za-z]{1,20}: |</turn>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"\\$1$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2"))


def _role_out(role: Column) -> Column:
    title = F.concat(F.upper(F.substring(role, 1, 1)), F.substring(role, 2, 1 << 30))
    # Names whose first letter doesn't come back from upper case are marked and stay as they are.
    plain = F.concat(F.lower(F.substring(title, 1, 1)), F.substring(title, 2, 1 << 30)) == role
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))
    return F.when(plain, safe(title)).otherwise(F.concat(F.lit("\\="), safe(role)))


def _role_in(shown: Column) -> Column:
    marked = shown.startswith("\\=")
    body = F.when(marked, F.substring(shown, 3, 1 << 30)).otherwise(shown)
    # A doubled backslash is set aside as U+0001, which is escaped by itself first.
    body = F.replace(F.replace(body, F.lit("\u0001"), F.lit("\u0001e")), F.lit("\\\\"), F.lit("\u0001s"))
    body = F.replace(F.replace(body, F.lit("\\c"), F.lit(":")), F.lit("\\n"), F.lit("\n"))
    body = F.replace(F.replace(body, F.lit("\u0001s"), F.lit("\\")), F.lit("\u0001e"), F.lit("\u0001"))
    return F.when(marked, body).otherwise(F.concat(F.lower(F.substring(body, 1, 1)), F.substring(body, 2, 1 << 30)))


def _head(role: Column) -> Column:
    return F.concat(F.lit("### "), _role_out(role), F.lit(": "))


def parse_turn(turn: Column) -> tuple[Column, Column]:
    """(role, text) of what stands before an end mark; a text with a bare control string is null, as the grammar has none."""
    at = F.instr(turn, ": ")
    text = F.substring(turn, at + 2, F.lit(1 << 30))
    return _role_in(F.substring(turn, F.lit(5), at - 5)), F.when(~text.rlike(BARE), unescape(text))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation as array<struct<role, text>>."""
    turns = F.split(formatted, F.lit(r"\n</turn>\n"))
    turns = F.slice(turns, F.lit(1), F.greatest(F.lit(0), F.size(turns) - 1))

    def one(t: Column) -> Column:
        role, text = parse_turn(t)
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(turns, one)


def _shown(turn: Column, escaped: Column) -> Column:
    return F.concat(_head(turn["role"]), F.when(escaped, escape(turn["text"])).otherwise(turn["text"]))


def settle(d: DataFrame) -> DataFrame:
    """d (turns array<struct<role, text>>) with escaped array<boolean> and formatted, which parses to turns again.

    Each round parses whole conversations and escapes the turns that came back otherwise; the last escapes all.
    Conversations that are identical already stay as they are.
    """
    d = d.withColumn("escaped", F.transform("turns", lambda t: F.lit(False))).withColumn("same", F.lit(False)).withColumn("formatted", F.lit(""))
    for last in (False, False, True):
        if last:
            d = d.withColumn("escaped", F.when(F.col("same"), F.col("escaped")).otherwise(F.transform("turns", lambda t: F.lit(True))))
        joined = F.array_join(F.zip_with("turns", "escaped", lambda t, e: F.concat(_shown(t, e), F.lit(END))), "")
        d = d.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(joined))
        d = d.withColumn("back", F.when(~F.col("same"), parse(F.col("formatted")))).withColumn("same", F.col("same") | F.col("back").eqNullSafe(F.col("turns")))
        wrong = F.slice(F.zip_with("turns", "back", lambda t, b: ~t.eqNullSafe(b)), F.lit(1), F.size("turns"))
        d = d.withColumn("escaped", F.when(F.col("same"), F.col("escaped")).otherwise(F.zip_with("escaped", wrong, lambda e, w: e | w))).drop("back")
    checked = F.when(F.col("same"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't come back from its rendering")).cast("string"))
    return d.withColumn("formatted", checked).drop("same")


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of each conversation of rows (conv_id, turn, role, text).

    Turns stand in the order of turn, then role and text (null turns first); repeated rows are turns of their
    own. Null roles and texts count as empty. loss_spans are [start, end) in code points of each assistant text, as
    escaped in formatted. A conversation's turns come together in one row of the result, and nowhere else. Rows
    without conv_id are one conversation. Other columns are left aside; an empty table gives an empty one.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    d = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role"), text_of("text"))
    g = d.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    g = settle(g.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))))
    # Each turn's place follows from the lengths of those before it.
    part = F.zip_with("turns", "escaped", lambda t, e: F.struct((t["role"] == "assistant").alias("learn"), F.length(_head(t["role"])).alias("head"), F.length(_shown(t, e)).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        own = F.array(F.struct((acc["at"] + t["head"]).alias("start"), (acc["at"] + t["n"]).alias("end")))
        return F.struct((acc["at"] + t["n"] + len(END)).alias("at"), F.when(t["learn"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return g.select("conv_id", "formatted", F.aggregate(part, start, step)["spans"].alias("loss_spans"))


def digest(formatted: DataFrame) -> DataFrame:
    """What format_conversations' output says when it is read back: turns by the parser, loss text by the mask alone, unescaped."""
    d = formatted.withColumn("turns", parse(F.col("formatted")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    d = d.withColumn("loss", loss).withColumn("all", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    return d.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("all", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("loss_spans").cast("long").alias("n_spans"),
    )


def with_planted(rows: DataFrame) -> DataFrame:
    """rows and conversation -7, whose user and assistant turns hold control strings and a backslash."""
    said = r"\### Assistant: </turn> ok"
    more = rows.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).unionByName(more)
