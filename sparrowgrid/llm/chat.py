"""Chat formatting over reply trees, with DataFrame functions only.

Messages form trees.  Repeated self-joins double the reach of every message's
ancestor link, adding scores on the way, until each message knows the sum from
its root; the leaves are ranked by it, and the same links give the chosen
leaves' paths.  Each path becomes one text:

    ### role: text </turn>\\n

Inside roles and texts the characters that begin a control string are written
otherwise (a backslash as two, ``<`` as ``\\l``, ``#`` as ``\\h``, and in roles
``:`` as ``\\c``), so no text holds a control string and every text can be
recovered exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.llm.common import drop, written

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    """The text without control characters; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, coded in (("\\", "\\\\"), ("<", "\\l"), ("#", "\\h"), *(((":", "\\c"),) if role else ())):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def unescape(text: Column) -> Column:
    """Undo ``escape``: between doubled backslashes the codes stand alone."""

    def plain(part: Column) -> Column:
        for coded, to in (("\\l", "<"), ("\\h", "#"), ("\\c", ":")):
            part = F.replace(part, F.lit(coded), F.lit(to))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def _key(c: Column) -> Column:
    """Ids as join keys; null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(conv, leaf, rank, depth, msg): the messages of the best root-to-leaf paths.

    ``messages`` has conv, msg (unique in its conversation), parent and score
    (null counts 0).  A parent that isn't there makes its message a root.
    Leaves are ranked within a conversation by the sum of scores on their path,
    ties by the smaller leaf; ``branches=None`` keeps all.  Messages on a cycle
    have no root and are on no path.
    """
    nodes = messages.select("conv", "msg", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select("conv", F.col("msg").alias("parent"), F.lit(True).alias("there"))
    links = nodes.join(known, ["conv", "parent"], "left").select(
        "conv", "msg", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("total")
    )
    jumps = [written(links, "jump")]
    limit = max(1, jumps[0].count()).bit_length() + 1
    while len(jumps) <= limit and not jumps[-1].where("up is not null").isEmpty():
        now = jumps[-1]
        above = now.select("conv", F.col("msg").alias("up"), F.col("up").alias("up2"), F.col("total").alias("more"))
        # messages that have reached their root are done
        further = now.where("up is not null").join(above, ["conv", "up"]).select("conv", "msg", F.col("up2").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        jumps.append(written(now.where("up is null").unionByName(further), "jump"))
    parents = nodes.where("parent is not null").select("conv", F.col("parent").alias("msg"))
    leaves = jumps[-1].where("up is null").join(parents, ["conv", "msg"], "left_anti")
    if branches == 1:
        # the best leaf by an aggregate, so that no conversation's leaves are gathered
        best = leaves.groupBy("conv").agg(F.max_by("msg", F.struct("total", -F.col("msg"))).alias("leaf"))
        chosen = best.withColumn("rank", F.lit(1))
    else:
        order = Window.partitionBy("conv").orderBy(F.desc("total"), F.asc("msg"))
        chosen = leaves.withColumn("rank", F.row_number().over(order)).withColumnRenamed("msg", "leaf")
        chosen = chosen.where(F.col("rank") <= branches) if branches else chosen
    found = chosen.select("conv", "leaf", "rank", F.col("leaf").alias("msg"), F.lit(0).cast("long").alias("up_by"))
    for k, jump in enumerate(jumps[:-1]):
        lower = found
        higher = found.join(jump.where("up is not null").select("conv", "msg", "up"), ["conv", "msg"]).select(
            "conv", "leaf", "rank", F.col("up").alias("msg"), (F.col("up_by") + (1 << k)).alias("up_by")
        )
        found = written(found.unionByName(higher), "path")
        if k:
            drop(lower)
    if len(jumps) > 1:
        drop(*jumps)
    return found.select("conv", "leaf", "rank", (-F.col("up_by")).alias("depth"), "msg")


def format_paths(messages: DataFrame, chosen: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss_spans) for each chosen path.

    ``loss_spans`` are the [start, end) code points of the escaped texts of the
    ``learn`` role.
    """
    role, text = escape(F.col("role"), role=True), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(COLON))
    turns = chosen.join(messages, ["conv", "msg"]).select(
        "conv", "conv_id", "leaf", "rank", "depth",
        F.concat(head, text, F.lit(CLOSE)).alias("turn_text"),
        F.when(F.col("role") == learn, F.length(head)).alias("begins"),
        F.length(text).alias("text_chars"),
    )
    order = Window.partitionBy("conv", "leaf").orderBy("depth")
    before = F.sum(F.length("turn_text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = turns.withColumn("start", F.coalesce(before, F.lit(0)) + F.col("begins"))
    span = F.when(F.col("begins").isNotNull(), F.struct(F.col("start"), (F.col("start") + F.col("text_chars")).alias("end")))
    return placed.groupBy("conv", "leaf").agg(
        F.first("conv_id").alias("conv_id"),
        F.first("rank").alias("rank"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "turn_text"))), lambda x: x["turn_text"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
    ).drop("conv")


def format_conversations(df: DataFrame, learn: str = "assistant") -> DataFrame:
    """Linear conversations (conv_id, turn, role, text): each row replies to the one before it.

    Rows are ordered by turn, then role and text (nulls first); repeated rows
    are turns of their own.  Null texts and roles are empty; rows with a null
    conv_id form one conversation.  Other columns are ignored.
    """
    key = _key(F.col("conv_id"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = df.select(key.alias("conv"), "conv_id", "turn", "role", "text").withColumn("msg", F.row_number().over(order).cast("long"))
    messages = written(
        rows.select("conv", "conv_id", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score")),
        "messages",
    )
    return format_paths(messages.drop("parent", "score"), paths(messages), learn)


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    parts = F.split(formatted, CLOSE, -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.regexp_extract(t, r"(?s)^### ([^:]*): ", 1)).alias("role"),
            unescape(F.regexp_extract(t, r"(?s)^### [^:]*: (.*)$", 1)).alias("text"),
        ),
    )


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped span by span."""
    cut = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, cut), "")


def digests(formatted: DataFrame) -> DataFrame:
    """The query's columns, read back from the formatted texts and their masks."""
    read = formatted.select("conv_id", parse(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
