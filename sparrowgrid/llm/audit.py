"""Filter interaction audit from a histogram of failure masks.

Every document's failures are a mask of five bits.  A part has 32 masks, and
whatever order the filters are applied in, each figure of each step is a sum
over those 32 cells; so the documents are read once, and orders are enumerated
from the cells alone.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.common import drop, written

#: Bit k of a mask belongs to LETTERS[k].
LETTERS = "ABCDE"
#: White space, symbols and limits of the filters.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
NO_CAPITALS = "[^A-Z]+"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, SPACES), "")


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at one text (A to D); ``text`` is not null."""
    fails = {
        "A": F.col("n_words") < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * F.col("n_words"),
        "C": 100 * F.length(F.regexp_replace(text, NO_CAPITALS, "")) > MAX_CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }
    return sum(F.when(c, F.lit(1 << LETTERS.index(x))).otherwise(F.lit(0)) for x, c in fails.items())


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every row of ``docs`` (doc_id, text, lang), with one small shuffle by id for each of E and the labels.

    Only digests of texts travel.  The join that finds the first of equal texts
    has the id among its keys, so a text on a third of all rows is spread like
    any other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    seen = seen.withColumn("words", words(F.col("text"))).withColumn("n_words", F.size("words"))
    small = written(seen.select("doc_id", "part", text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    first = small.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    again = F.col("first").isNull() & F.col("doc_id").isNotNull()
    joined = small.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    mask = F.col("mask") + F.when(again, F.lit(1 << LETTERS.index("E"))).otherwise(F.lit(0))
    out = joined.select("part", mask.alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    out.shared_path = small.shared_path
    return out


def histogram(rows: DataFrame) -> DataFrame:
    """(part, cells): at most 32 cells (mask, n, good, toxic) a part, counted before anything travels."""
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def _steps() -> Column:
    """All 120 orders with their five steps: the filter's bit and the mask of those before it."""
    steps = []
    for order in map("".join, permutations(LETTERS)):
        for k, letter in enumerate(order):
            before = sum(1 << LETTERS.index(x) for x in order[:k])
            steps.append((order, k + 1, 1 << LETTERS.index(letter), before))
    row = lambda o, k, bit, before: F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before"))
    return F.array(*(row(*s) for s in steps))


def _total(keep, value) -> Column:
    """Sum of ``value`` over the cells that ``keep``."""
    return F.aggregate(F.filter("cells", keep), F.lit(0).cast("long"), lambda a, c: a + value(c))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic;
    other columns are ignored, whatever they are called.  A null text counts as
    empty, a null lang as the part ''.  A null doc_id is no smaller than any, so
    such a row never fails E and makes no other row fail.  Rows that repeat an
    id with its text all count, and none of them is a copy of a *smaller* id.
    Labels of a repeated id are united; null labels and rows without one are
    neither good nor toxic.  No documents give no rows.
    """
    rows = masks(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic"))
    cells = written(histogram(rows), "cells")
    drop(rows)
    at = cells.select("part", "cells", F.explode(_steps()).alias("s")).select("part", "cells", "s.*")
    bit, before = F.col("bit"), F.col("before")
    fails = lambda c: c.mask.bitwiseAND(bit) != 0
    gone = lambda c: c.mask.bitwiseAND(before) != 0
    here = lambda c: fails(c) & ~gone(c)
    # in the 120 orders a document is removed by each of its m failing filters equally often
    share = lambda c: c.n * F.element_at(F.array(*(F.lit(120 // m) for m in range(1, 6))), F.bit_count(c.mask).cast("int"))
    return at.select(
        "part",
        "filter_order",
        "step",
        _total(lambda c: ~fails(c) & ~gone(c), lambda c: c.n).alias("kept"),
        _total(here, lambda c: c.n).alias("removed"),
        _total(lambda c: fails(c) & gone(c), lambda c: c.n).alias("redundant"),
        _total(lambda c: c.mask == bit, lambda c: c.n).alias("unique_fails"),
        _total(here, lambda c: c.good).alias("good_lost"),
        _total(here, lambda c: c.toxic).alias("toxic_lost"),
        _total(fails, share).alias("shapley"),
    )
