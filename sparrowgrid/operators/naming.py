"""Names of projects: titles cleaned, and the ladder of what a project is called after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.functions.predicates import col, let
from sparrowgrid.functions.text import proper_case, shouted_words

#: The rungs from the best to the last.
RUNGS = ("target", "source", "programme", "applicant", "address", "title")
#: A title shorter than this is no name; a name longer than that is cut at a word.
LEAST_TITLE, MOST_NAME = 12, 80
# What stands before a subject, and fields that follow it.
CHROME = r"(?i)^\s*(?:(?:item|agenda item)\s*)?(?:\d+[.)]\s+)?(?:(?:public hearing|notice of public hearing|consent|discussion|resolution|ordinance|application)\s*(?:no\.?\s*[\w-]+)?\s*[:\-–]\s*)*"
FIELDS = r"(?is)\s*\b(?:location|applicant|owner|file no|file|apn|zone|zoning|recommendation|staff|case planner)\s*\.?\s*[:#].*$"


def clean_title(c: str | Column) -> Column:
    """A title without numbering, instruments and field blocks, not shouted, cut at a word; null if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(c), r"\s+", " "), CHROME, ""), FIELDS, "")
    text = F.regexp_replace(F.trim(text), r"^[\"'“”\s]+|[\"'“”\s,;:.-]+$", "")
    quiet = let(text, lambda t: F.when(2 * shouted_words(t) >= F.size(F.split(t, " ")), proper_case(t)).otherwise(t))
    return let(let(quiet, lambda q: cut_at_word(q, MOST_NAME)), lambda name: F.nullif(name, F.lit("")))


def cut_at_word(c: str | Column, most: int) -> Column:
    """At most so many characters, ended at a word."""
    text = col(c)
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_extract(text, rf"^(.{{1,{most}}})(?=\s)", 1))


def project_names(records: DataFrame, project: str, at: str) -> DataFrame:
    """(project, name, rung): the best rung that names the project.

    ``records`` has the project, the order column ``at``, and what it may be
    called after: target, source, programme, applicant, venue, address, title.
    On a rung the most frequent value wins, ties go to the one seen first;
    titles are cleaned and the first that is long enough wins.  An applicant is
    named with its venue where a record states one.
    """
    title = let(clean_title("title"), lambda t: F.when(F.length(t) >= LEAST_TITLE, t))
    given = {
        "target": F.col("target"), "source": F.col("source"), "programme": F.col("programme"),
        "applicant": F.when(F.trim(F.coalesce("applicant", F.lit(""))) != "", F.concat_ws(" ", F.trim("applicant"), "venue")),
        "address": F.col("address"), "title": title,
    }
    told = F.array(*[F.struct(F.lit(k).alias("place"), F.trim(given[r]).alias("name")) for k, r in enumerate(RUNGS)])
    # a record that names nothing stays as a row behind all rungs, so that records are read once
    last = F.array(F.struct(F.lit(len(RUNGS)).alias("place"), F.lit(None).cast("string").alias("name")))
    some = let(F.filter(told, lambda t: t["name"] != ""), lambda found: F.when(F.size(found) > 0, found).otherwise(last))
    rows = records.select(project, at, F.inline(some))
    counts = rows.groupBy(project, "place", "name").agg(F.count("*").alias("n"), F.min(at).alias("first"))
    weight = F.when(F.col("place") == RUNGS.index("title"), 0).otherwise(-F.col("n"))
    best = counts.groupBy(project).agg(F.min_by(F.struct("name", "place"), F.struct("place", weight, "first", "name")).alias("b"))
    rung = F.get(F.array(*map(F.lit, (*RUNGS, "fallback"))), F.col("b.place"))
    return best.select(project, F.coalesce("b.name", F.concat(F.lit("Project "), F.col(project))).alias("name"), rung.alias("rung"))
