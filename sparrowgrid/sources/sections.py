"""Sections of paged documents: the outline of a packet, headings as a tree, provisions of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.functions.predicates import let

# Pages that may hold an outline, the pages it has without an end of its own, its end, and headings that are no item.
OUTLINE_PAGES, OUTLINE_DEFAULT, OUTLINE_END, LEAST_TITLE = 6, 3, r"(?i)\badjourn\b", 6
PROCEDURAL = (
    "call to order", "opening invocation", "pledge of allegiance", "public comment period", "public comment", "reports", "consent agenda",
    "general business", "other business", "for information", "adjourn", "approval of agenda", "closing", "roll call",
)
# Terms of a plan's provisions, and of land use around them.
PROVISIONS = ("theme park", "entertainment", "tourist", "recreation")
LAND_USE = ("land use", "future land use", "zoning", "acre", "district", "development")

_MARKER = r"(\d+\.\d+|\d+\.)"


def _one_line(text: Column) -> Column:
    """Trimmed lines that aren't empty, joined by one space."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.array_join(lines, " ")


def outline_end(pages: Column) -> Column:
    """How many pages the outline takes: up to the one that adjourns, unless that is the first."""
    ends = F.transform(F.slice(pages, 1, OUTLINE_PAGES), lambda x: F.coalesce(x.rlike(OUTLINE_END), F.lit(False)))
    at = F.array_position(ends, True)
    return F.when(at > 1, at).otherwise(F.least(F.size(pages), F.lit(OUTLINE_DEFAULT))).cast("int")


def outline(packets: DataFrame, id: str, pages: str) -> DataFrame:
    """(id, place, num, title): the items of each packet's outline; procedural headings and titles under six characters are none.

    ``pages`` is an array of texts.  An item begins at a line with a marker, as
    in '7.' or '6.4'; lines without one go on with the item before.  Null pages
    are empty, a packet without items has no row.
    """
    texts = F.transform(F.slice(pages, F.lit(1), outline_end(F.col(pages))), lambda x: F.coalesce(x, F.lit("")))
    plain = lambda title: F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))
    is_item = lambda title: let(plain(title), lambda p: (F.length(p) >= LEAST_TITLE) & ~p.isin(*PROCEDURAL))

    def item(said: Column) -> Column:
        num = F.regexp_replace(F.regexp_extract(said, f"^{_MARKER}", 1), r"\.$", "")
        found = let(_one_line(F.regexp_replace(said, rf"^{_MARKER}\s*", "")), lambda title: F.when(is_item(title), F.struct(num.alias("num"), title.alias("title"))))
        return F.when(said.rlike(f"^{_MARKER}"), found)

    # items are made in the array, so that no filter on a row makes them again
    parts = F.split(F.array_join(texts, "\n"), rf"(?m)^(?=\s*{_MARKER})")
    items = F.transform(parts, lambda x: let(F.regexp_replace(x, r"^\s+", ""), item))
    each = packets.where(F.size(pages) > 0).select(id, F.posexplode(items).alias("place", "__item")).where("__item is not null")
    return each.select(id, "place", "__item.num", "__item.title")


def heading_tree(headings: DataFrame, id: str, place: str, level: str, title: str) -> DataFrame:
    """(id, place, level, title, path): every heading with the titles above it and its own.

    A heading belongs to the last one before it with a smaller level, whatever
    levels are left out between them.  A document's headings are gathered into
    one row, its text isn't.
    """
    rows = headings.groupBy(id).agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("place"), F.col(level).alias("level"), F.col(title).alias("title")))).alias("__h"))
    kind = dict(headings.dtypes)
    start = F.struct(
        F.array().cast(f"array<struct<level: {kind[level]}, title: string>>").alias("stack"),
        F.array().cast(f"array<struct<place: {kind[place]}, level: {kind[level]}, title: string, path: array<string>>>").alias("out"),
    )

    def add(state: Column, h: Column) -> Column:
        stack = F.array_append(F.filter(state["stack"], lambda s: s["level"] < h["level"]), F.struct(h["level"].alias("level"), h["title"].alias("title")))
        row = F.struct(h["place"].alias("place"), h["level"].alias("level"), h["title"].alias("title"), F.transform(stack, lambda s: s["title"]).alias("path"))
        return F.struct(stack.alias("stack"), F.array_append(state["out"], row).alias("out"))

    told = rows.select(id, F.explode(F.aggregate("__h", start, add)["out"]).alias("x"))
    return told.select(id, F.col("x.place").alias(place), F.col("x.level").alias(level), F.col("x.title").alias(title), F.col("x.path").alias("path"))


def plan_sections(plans: DataFrame, id: str, pages: str) -> DataFrame:
    """(id, page, hits, focus): pages of a plan with provisions for leisure in a context of land use.

    A page counts if it names theme parks, or two provisions; of pages with the
    same provisions the first one counts, and all that name theme parks.  Pages
    are numbered from 1.
    """
    low = F.lower(F.coalesce("__page", F.lit("")))
    named = lambda terms: F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))
    each = plans.select(id, F.posexplode(pages).alias("page", "__page")).select(id, (F.col("page") + 1).alias("page"), named(PROVISIONS).alias("hits"), F.size(named(LAND_USE)).alias("land"))
    park = F.array_contains("hits", "theme park")
    good = each.where((F.col("land") > 0) & (park | (F.size("hits") >= 2)))
    nth = F.row_number().over(Window.partitionBy(id, "hits").orderBy("page"))
    focus = F.when(park, "theme park provisions").otherwise(F.concat(F.array_join(F.sort_array("hits"), " / "), F.lit(" provisions")))
    return good.withColumn("__nth", nth).where((F.col("__nth") == 1) | park).select(id, "page", F.array_join(F.sort_array("hits"), ", ").alias("hits"), focus.alias("focus"))
