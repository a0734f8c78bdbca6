"""Dates stated in free text, and what they say about a record's age and milestones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowgrid.functions.predicates import col

# Month names by their first letters, and words before a number that make it an address.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ADDRESS_WORDS = ("suite", "ste", "unit", "apt", "apartment", "room", "rm", "floor", "fl", "no", "number", "box", "#")
_MONTH = "(" + "|".join(MONTHS) + ")[a-z]*"
_PATTERNS = {
    # pattern, groups of year, month and day (0: not stated, the first)
    "iso": (r"\b(\d{4})-(\d{2})-(\d{2})\b", 1, 2, 3),
    "month first": (r"\b" + _MONTH + r"\.?\s+(?:(\d{1,2})(?:st|nd|rd|th)?,?\s+)?(\d{4})\b", 3, 1, 2),
    "day first": (r"\b(\d{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?" + _MONTH + r"\.?,?\s+(\d{4})\b", 3, 2, 1),
    "fiscal": (r"\bfy\s?['/-]?(\d{4}|\d{2})\b", 1, 0, 0),
    "year": (r"(?<![\d$#.,])(?<!(?:" + "|".join(ADDRESS_WORDS) + r")\s{0,4}[.:#-]?\s{0,4})\b(19\d{2}|20[0-3]\d)\b", 1, 0, 0),
}


def date_candidates(c: str | Column) -> Column:
    """All real days that the text states, ascending, with repeats: ISO, 'March 5, 2011', '5th of Mar 2011', 'FY12', '2011'.

    A month or a year alone stands for its first day.  Impossible days, amounts
    and numbers of an address are left out; null gives none.
    """
    text = F.lower(F.coalesce(col(c), F.lit("")))
    # the pattern is matched anew inside its own match, so what must not stand before it is asked once only
    found = [F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), _day_of(pattern, *groups)) for pattern, *groups in _PATTERNS.values()]
    return F.array_sort(F.array_compact(F.concat(*found)))


def _day_of(pattern: str, year: int, month: int, day: int):
    """The day that a match states; groups by number, 0 for what isn't stated."""
    numbers = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS) for x in (m, f"{k + 1:02d}")])

    def read(x: Column) -> Column:
        y, m, d = (F.regexp_extract(x, pattern, g) if g else F.lit("") for g in (year, month, day))
        y = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
        m = F.when(m == "", "01").otherwise(F.coalesce(F.element_at(numbers, F.substring(m, 1, 3)), m))
        return F.concat_ws("-", y, m, F.lpad(F.when(d == "", "1").otherwise(d), 2, "0")).try_cast("date")

    return read


# Fixed value: seconds of the units in which ages are stated.
AGES = {"hour": 3600, "day": 86_400, "week": 604_800, "month": 2_592_000, "year": 31_536_000}


def stated_time(c: str | Column, now: Column) -> Column:
    """The time of '3 days ago' before ``now``, or of a time as it stands; null for anything else."""
    text = F.trim(col(c))
    n, unit = (F.regexp_extract(text, r"(?i)^(\d{1,9})\s+(hour|day|week|month|year)s?\s+ago$", k) for k in (1, 2))
    seconds = F.element_at(F.create_map(*[F.lit(x) for pair in AGES.items() for x in pair]), F.lower(unit)) * n.try_cast("bigint")
    return F.coalesce(F.timestamp_seconds(F.unix_timestamp(now) - seconds), text.try_cast("timestamp"))


def last_day(days: str | Column, keep) -> Column:
    """The last of the ascending ``days`` that ``keep`` lets through."""
    return F.try_element_at(F.filter(days, keep), F.lit(-1))


def published_day(c: str | Column, today: Column) -> Column:
    """The freshest stated day that isn't in the future: plan horizons are no publication dates."""
    return last_day(date_candidates(c), lambda d: d <= today)


def milestone_day(c: str | Column, today: Column) -> Column:
    """The last stated day after today."""
    return last_day(date_candidates(c), lambda d: d > today)


def derived_dates(deadline: str | Column, published: str | Column, text: str | Column, today: Column) -> Column:
    """struct<deadline, published, source>: as the source gives them, else parsed from the text, else first_seen."""
    given, said = col(deadline).try_cast("date"), col(published).try_cast("date")
    parsed = published_day(text, today)
    stated = given.isNotNull() | said.isNotNull()
    return F.struct(
        given.alias("deadline"),
        F.when(stated, said).otherwise(parsed).alias("published"),
        F.when(stated, "source").when(parsed.isNotNull(), "parsed").otherwise("first_seen").alias("source"),
    )


def opportunity_state(deadline: str | Column, milestone: str | Column, today: Column, purge: Column) -> Column:
    """live until its deadline has passed; then archive, or delete if it lapsed before ``purge`` and no milestone is ahead."""
    d, m = col(deadline).try_cast("date"), col(milestone).try_cast("date")
    return (
        F.when(d.isNull(), "archive").when(d >= today, "live")
        .when((d < purge) & ~F.coalesce(m > today, F.lit(False)), "delete").otherwise("archive")
    )
