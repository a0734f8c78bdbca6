"""Half-open periods from tokens, weeks and months."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowgrid.functions.predicates import col

@dataclass(frozen=True)
class Period:
    key: str
    since: datetime | None = None
    until: datetime | None = None
    closed: bool = False

    def holds(self, c: str | Column) -> Column:
        """since <= c < until."""
        out = F.lit(True)
        if self.since:
            out = out & (col(c) >= F.lit(self.since))
        if self.until:
            out = out & (col(c) < F.lit(self.until))
        return out


def _month(year: int, month: int) -> tuple[datetime, datetime]:
    """A calendar month as [first day, first day of the next); months beyond the year roll over."""
    years, rest = divmod(year * 12 + month - 1, 12)
    first = datetime(years, rest + 1, 1)
    return first, datetime(years + rest // 11, (rest + 1) % 12 + 1, 1)


def _day(now: datetime) -> datetime:
    return now.replace(hour=0, minute=0, second=0, microsecond=0)


# The tokens. Each gives (since, until) from its match, the moment and the last visit; a ValueError makes it a bad token.
_TOKENS = {
    r"all": lambda m, now, visit: (None, None),
    r"visit": lambda m, now, visit: (visit, None),
    r"24h": lambda m, now, visit: (now - timedelta(days=1), None),
    r"(7|30)d": lambda m, now, visit: (now - timedelta(days=int(m[1])), None),
    r"this-week": lambda m, now, visit: (_day(now) - timedelta(days=now.weekday()), None),
    r"this-month": lambda m, now, visit: (_month(now.year, now.month)[0], None),
    r"last-month": lambda m, now, visit: _month(now.year, now.month - 1),
    r"m:(\d{4})-(0[1-9]|1[0-2])": lambda m, now, visit: _month(int(m[1]), int(m[2])),
    r"c:(\d{4}-\d{2}-\d{2})\.\.(\d{4}-\d{2}-\d{2})": lambda m, now, visit: _span(datetime.fromisoformat(m[1]), datetime.fromisoformat(m[2])),
}
#: What a bad token means.
DEFAULT = "30d"


def _span(first: datetime, last: datetime) -> tuple[datetime, datetime]:
    """Both days and what lies between."""
    if last < first:
        raise ValueError("a span ends before it begins")
    return first, last + timedelta(days=1)


def resolve(token: str | None, now: datetime, visit: datetime | None = None) -> Period:
    """The period a token names, closed if it has an end that isn't ahead; the last 30 days for a bad one."""
    key = (token or DEFAULT).strip()
    for pattern, bounds in _TOKENS.items():
        if found := re.fullmatch(pattern, key):
            try:
                since, until = bounds(found, now, visit)
            except ValueError:
                break
            return Period(key, since, until, until is not None and until <= now)
    return resolve(DEFAULT, now)


def weeks(since: date, until: date) -> Column:
    """ISO weeks that tile [since, until), clipped to it: array<struct<start, end>>."""
    a, b = F.lit(since).cast("date"), F.lit(until).cast("date")
    mondays = F.sequence(F.date_trunc("week", a).cast("date"), F.date_sub(b, 1), F.expr("interval 7 days"))
    return F.transform(mondays, lambda m: F.struct(F.greatest(m, a).alias("start"), F.least(F.date_add(m, 7), b).alias("end")))


def month_of(c: str | Column) -> Column:
    return F.date_trunc("month", col(c)).cast("date")


def week_of(c: str | Column) -> Column:
    """The Monday of the day's week."""
    return F.date_trunc("week", col(c)).cast("date")
