"""Paged REST sources as a Spark data source: the driver plans pages, executors fetch them.

    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").options(fetch="package.module:function", schema="id long, title string", where="...", limit=1000).load()

``fetch(params: dict) -> list[dict]`` is imported on the executors; it makes
the request, and is asked again, after a growing pause, where it raises.
``keyset`` names a column whose values grow: pages then follow one another by
``$where`` in one task; otherwise pages are offsets, one task each.  A scan ends
with an empty page, whatever the length of the others; a key that doesn't grow,
and a source with more rows than ``most``, are errors: what comes back is whole.

With ``pushdown`` true, filters that the source can answer are left to it; the session then sets
``spark.sql.python.filterPushdown.enabled``.  As a stream, ``keyset`` is the high-water mark:
each batch has what lies behind it, less an ``overlap`` for rows that came late.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import date, datetime
from importlib import import_module

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    SimpleDataSourceStreamReader,
)
from pyspark.sql.types import StructType


def literal(value: str) -> str:
    """A text as a literal of the sources' query language: quotes doubled."""
    return "'" + str(value).replace("'", "''") + "'"


def request(select: str = "", where: str = "", order: str = "", limit: int = 1000, offset: int = 0) -> dict[str, str]:
    """The parameters of one page, with selection, filter and order left to the source."""
    named = {"$select": select, "$where": where, "$order": order, "$limit": str(limit), "$offset": str(offset) if offset else ""}
    return {k: v for k, v in named.items() if v}


def _function(name: str) -> Callable[[dict], list[dict]]:
    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)


def constant(value) -> str:
    """A value as the source writes it; days become its timestamps."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, datetime):
        return literal(value.isoformat())
    return literal(f"{value.isoformat()}T00:00:00" if isinstance(value, date) else value)


_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def clause(f: Filter) -> str | None:
    """A filter in the source's language; None for what it can't answer."""
    if len(f.attribute) != 1:
        return None
    name = f.attribute[0]
    if isinstance(f, IsNotNull):
        return f"{name} IS NOT NULL"
    if isinstance(f, In):
        return f"{name} IN ({', '.join(map(constant, f.value))})" if f.value and None not in f.value else None
    sign = _SIGNS.get(type(f))
    return f"{name} {sign} {constant(f.value)}" if sign and f.value is not None else None


class Incomplete(RuntimeError):
    """A scan that can't give all rows."""


class Pages:
    """Asks for pages as the options say."""

    def __init__(self, columns: list[str], options: dict):
        self.columns, self.options = columns, options
        self.size = int(options.get("limit", 1000))
        self.attempts, self.pause = int(options.get("attempts", 3)), float(options.get("pause", 0.5))
        self.key, self.most = options.get("keyset"), int(options.get("most", 0))

    def ask(self, where: str, order: str, offset: int = 0) -> list[dict]:
        params = request(",".join(self.columns), where, order, self.size, offset)
        for k in range(self.attempts):
            try:
                return _function(self.options["fetch"])(params)
            except Exception as e:
                if k == self.attempts - 1:
                    raise Incomplete(f"no answer to {params} in {self.attempts} attempts: {e}") from e
                time.sleep(self.pause * 2**k)
        raise Incomplete("attempts must be 1 or more")

    def by_key(self, where: str, after=None) -> Iterator[dict]:
        """Pages behind ``after``, each from the last key of the one before."""
        seen = 0
        while True:
            behind = f"{self.key} > {constant(after)}" if after is not None else ""
            page = self.ask(" AND ".join(f"({x})" for x in (where, behind) if x), self.key)
            if not page:
                return
            last = max(row[self.key] for row in page)
            if after is not None and last <= after:
                raise Incomplete(f"{self.key} doesn't grow beyond {after!r}")
            seen += len(page)
            if self.most and seen > self.most:
                raise Incomplete(f"the source has more than {self.most} rows")
            yield from page
            after = last

    def by_offset(self, where: str, start: int, end: int | None) -> Iterator[dict]:
        """Rows from ``start`` up to ``end``, or to an empty page."""
        while end is None or start < end:
            page = self.ask(where, self.options.get("order", ""), start)
            if not page:
                return
            start += len(page)
            if self.most and start > self.most:
                raise Incomplete(f"the source has more than {self.most} rows")
            # a page may be longer or shorter than the part that asks for it
            yield from page if end is None or start <= end else page[: len(page) - (start - end)]


class Page(InputPartition):
    def __init__(self, start: int, end: int | None):
        super().__init__(start)
        self.start, self.end = start, end


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.pages, self.options, self.pushed = Pages(schema.fieldNames(), options), options, []

    def partitions(self) -> list[InputPartition]:
        rows, size = int(self.options.get("rows", 0)), self.pages.size
        if self.pages.key or not rows:
            return [Page(0, None)]
        # the last part goes on to the end, so rows that came since are read too
        starts = range(0, rows, size)
        return [Page(k, k + size if k + size < rows else None) for k in starts]

    def read(self, partition: Page) -> Iterator[tuple]:
        where = " AND ".join(f"({x})" for x in (self.options.get("where", ""), *self.pushed) if x)
        rows = self.pages.by_key(where) if self.pages.key else self.pages.by_offset(where, partition.start, partition.end)
        for row in rows:
            yield tuple(row.get(c) for c in self.pages.columns)


class FilteredReader(PagedReader):
    """Leaves filters to the source; the session must allow it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            said = clause(f)
            if said is not None:
                self.pushed.append(said)
            # a source may compare texts in its own way, so Spark asks again
            yield f


class PagedStream(SimpleDataSourceStreamReader):
    """Batches behind a high-water mark of ``keyset``, a number; what lies less than ``overlap`` below it comes again when there is something new."""

    def __init__(self, schema: StructType, options: dict):
        self.pages, self.options = Pages(schema.fieldNames(), options), options
        self.overlap = int(options.get("overlap", 0))

    def initialOffset(self) -> dict:
        return {"mark": None}

    def _rows(self, start: dict, end: dict | None) -> list[dict]:
        low = None if start["mark"] is None else start["mark"] - self.overlap
        high = [] if end is None else [f"{self.pages.key} <= {constant(end['mark'])}"]
        return list(self.pages.by_key(" AND ".join(f"({x})" for x in (self.options.get("where", ""), *high) if x), low))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._rows(start, None)
        mark = max((r[self.pages.key] for r in rows), default=None)
        if mark is None or start["mark"] is not None and mark <= start["mark"]:
            return iter(()), start
        return self._tuples(rows), {"mark": mark}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._tuples(self._rows(start, end))

    def _tuples(self, rows: list[dict]) -> Iterator[tuple]:
        return iter([tuple(row.get(c) for c in self.pages.columns) for row in rows])


class PagedSource(DataSource):
    """Options: fetch, schema; where, order, limit (rows a page), rows (for pages in parallel), keyset, most, attempts, pause, pushdown, overlap (streams)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = FilteredReader if self.options.get("pushdown") == "true" else PagedReader
        return kind(schema, dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return PagedStream(schema, dict(self.options))
