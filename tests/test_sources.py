"""Paged sources, mails, attachments, article bodies, CSV documents, sheets and feeds that fail."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowgrid.sources import paged, readers, sinks
from sparrowgrid.streaming import upserts

ROWS = [{"id": i, "title": f"t{i}", "extra": 1} for i in range(1, 26)]
BROKEN = 0


def fetch(params):
    """A source of 25 rows that answers as a REST endpoint would."""
    rows = ROWS
    for low in re.findall(r"id > (\d+)", params.get("$where", "")):
        rows = [r for r in rows if r["id"] > int(low)]
    for high in re.findall(r"id <= (\d+)", params.get("$where", "")):
        rows = [r for r in rows if r["id"] <= int(high)]
    start = int(params.get("$offset", 0))
    return [{k: r[k] for k in params["$select"].split(",")} for r in rows[start : start + int(params["$limit"])]]


def short(params):
    """Never more than four rows a page, whatever is asked for."""
    return fetch(params | {"$limit": "4"})


def flaky(params):
    """Every second request fails."""
    global BROKEN
    BROKEN += 1
    if BROKEN % 2:
        raise TimeoutError("no answer")
    return fetch(params)


def dead(params):
    raise TimeoutError("no answer")


def stuck(params):
    """The same page again and again."""
    return fetch({**params, "$where": ""})


def narrow(params):
    """Only answers requests that leave the filter to it."""
    assert "title IN ('t3', 't4')" in params["$where"] and "id > 3" in params["$where"] or "(id <= 10) AND (id > 4)" in params["$where"], params
    return fetch(params)


def paged_rows(spark, of="fetch", **more):
    spark.dataSource.register(paged.PagedSource)
    return spark.read.format("paged").options(fetch=f"tests.test_sources:{of}", schema="id long, title string", limit=10, pause=0, **more).load()


@pytest.mark.parametrize("of", ["fetch", "short", "flaky"])
@pytest.mark.parametrize("more", [{}, {"keyset": "id"}, {"rows": 25}, {"rows": 12}, {"keyset": "id", "where": "id < 99"}, {"most": 25}])
def test_paged_source(spark, more, of):
    got = paged_rows(spark, of, **more)
    assert sorted(r.id for r in got.collect()) == list(range(1, 26)) and got.columns == ["id", "title"]
    assert got.rdd.getNumPartitions() == {25: 3, 12: 2}.get(more.get("rows"), 1)


@pytest.mark.parametrize("of, more, said", [("stuck", {"keyset": "id"}, "doesn't grow"), ("dead", {}, "3 attempts"), ("fetch", {"most": 24}, "more than 24"), ("fetch", {"most": 24, "keyset": "id"}, "more than 24")])
def test_no_incomplete_scan_passes(spark, of, more, said):
    with pytest.raises(Exception, match=said):
        paged_rows(spark, of, **more).collect()


def test_filters_are_left_to_the_source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    got = paged_rows(spark, "narrow", keyset="id", pushdown="true").where("id > 3 and title in ('t3', 't4')").collect()
    assert [r.id for r in got] == [4]
    assert paged.clause(paged.EqualTo(("a",), "O'Hare")) == "a = 'O''Hare'" and paged.clause(paged.EqualTo(("a", "b"), 1)) is None
    assert paged.clause(paged.LessThan(("d",), date(2020, 1, 2))) == "d < '2020-01-02T00:00:00'"


def test_stream_behind_a_mark(spark, tmp_path):
    reader = paged.PagedStream(T.StructType().add("id", "long").add("title", "string"), {"fetch": "tests.test_sources:fetch", "limit": "10", "keyset": "id", "overlap": "3", "pause": "0"})
    rows, mark = reader.read({"mark": 20})
    assert [r[0] for r in rows] == list(range(18, 26)) and mark == {"mark": 25}
    assert [list(rows) for rows, _ in [reader.read(mark)]] == [[]] and [r[0] for r in reader.readBetweenOffsets({"mark": 5}, {"mark": 7})] == list(range(3, 8))
    spark.dataSource.register(paged.PagedSource)
    stream = spark.readStream.format("paged").options(fetch="tests.test_sources:fetch", schema="id long, title string", limit=10, keyset="id").load()
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(1, 26))


STORED = "id long, title string, place string, status string, overrides array<string>"


def batches(spark, folder, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, title string, place string, ts long").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema("id long, title string, place string, ts long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_streamed_upsert(spark, tmp_path):
    one, two, three = [(1, "a", "x", 1), (1, "b", None, 2), (2, "c", "y", 1)], [(1, "late", "z", 0), (3, "d", None, 5)], [(2, None, "w", 9), (1, "e", None, 9)]
    stored = spark.createDataFrame([(2, "kept", "q", None, ["title"]), (9, "old", "r", "dismissed", [])], STORED)
    stream = batches(spark, str(tmp_path), one, two, three)
    table = upserts.UpsertTable(spark, f"{tmp_path}/table", "id", "ts", enrichment=["place"])
    table.begin(stored)
    table.follow(stream, f"{tmp_path}/state").awaitTermination()
    got = {r.id: (r.title, r.place, r.status) for r in table.read().collect()}
    # a null never erases a place, a late row never undoes a newer one, what is set by hand stays; all rows in one batch give the same
    whole = upserts.UpsertTable(spark, f"{tmp_path}/whole", "id", "ts", enrichment=["place"])
    whole.begin(stored)
    whole.put(spark.createDataFrame(two + three + one, "id long, title string, place string, ts long"), 0)
    assert sorted(map(str, whole.read().collect())) == sorted(map(str, table.read().collect()))
    assert got == {1: ("e", "x", None), 2: ("kept", "w", None), 3: ("d", None, None), 9: ("old", "r", "dismissed")}
    # a batch that is run again changes nothing
    before = sorted(map(str, table.read().collect()))
    table.put(spark.createDataFrame(three, "id long, title string, place string, ts long"), table.versions()[-1])
    assert sorted(map(str, table.read().collect())) == before and len(table.versions()) <= 2


def test_request_parameters():
    assert paged.request("a,b", "x = " + paged.literal("O'Hare"), "a", 5, 10) == {"$select": "a,b", "$where": "x = 'O''Hare'", "$order": "a", "$limit": "5", "$offset": "10"}
    assert paged.request(limit=7) == {"$limit": "7"}


def test_emails(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: Jane <jane@firm.test>\r\nSubject: =?utf-8?q?Caf=C3=A9?=\r\nDate: Mon, 1 Jan 2024 10:00:00 +0000\r\n\r\nHello there\r\n")
    (tmp_path / "b.eml").write_bytes(b"\x00\x01 no mail")
    got = sorted(readers.emails(spark, str(tmp_path)).collect(), key=lambda r: r.path)
    assert (got[0].sender, got[0].subject, got[0].body) == ("Jane <jane@firm.test>", "Café", "Hello there") and got[1].sender is None


def test_attachments_and_bodies(spark):
    records = spark.createDataFrame([("u", "own"), ("v", None), ("w", "w")], "url string, raw_content string")
    more = spark.createDataFrame([("u", 2, "two"), ("u", 1, "one"), ("v", 1, "x" * 50), ("w", 1, " ")], "url string, place int, text string")
    got = {r.url: r.raw_content for r in readers.with_attachments(records, more, most=10).collect()}
    assert got == {"u": "own\n\none\n\ntwo", "v": "x" * 10, "w": "w"}
    pages = spark.createDataFrame([(1, "<nav><p>short</p></nav><p class=a>A paragraph of &amp; about <b>forty</b> characters, or more.<p>Another one that is long enough to be counted here.</article>"), (2, None)], "id int, html string")
    bodies = {r.id: r.body for r in readers.article_bodies(pages).collect()}
    assert bodies == {1: "A paragraph of & about forty characters, or more.\nAnother one that is long enough to be counted here.", 2: None}


def test_a_broken_feed_is_told(spark):
    rows, failed = readers.landed({"good": lambda: spark.range(2).select(F.col("id").alias("x")), "bad": lambda: 1 / 0})
    assert rows.count() == 2 and failed["bad"].startswith("ZeroDivisionError")


def test_csv_document(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 'say "hi"', None), ("line\nbreak", "x", 1)], "Section string, `Pro,ject` string, n int").coalesce(1)
    sinks.csv_document(rows, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes() == b'Section,"Pro,ject",n\r\n"a,b","say ""hi""",\r\n"line\nbreak",x,1\r\n'


def test_sheet(spark):
    rows = spark.createDataFrame([("g2", "x", None), ("g1", "y", None), ("g1", "z", " ")], "grp string, name string, none string")
    got = [(r.kind[2:], list(r.cells)) for r in sinks.sheet(rows, "grp").collect()]
    assert got == [("header", ["name"]), ("group", ["g1", "2"]), ("row", ["y"]), ("row", ["z"]), ("group", ["g2", "1"]), ("row", ["x"]), ("summary", ["3", "2"])]
