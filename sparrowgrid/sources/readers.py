"""Readers for landed files and the split of good from bad records."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from email import policy
from email.parser import BytesParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of an ingested record.
RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in (
        "title", "url", "raw_content", "company", "location", "deadline", "value_estimate", "source", "published_date", "country",
        "signal_type", "regulator", "project_description", "signal_date", "source_type", "presented_by", "applicant", "applicant_type",
        "representative", "action_sought", "primary_document_url", "query_term", "query_scope",
    )] + [T.StructField("withdrawn", T.BooleanType()), T.StructField("has_primary_document", T.BooleanType())]
)
REQUIRED = ("title", "url", "raw_content", "source")


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, quotes doubled, line breaks inside quotes."""
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"')
    return (reader.schema(schema) if schema else reader).csv(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines; malformed ones are skipped, or an error if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def commented_json_lines(spark: SparkSession, paths: Sequence[str], schema: str, key: str) -> DataFrame:
    """JSON lines with // comments from several files; for one key the last file wins, within a file the last line."""
    found = None
    for k, path in enumerate(paths):
        lines = spark.read.text(path).where(~F.ltrim("value").startswith("//") & (F.trim("value") != ""))
        rows = lines.select(F.from_json("value", schema).alias("row"), F.lit(k).alias("file"), F.monotonically_increasing_id().alias("line"))
        found = rows if found is None else found.unionByName(rows)
    best = found.where(F.col("row").isNotNull()).groupBy(F.col(f"row.{key}").alias("key")).agg(F.max_by("row", F.struct("file", "line")).alias("row"))
    return best.where("key is not null").select("row.*")


def xml_items(spark: SparkSession, path: str, schema: T.StructType | str, tag: str = "item") -> DataFrame:
    """RSS items and other repeated elements."""
    return spark.read.schema(schema).option("rowTag", tag).xml(path)


def html_rows(pages: DataFrame, pattern: str, columns: Sequence[str], html: str = "html") -> DataFrame:
    """One row for each match of ``pattern`` in the html column, its groups as columns."""
    groups = [F.regexp_extract_all(html, F.lit(pattern), g + 1) for g in range(len(columns))]
    rows = pages.withColumn("__x", F.explode(F.arrays_zip(*[g.alias(c) for g, c in zip(groups, columns, strict=True)])))
    return rows.select(*[c for c in pages.columns if c != html], *[F.col("__x")[c].alias(c) for c in columns])


def numbered_items(documents: DataFrame, text: str = "text") -> DataFrame:
    """Agenda text cut into its numbered items: number, item."""
    items = F.split(text, r"(?m)^(?=\s*[0-9]{1,3}[.)]\s)")
    rows = documents.withColumn("__item", F.explode(items)).withColumn("number", F.regexp_extract("__item", r"^\s*([0-9]{1,3})[.)]\s", 1).try_cast("int"))
    return rows.where("number is not null").select(*[c for c in documents.columns if c != text], "number", F.regexp_replace("__item", r"^\s*[0-9]{1,3}[.)]\s+|\s+$", "").alias("item"))


def validated(rows: DataFrame, rules: dict[str, Column], samples: int = 3) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects): rejects by reason with their count and a few distinct examples; a null rule fails."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    judged = rows.withColumn("__reasons", reasons)
    good = judged.where(F.size("__reasons") == 0).drop("__reasons")
    bad = judged.where(F.size("__reasons") > 0).select(F.explode("__reasons").alias("reason"), F.to_json(F.struct(*rows.columns)).alias("row"))
    return good, bad.groupBy("reason").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(F.substring("row", 1, 200))), 1, samples).alias("examples"))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources under one schema; columns a source lacks are null."""
    out = None
    for name, rows in sources.items():
        rows = rows.withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def high_water(stored: DataFrame, by: str, day: str, now, overlap_days: int = 30, floor_months: int = 12) -> DataFrame:
    """(by, since): where to read on from: the newest day less an overlap, never before the floor; none means the floor."""
    floor = F.add_months(F.lit(now).cast("date"), -floor_months)
    newest = F.max(F.col(day).try_cast("date"))
    return stored.groupBy(by).agg(F.greatest(F.coalesce(F.date_sub(newest, overlap_days), floor), floor).alias("since"))


def landed(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """(all sources that could be read under one schema, the others with their errors): one broken feed doesn't end a run."""
    found, failed = {}, {}
    for name, read in sources.items():
        try:
            found[name] = read()
        except Exception as e:  # noqa: BLE001  whatever a feed does is told, not raised
            failed[name] = f"{type(e).__name__}: {e}"[:300]
    return (union_sources(found) if found else None), failed


def emails(spark: SparkSession, path: str) -> DataFrame:
    """(path, sender, subject, sent, body): landed mail files, the first plain text part as body; a file that isn't mail has nulls."""

    def run(batches):
        for batch in batches:
            rows = [_mail(bytes(x)) for x in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], **{k: [r[i] for r in rows] for i, k in enumerate(("sender", "subject", "sent", "body"))}})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sender string, subject string, sent string, body string")


def _mail(raw: bytes) -> tuple[str | None, ...]:
    message = BytesParser(policy=policy.default).parsebytes(raw)
    part = message.get_body(preferencelist=("plain",))
    told = [str(message[k]) if message[k] else None for k in ("From", "Subject", "Date")]
    return (*told, part.get_content().strip() if part else None) if any(told) else (None,) * 4


def with_attachments(records: DataFrame, attachments: DataFrame, url: str = "url", most: int = 20_000) -> DataFrame:
    """Records with the text of their attachments (url, place, text) after their own, each cut to ``most`` characters; records without any stay as they are."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", F.substring("text", 1, most).alias("text")))), lambda x: x["text"])
    per = attachments.where(F.trim("text") != "").groupBy(url).agg(F.array_join(lines, "\n\n").alias("__more"))
    body = F.concat_ws("\n\n", "raw_content", "__more")
    return records.join(per, url, "left").select(*[F.when(F.col("__more").isNotNull(), body).otherwise(F.col(c)).alias(c) if c == "raw_content" else F.col(c) for c in records.columns])


def article_bodies(pages: DataFrame, html: str = "html", least: int = 40) -> DataFrame:
    """Pages with ``body``: the text of their paragraphs of ``least`` characters or more, tags and character references gone; null without any."""
    paragraphs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</?p[\s>]|</article|</body|$)"), 1)
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))
    marks = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}

    def unescaped(x):
        for coded, sign in marks.items():
            x = F.replace(x, F.lit(coded), F.lit(sign))
        return x

    kept = F.filter(F.transform(paragraphs, lambda x: unescaped(plain(x))), lambda x: F.length(x) >= least)
    return pages.withColumn("body", F.when(F.size(kept) > 0, F.array_join(kept, "\n")))
