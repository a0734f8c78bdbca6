"""Guarded upserts, edits and change events: each takes the stored version and gives the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def guarded_upsert(stored: DataFrame, new: DataFrame, key: str, owned: Sequence[str] = (), enrichment: Sequence[str] = (), overrides: str = "overrides", status: str = "status") -> DataFrame:
    """The next version with ``action``: insert, update, tombstone (a dismissed row isn't revived) or keep.

    Of repeated new rows the caller must have chosen one.  ``owned`` columns and
    columns named in the stored row's ``overrides`` array keep their stored
    value; a null never replaces a value in ``enrichment`` columns.
    """
    columns = [c for c in stored.columns if c not in (key, overrides)]
    old = stored.select(key, F.struct(*columns, overrides).alias("old"))
    fresh = new.select(key, F.struct(*[c for c in columns if c in new.columns]).alias("new"))
    both = old.join(fresh, key, "full")
    dead = F.coalesce(F.col(f"old.{status}") == "dismissed", F.lit(False))
    action = F.when(F.col("new").isNull(), "keep").when(F.col("old").isNull(), "insert").when(dead, "tombstone").otherwise("update")
    out = []
    for c in columns:
        was = F.col(f"old.{c}")
        if c not in new.columns:
            out.append(was.alias(c))
            continue
        now = F.col(f"new.{c}")
        keep = F.coalesce(F.array_contains(F.col(f"old.{overrides}"), c), F.lit(False)) | F.lit(c in owned)
        value = F.when(keep, was).otherwise(F.coalesce(now, was) if c in enrichment else now)
        out.append(F.when(action == "insert", now).when(action == "update", value).otherwise(was).alias(c))
    return both.select(key, *out, F.coalesce(F.col(f"old.{overrides}"), F.array().cast("array<string>")).alias(overrides), action.alias("action"))


def insert_absent(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose keys aren't stored, one of each."""
    return new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def append_events(stored: DataFrame, new: DataFrame, identity: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(events to append, counts by layer): deduplicated in the batch, then against what is stored; nulls equal ''."""
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity])
    keyed = new.withColumn("__key", key)
    once = keyed.dropDuplicates(["__key"])
    fresh = once.join(stored.select(key.alias("__key")).distinct(), "__key", "left_anti")
    there = stored.select(key.alias("__key")).distinct().withColumn("__there", F.lit(True))
    told = keyed.groupBy("__key").agg(F.count("*").alias("__n")).join(there, "__key", "left")
    counts = told.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("offered"), F.count("*").alias("distinct"), F.count_if(F.col("__there").isNull()).alias("appended"))
    return fresh.drop("__key"), counts


def apply_edits(stored: DataFrame, edits: DataFrame, key: str, field: str) -> DataFrame:
    """Manual edits (key, value) of one field; an edit to the same value changes nothing, others are noted in ``overrides``."""
    new = edits.select(key, F.col("value").alias("__value"), F.lit(True).alias("__edit"))
    joined = stored.join(new, key, "left")
    changed = F.coalesce(F.col("__edit"), F.lit(False)) & ~F.col(field).eqNullSafe(F.col("__value"))
    columns = [F.when(changed, F.col("__value")).otherwise(F.col(c)).alias(c) if c == field else F.when(changed, F.array_union(c, F.array(F.lit(field)))).otherwise(F.col(c)).alias(c) if c == "overrides" else F.col(c) for c in stored.columns]
    return joined.select(*columns, changed.alias("changed"))


def change_events(before: DataFrame, after: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, event_type, from_value, to_value): created rows, and an event for each named field that changed."""
    b = before.select(key, F.struct(*fields).alias("b"))
    a = after.select(key, F.struct(*fields).alias("a"))
    both = a.join(b, key, "left")
    created = F.when(F.col("b").isNull(), F.struct(F.lit("created").alias("event_type"), F.lit(None).cast("string").alias("from_value"), F.lit(None).cast("string").alias("to_value")))
    events = [created]
    for c, name in fields.items():
        was, now = F.col(f"b.{c}"), F.col(f"a.{c}")
        events.append(F.when(F.col("b").isNotNull() & ~was.eqNullSafe(now), F.struct(F.lit(name).alias("event_type"), was.cast("string").alias("from_value"), now.cast("string").alias("to_value"))))
    return both.select(key, F.inline(F.array_compact(F.array(*events))))


def lifecycle(df: DataFrame, now, text: str, deadline: str, dead_pattern: str) -> DataFrame:
    """``lifecycle``: dead by its notice's words, expired by its deadline, else active."""
    return df.withColumn("lifecycle", F.when(F.col(text).rlike(dead_pattern), "dead").when(F.col(deadline) < F.lit(now), "expired").otherwise("active"))


def plain_upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows over stored ones; of repeated new rows one must have been chosen. Columns that new rows lack keep their stored value."""
    columns = [c for c in stored.columns if c != key]
    fresh = new.select(key, F.struct(*[c for c in columns if c in new.columns]).alias("__new"))
    both = stored.join(fresh, key, "full")
    return both.select(key, *[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in new.columns else F.col(c) for c in columns])


def move_records(stored: DataFrame, moves: DataFrame, record: str) -> DataFrame:
    """Records (project_id, cluster_reason) after moves by hand (record, to): a null target detaches for good, another attaches as manual."""
    told = moves.select(record, "to", F.lit(True).alias("__moved"))
    rows = stored.join(told, record, "left")
    moved = F.coalesce("__moved", F.lit(False))
    project = F.when(moved, F.col("to")).otherwise(F.col("project_id"))
    reason = F.when(moved, F.when(F.col("to").isNull(), "detached").otherwise("manual")).otherwise(F.col("cluster_reason"))
    return rows.select(*[{"project_id": project, "cluster_reason": reason}.get(c, F.col(c)).alias(c) for c in stored.columns])


def upsert_membership(stored: DataFrame, new: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Memberships with ``changed``: a decision (included, excluded) replaces what is stored, a proposal only what isn't there."""
    told = new.select(*keys, F.col(status).alias("__new"))
    rows = stored.join(told, list(keys), "full")
    decides = F.coalesce(F.col("__new") != "proposed", F.lit(False)) | F.col(status).isNull()
    now = F.when(decides, F.col("__new")).otherwise(F.col(status))
    return rows.select(*keys, now.alias(status), (~now.eqNullSafe(F.col(status))).alias("changed"))


def find_or_create(stored: DataFrame, wanted: DataFrame, id: str, name: str) -> DataFrame:
    """(identity, id, created): each wanted name by its identity (case and spacing aside); the smallest stored id, or none yet."""
    identity = F.lower(F.regexp_replace(F.trim(F.col(name)), r"\s+", " ")).alias("identity")
    known = stored.select(identity, id).groupBy("identity").agg(F.min(id).alias(id))
    asked = wanted.select(identity).where("identity <> ''").distinct()
    return asked.join(known, "identity", "left").select("identity", id, F.col(id).isNull().alias("created"))


def append_ledger(stored: DataFrame | None, new: DataFrame, identity: Sequence[str]) -> DataFrame:
    """The ledger with new rows appended, written and read back; an error if a row is missing, and no identity twice."""
    from sparrowgrid.operators.tables import written

    fresh = new if stored is None else insert_absent(stored, new, identity)
    whole = fresh if stored is None else stored.unionByName(fresh)
    out = written(whole, "ledger")
    there, distinct = out.count(), out.select(*identity).distinct().count()
    if there != distinct:
        raise ValueError(f"the ledger holds {there} rows of {distinct} identities")
    return out


def last_seen(state: DataFrame | None, seen: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """(keys, first_seen, last_seen, seen): the state of an inventory after another walk."""
    walk = seen.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("seen"))
    if state is None:
        return walk
    return state.unionByName(walk).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen").alias("seen"))


def write_outcomes(written: DataFrame, clusters: DataFrame, id: str, component: str) -> DataFrame:
    """(id, outcome) of records just written, after clustering: attached to others, created a project, or unclustered."""
    sizes = clusters.where(F.col(component).isNotNull()).groupBy(component).agg(F.count("*").alias("__n"))
    rows = written.select(id).join(clusters.select(id, component), id, "left").join(sizes, component, "left")
    return rows.select(id, F.when(F.col("__n").isNull(), "unclustered").when(F.col("__n") == 1, "created").otherwise("attached").alias("outcome"))


def edit_log(stored: DataFrame, edits: DataFrame, key: str, field: str) -> DataFrame:
    """(key, field, previous, next, at) of the edits (key, value, at) that change something."""
    told = edits.select(key, F.col("value").alias("next"), "at")
    both = stored.select(key, F.col(field).alias("previous")).join(told, key)
    return both.where(~F.col("previous").eqNullSafe(F.col("next"))).select(key, F.lit(field).alias("field"), "previous", "next", "at")
