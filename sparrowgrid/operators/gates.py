"""Gate decisions with what is watched and known met by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowgrid.functions import taxonomy as T
from sparrowgrid.operators.dictionary import term_hits


def decide(candidates: DataFrame, gate: Column, watched: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, admitted, reason, term, entity): every candidate's decision, with the watched term or known entity that it rests on.

    ``candidates`` has id, source, market, said, wide (what the watch list
    reads; null: ``said``) and single_purpose; ``gate`` is the verdict on
    ``said``.  ``watched`` has term, strong and weak_alone: terms that are weak
    alone admit nothing, a source that only takes strong terms wants one of
    those.  ``entities`` has market, entity and place: the first by ``place``
    that the record's own text names in its market counts, but not as the name
    of a street.  Texts and terms meet as whole words by a term's rarest word.
    """
    rows = candidates.withColumns({"__wide": F.coalesce("wide", "said"), "__g": gate, "__home": F.coalesce(T.is_detached_residential("said"), F.lit(False))})
    terms = watched.where(~F.coalesce("weak_alone", F.lit(False))).groupBy("term").agg(F.bool_or(F.coalesce("strong", F.lit(False))).alias("strong"))
    met = term_hits(rows, terms, "id", "__wide", "term").join(terms, "term").groupBy("id").agg(F.bool_or("strong").alias("strong"), F.min("term").alias("term"))
    places = entities.groupBy("market", "entity").agg(F.min("place").alias("place"))
    named = term_hits(rows, places, "id", "said", "entity", "market", streets=False)
    known = named.join(rows.select("id", "market"), "id").join(places, ["market", "entity"]).groupBy("id").agg(F.min_by("entity", F.struct("place", "entity")).alias("entity"))
    every = rows.join(met, "id", "left").join(known, "id", "left")
    made = T.decision(
        F.col("__g.reason"), F.col("__g.matched"), F.coalesce("source", F.lit("")), F.coalesce("strong", F.lit(False)), F.col("term").isNotNull(), F.col("entity"), F.col("__home"),
        F.coalesce("single_purpose", F.lit(False)),
    )
    out = every.select("id", made.alias("d"), "term", "entity").select("id", "d.admitted", "d.reason", "term", "entity")
    only = lambda c, reason: F.when(F.col("reason") == reason, F.col(c)).alias(c)
    return out.select("id", "admitted", "reason", only("term", "bypass"), only("entity", "known-entity"))
