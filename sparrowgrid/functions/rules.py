"""Ordered rule cascades: stage ladder, admission gate, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowgrid.functions.predicates import col, whole_word, word_hits

# The ladder of stages and the states that aren't on it.
STAGES = ("filed", "hearing scheduled", "approved", "permitted", "under construction", "operating")
STATES = ("stalled", "dormant")
#: The highest stage that one record alone can prove.
UNPROVEN = "approved"


def first_match(rules: Sequence[tuple[Column, object]], otherwise=None) -> Column:
    """The value of the first rule that holds."""
    out = None
    for when, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def keyword_rules(c: str | Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise=None) -> Column:
    """The label of the first rule one of whose whole words the text holds."""
    found = []
    for label, words in rules:
        any_word = F.lit(False)
        for w in words:
            any_word = any_word | whole_word(c, w)
        found.append((any_word, label))
    return first_match(found, otherwise)


def stage_rank(c: str | Column) -> Column:
    """Place on the ladder from 0; -1 off it."""
    return F.array_position(F.array(*map(F.lit, STAGES)), F.coalesce(col(c), F.lit(""))).cast("int") - 1


def transition(before: str | Column, after: str | Column) -> Column:
    """advanced or corrected on the ladder; liveness if either end is off it."""
    a, b = stage_rank(before), stage_rank(after)
    return F.when((a < 0) | (b < 0), "liveness").when(b > a, "advanced").otherwise("corrected")


def gate(text: str | Column, strong: Sequence[str], weak: Sequence[str], action: Sequence[str], deal: Sequence[str], excluded: Sequence[str], outside: Sequence[str] = ()) -> Column:
    """struct<matched, reason, hits...>: exclusions, then strong words, out-of-vertical words, weak with action, deals, weak alone."""
    names = ("strong", "weak", "action", "deal", "excluded", "outside")
    hits = {n: word_hits(text, w) if w else F.array().cast("array<string>") for n, w in zip(names, (strong, weak, action, deal, excluded, outside), strict=True)}
    some = {n: F.size(h) > 0 for n, h in hits.items()}
    reason = first_match(
        [
            (some["excluded"], "excluded"),
            (some["strong"], "strong"),
            (some["outside"], "out-of-vertical"),
            (some["weak"] & some["action"], "weak+action"),
            (some["deal"], "deal"),
            (some["weak"], "weak-without-action"),
        ],
        "no-match",
    )
    return F.struct(reason.isin("strong", "weak+action", "deal").alias("matched"), reason.alias("reason"), *[h.alias(f"{n}_hits") for n, h in hits.items()])


def coverage_state(dead: Column, degraded: Column, records: Column, newest_days: Column, projects: Column, named: Column, stale_days: int = 90, least: int = 3, share: float = 0.5) -> Column:
    """The worst thing true of a market's coverage."""
    return first_match(
        [
            (dead, "dead"),
            (degraded, "degraded"),
            (records == 0, "thin"),
            (newest_days.isNull(), "thin"),
            (newest_days > stale_days, "stale"),
            (projects == 0, "thin"),
            ((projects >= least) & (named / projects < share), "thin"),
        ],
        "live",
    )


def liveness(next_milestone: Column, last_activity: Column, now: Column, months: int = 12) -> Column:
    """Why a project is live, or dormant."""
    return first_match(
        [
            (next_milestone.isNotNull(), "future milestone"),
            (last_activity.isNull(), "undated"),
            (last_activity >= F.add_months(now, -months), "recent activity"),
        ],
        "dormant",
    )
