"""Outlines and heading trees against plain Python, and their edge cases."""

import random
import re

import pytest

from sparrowgrid.sources import sections


def outlined(pages):
    """(num, title) of a packet, line by line."""
    end = next((i for i, p in enumerate(pages[:6]) if re.search(r"\badjourn\b", p or "", re.I)), 0) or min(len(pages) - 1, 2)
    items = []
    for raw in "\n".join(p or "" for p in pages[: end + 1]).split("\n"):
        line = raw.strip()
        if m := re.match(r"(\d+\.\d+|\d+\.)\s*(.*)$", line):
            items.append([m[1].rstrip("."), m[2].strip()])
        elif line and items:
            items[-1][1] = f"{items[-1][1]} {line}".strip()
    plain = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    return [tuple(i) for i in items if len(plain(i[1])) >= 6 and plain(i[1]) not in sections.PROCEDURAL]


@pytest.mark.parametrize("seed", range(2))
def test_outline_by_hand(spark, seed):
    rng = random.Random(seed)
    line = lambda: rng.choice(["1. Roll Call", "2.  A lease of land", "6.4 Change order", " 7.", "", "  goes on", "12.5% of it", "ADJOURN", "3. x", "adjourned early", "10.Tight title"])
    packets = [(i, [None if rng.random() < 0.1 else "\n".join(line() for _ in range(rng.randrange(6))) for _ in range(rng.randrange(9))]) for i in range(80)] + [(900, None), (901, [])]
    got = {}
    for r in sections.outline(spark.createDataFrame(packets, "id long, pages array<string>"), "id", "pages").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.num, r.title))
    assert got == {i: x for i, p in packets if p and (x := outlined(p))} and len(got) > 30


def test_heading_tree_by_hand(spark):
    rng = random.Random(3)
    rows = [(d, p, rng.randrange(5), f"h{p}") for d in range(20) for p in range(rng.randrange(30))]
    want = {}
    for d in range(20):
        stack = []
        for _, p, level, title in sorted(r for r in rows if r[0] == d):
            stack = [s for s in stack if s[0] < level] + [(level, title)]
            want[d, p] = [t for _, t in stack]
    rng.shuffle(rows)
    got = sections.heading_tree(spark.createDataFrame(rows, "d long, p int, level int, title string"), "d", "p", "level", "title").collect()
    assert {(r.d, r.p): r.path for r in got} == want and len(got) == len(rows)


def test_plan_sections(spark):
    pages = ["Theme park zoning", "tourist entertainment", "Tourist and entertainment district", "entertainment, tourist acre", None, "a theme park district", "theme park only"]
    got = sections.plan_sections(spark.createDataFrame([(1, pages), (2, None), (3, [])], "id long, pages array<string>"), "id", "pages").orderBy("page").collect()
    assert [(r.page, r.hits, r.focus) for r in got] == [(1, "theme park", "theme park provisions"), (3, "entertainment, tourist", "entertainment / tourist provisions"), (6, "theme park", "theme park provisions")]
