"""Entity resolution: signals to components, fuzzy names, stage evidence, significance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.functions.rules import STAGES, UNPROVEN, stage_rank
from sparrowgrid.functions.text import is_generic_party, money_points, similarity
from sparrowgrid.operators.dictionary import term_hits
from sparrowgrid.operators.graph import components
from sparrowgrid.operators.tables import drop, release, written


def connected(signals: DataFrame, record: str, key: str) -> DataFrame:
    """(record, component): records joined by any common key, the component being its smallest record.

    Each key links its records to the smallest of them, so a key with very many
    records costs one row each and is never gathered.  Null keys link nothing.
    """
    edges = written(signals.select(F.col(record).alias("r"), F.col(key).alias("k")).distinct(), "signals")
    first = edges.groupBy("k").agg(F.min("r").alias("a"))
    parts = components(edges.join(first, "k").where("r <> a").select("a", F.col("r").alias("b")), "a", "b")
    every = edges.select("r").distinct().join(parts.withColumnRenamed("node", "r"), "r", "left")
    out = written(every.select(F.col("r").alias(record), F.coalesce("component", "r").alias("component")), "connected")
    drop(edges, parts)
    return out


def guarded_union(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(r, part, component) of ``nodes`` (r, t): ``part`` by all links, ``component`` after taking ``links`` (a, b, at) in the order of ``at`` with no component ever holding two targets.

    A link that would join two targets is refused.  Plain components with one
    target at most take all their links.  In the others the order is kept
    without replaying it: nothing happens to a cluster before its first link, so
    one without a target surely takes that, and at most one cluster of a chain
    of such links has a target.  This halves the clusters without a target each
    round; then links within one target are all taken and the others refused.
    """
    links = written(links, "links")
    parts = components(links, "a", "b")
    nodes = written(nodes.join(parts.select(F.col("node").alias("r"), F.col("component").alias("c")), "r", "left").select("r", "t", F.coalesce("c", "r").alias("component")), "nodes")
    drop(parts)
    release(links.sparkSession)
    many = written(nodes.groupBy("component").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("component"), "many")
    if many.isEmpty():
        drop(links)
        return nodes.select("r", F.col("component").alias("part"), "component")
    # (r, c, t): a record, its cluster's smallest record and the cluster's target
    state = written(nodes.join(many, "component", "left_semi").select("r", F.col("r").alias("c"), "t"), "clusters")
    while True:
        clusters = state.select("c", "t").where("r = c")
        end = lambda x: clusters.select(F.col("c").alias(x), F.col("t").alias(f"t{x}"))
        open_ = written(links.join(end("a"), "a").join(end("b"), "b").where("a <> b and (ta is null or tb is null or ta = tb)").select("a", "b", "at", "ta", "tb"), "links")
        drop(links)
        both = open_.select(F.col("a").alias("x"), F.col("ta").alias("t"), F.col("b").alias("y"), "at").unionByName(open_.select(F.col("b").alias("x"), F.col("tb").alias("t"), F.col("a").alias("y"), "at"))
        picks = written(both.where("t is null").groupBy("x").agg(F.min_by("y", "at").alias("y")), "picks")
        last = picks.isEmpty()
        into = components(open_ if last else picks, "a" if last else "x", "b" if last else "y").select(F.col("node").alias("c"), F.col("component").alias("new"))
        moved = state.join(into, "c", "left").select("r", F.coalesce("new", "c").alias("c"), "t")
        targets = moved.groupBy("c").agg(F.min("t").alias("t"))
        before, state = state, written(moved.drop("t").join(targets, "c").select("r", "c", "t"), "clusters")
        drop(before, picks)
        if last:
            drop(open_)
            return nodes.join(state.select("r", "c"), "r", "left").select("r", F.col("component").alias("part"), F.coalesce("c", "component").alias("component"))
        at = lambda x: into.select(F.col("c").alias(x), F.col("new").alias(f"n{x}"))
        links = written(open_.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), "at"), "links")
        drop(open_)
        release(links.sparkSession)


def guarded_links(signals: DataFrame, record: str, key: str, place: str | None = None, alike: DataFrame | None = None) -> DataFrame:
    """(a, b, at): the links that keys give, in the order in which they are taken.

    A key links its first record to each of its others.  Keys come as they are
    first seen, by their first record and their ``place`` in it; a key's records
    follow in their own order.  After all of them come ``alike`` (a, b), pairs
    of keys whose first records are linked, in the order of the two keys.
    """
    at = F.lit(0).alias("p") if place is None else F.col(place).alias("p")
    rows = signals.select(F.col(record).alias("r"), F.col(key).alias("k"), at).where("k is not null")
    edges = rows.groupBy("k", "r").agg(F.min("p").alias("p"))
    heads = edges.groupBy("k").agg(F.min(F.struct("r", "p", "k")).alias("h"))
    turn = lambda phase, h, r, g: F.struct(F.lit(phase).alias("phase"), F.col(h).alias("h"), F.col(r).alias("r"), F.col(g).alias("g"))
    links = edges.join(heads, "k").where("r <> h.r").withColumn("g", F.col("h"))
    links = links.select(F.col("h.r").alias("a"), F.col("r").alias("b"), turn(0, "h", "r", "g").alias("at"))
    if alike is None:
        return links
    pairs = alike.select(F.col("a").alias("k"), "b").join(heads, "k").select("h", F.col("b").alias("k")).join(heads.withColumnRenamed("h", "g"), "k")
    pairs = pairs.select(F.least("h", "g").alias("h"), F.greatest("h", "g").alias("g")).where("h.r <> g.r").withColumn("r", F.col("g.r"))
    return links.unionByName(pairs.select(F.col("h.r").alias("a"), F.col("r").alias("b"), turn(1, "h", "r", "g").alias("at")))


def guarded_components(signals: DataFrame, record: str, key: str, target: str, place: str | None = None, alike: DataFrame | None = None) -> DataFrame:
    """(record, component) where no component holds two targets: ``guarded_union`` of ``guarded_links``.

    A record has its smallest target.  Null keys link nothing, and a record
    without any key is a component of its own.
    """
    nodes = signals.groupBy(F.col(record).alias("r")).agg(F.min(target).alias("t"))
    return guarded_union(nodes, guarded_links(signals, record, key, place, alike)).select(F.col("r").alias(record), "component")


def _pieces(rows: DataFrame) -> DataFrame:
    """Rows of ``fuzzy_pairs`` with one piece more each: of the gap that is widest for its edits, taken out of it and into the key.

    The piece at place i of a gap with e edits has i edits before it at most and
    e - i behind it, which also bounds how far it is shifted.
    """
    width = F.transform("gaps", lambda g: g["m"] / (g["e"] + 1))
    rows = rows.withColumn("g", F.array_position(width, F.array_max(width)).cast("int")).withColumn("gap", F.element_at("gaps", F.col("g")))
    rows = rows.select("*", "gap.t", "gap.m", "gap.e", F.explode(F.sequence(F.lit(0), F.col("gap.e"))).alias("i"))
    rows = rows.withColumns({"p": F.expr("cast(i * m div (e + 1) as int)"), "n": F.expr("cast((i + 1) * m div (e + 1) - i * m div (e + 1) as int)")})
    p, n, i, more = F.col("p"), F.col("n"), F.col("i"), F.length("t") - F.col("m")
    low = F.when(F.col("offered"), p).otherwise(F.greatest(F.lit(0), p - i, p + more - (F.col("e") - i)))
    high = F.when(F.col("offered"), p).otherwise(F.least(F.length("t") - n, p + i, p + more + (F.col("e") - i)))
    rows = rows.withColumns({"low": low, "high": high}).where("low <= high").withColumn("q", F.explode(F.sequence("low", "high")))
    q = F.col("q")
    left = F.struct(F.substring("t", F.lit(1), q).alias("t"), p.alias("m"), i.alias("e"))
    right = F.struct(F.substring("t", q + n + 1, F.length("t")).alias("t"), (F.col("m") - p - n).alias("m"), (F.col("e") - i).alias("e"))
    gaps = F.concat(F.slice("gaps", F.lit(1), F.col("g") - 1), F.array(left, right), F.slice("gaps", F.col("g") + 1, F.size("gaps")))
    # a gap with no more characters than edits tells nothing
    return rows.select(
        F.xxhash64("key", "g", "i", F.substring("t", q + 1, n)).alias("key"), "offered", (F.col("plain") & (q == p)).alias("plain"), "id", "x", "block", "d",
        F.filter(gaps, lambda g: g["m"] > g["e"]).alias("gaps"), (F.col("ways") * (F.col("e") * F.col("e") / 2 + F.col("e") + 1)).alias("ways"),
    )


def fuzzy_pairs(df: DataFrame, id: str, name: str, block: Column, least: float = 0.9, chars: int = 10, most: int = 4) -> DataFrame:
    """(a, b, similarity) of names in one block with a similarity of ``least`` or more; both of ``chars`` or more characters.

    A name of m characters may be d = (1 - least) * m edits away from a shorter
    one, so of its d + 1 even pieces one stands unchanged in the other.  Longer
    names offer their pieces, shorter ones ask for every length and shift that
    can be.  Where too many names offer the same piece (a common word, say)
    nothing is compared yet: what stands before and behind it is cut again, and
    names have to share a piece of that too, until few do or nothing is left to
    cut.  Too many are ``most`` for every way in which a name may ask so far, so
    that cutting never costs more than comparing.
    """
    names = df.where(F.length(name) >= chars).select(F.col(id).alias("id"), F.col(name).alias("x"), block.alias("block")).where("block is not null")
    names = written(names.distinct(), "names")
    asked = F.sequence(F.length("x"), F.floor(F.length("x") / least + 1e-9).cast("int"))
    sides = F.concat(F.array(F.struct(F.lit(True).alias("offered"), F.length("x").alias("m"))), F.transform(asked, lambda m: F.struct(F.lit(False).alias("offered"), m.alias("m"))))
    rows = names.select("*", F.inline(sides)).withColumn("d", F.floor((1 - least) * F.col("m") + 1e-9).cast("int"))
    gaps = F.array(F.struct(F.col("x").alias("t"), "m", F.col("d").alias("e")))
    rows = rows.select(F.xxhash64("block", "m").alias("key"), "offered", (F.length("x") == F.col("m")).alias("plain"), "id", "x", "block", "d", gaps.alias("gaps"), F.lit(1.0).alias("ways"))
    found, read = None, names
    while True:
        cut = _pieces(rows)
        # a name that asks for its own piece in its own place meets nothing new
        keys = cut.groupBy("key").agg(F.count_if("offered").alias("n"), F.count_if(~F.col("offered") & ~F.col("plain")).alias("others")).where("n > 1 or n > 0 and others > 0")
        met = written(cut.join(keys.select("key", "n"), "key"), "pieces")
        drop(read)
        many = (F.col("n") > most * F.col("ways")) & (F.size("gaps") > 0)
        rows, few, read = met.where(many).drop("n"), met.where(~many), met
        longer = few.where("offered").select("key", F.col("id").alias("b"), F.col("x").alias("y"), F.col("block").alias("in"))
        # shuffled: pieces are many times their file, by whose size Spark would broadcast them
        both = few.where("not offered").select("key", F.col("id").alias("a"), "x", "block", "d").hint("merge").join(longer, "key").where("block = in and (length(x) < length(y) or a < b)")
        near = both.where(F.call_function("levenshtein", F.col("x"), F.col("y"), F.col("d")) >= 0)
        near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), similarity("x", "y").alias("similarity")).where(F.col("similarity") >= least)
        near = written(near.distinct(), "near")
        found = near if found is None else found.unionByName(near)
        if rows.isEmpty():
            drop(met)
            return found.distinct()


def consolidate(names: DataFrame, name: str = "name", least: float = 0.9) -> DataFrame:
    """(name, canonical): sorted names, each taking the first earlier one it is like; the shorter of two wins.

    Only names with one first word can match.  Similar pairs are found by joins;
    the order is replayed inside each group of names that such pairs connect,
    and a name without a pair is its own.
    """
    each = written(names.select(F.col(name).alias("name")).where(F.col("name") != "").distinct(), "names")
    pairs = written(fuzzy_pairs(each.withColumn("id", F.col("name")), "id", "name", F.split("name", " ")[0], least), "alike").select("a", "b")
    parts = components(pairs, "a", "b")
    grouped = pairs.join(parts.select(F.col("node").alias("a"), "component"), "a")

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        like = set(zip(group["a"], group["b"], strict=True))
        found: dict[str, str] = {}
        canon: list[str] = []
        for n in sorted({*group["a"], *group["b"]}):
            match = next((c for c in canon if (min(c, n), max(c, n)) in like), None)
            if match is None:
                canon.append(n)
                found[n] = n
            elif len(n) < len(match):
                canon[canon.index(match)] = n
                found = {k: n if v == match else v for k, v in found.items()} | {n: n}
            else:
                found[n] = match
        return pd.DataFrame({"name": list(found), "canonical": list(found.values())})

    told = grouped.groupBy("component").applyInPandas(replay, "name string, canonical string")
    return each.join(told, "name", "left").select("name", F.coalesce("canonical", "name").alias("canonical"))


def proven_stage(evidence: DataFrame, project: str, stage: str, filing: str, attributed: str) -> DataFrame:
    """(project, stage, refused, press_reported) from records' stages.

    Records that aren't filings count as filed.  Above approved, a stage needs
    an attributed record or two filings of it, unless the project has one
    record only.
    """
    rank = stage_rank(stage)
    rows = evidence.select(
        project, rank.alias("rank"), F.when(F.col(filing), rank).otherwise(0).alias("capped"), F.col(filing).alias("filing"), F.col(attributed).alias("attributed")
    )
    by_rank = rows.groupBy(project, "rank").agg(
        F.count("*").alias("n"), F.count_if("filing").alias("filings"), F.max("capped").alias("capped"), F.bool_or(F.col("attributed") & F.col("filing")).alias("attributed")
    )
    bar = STAGES.index(UNPROVEN)
    agg = by_rank.groupBy(project).agg(
        F.sum("n").alias("n"),
        F.max("rank").alias("all"),
        F.max("capped").alias("single"),
        F.max(F.when((F.col("capped") <= bar) | F.col("attributed") | (F.col("filings") >= 2), F.col("capped"))).alias("proven"),
        F.max(F.when(F.col("n") > F.col("filings"), F.col("rank"))).alias("press"),
    )
    decided = F.when(F.col("n") <= 1, F.col("single")).otherwise(F.coalesce("proven", F.lit(0)))
    name = lambda c: F.element_at(F.array(*map(F.lit, STAGES)), (c + 1).cast("int"))
    return agg.select(
        project, name(decided).alias("stage"), F.when(decided < F.col("all"), name(F.col("all"))).alias("refused"),
        F.when(F.coalesce("press", F.lit(0)) > decided, name(F.col("press"))).alias("press_reported"),
    )


# The weight of each signal, the penalty, points of stages, tiers of venues, sources by their authority.
WEIGHTS = {"stage": 18, "target": 15, "money": 10, "party": 10, "depth": 12, "venue": 12, "representation": 8, "source": 8, "span": 3, "recency": 4}
TRANSACTION = -12
STAGE_POINTS = {"under construction": 18, "permitted": 16, "approved": 14, "hearing scheduled": 10, "filed": 6, "stalled": 2, "dormant": 0}
TOP_VENUES = ("Integrated Resort", "Casino/Gaming", "Theme Park", "Amusement Park", "Waterpark", "Arena/Stadium", "Entertainment Destination", "Entertainment District", "Resort")
MIDDLE_VENUES = ("Hotel", "Museum", "Convention/Expo", "Aquarium", "Science Center", "Zoo", "Family Entertainment Center", "Heritage/Cultural Site", "Master-Planned Community")
FILING_SOURCES = ("nyc-zap", "nyc-ceqr", "agenda-portal", "legistar", "clark-tab", "ceqanet", "cftod-pdf", "sfwmd", "govdoc")
NOTICE_SOURCES = ("nyc-city-record",)


def source_share(source: Column) -> Column:
    """How much of the source's weight a record of it earns."""
    return F.when(source.isin(*FILING_SOURCES), 1.0).when(source.isin(*NOTICE_SOURCES), 0.6).otherwise(0.3)


def significance(
    *, amount: Column, private: Column, represented: Column, stage: Column, records: Column, span_days: Column, venue: Column, watched: Column,
    source: Column, idle_days: Column, transactions: Column,
) -> tuple[Column, Column]:
    """(score, detail) of a project: ten signals less the penalty for pure transactions, within 0 and 100, to one place; and a map of the parts.

    ``amount`` is the largest figure stated, ``records`` the number of live
    records, ``span_days`` null under two dated ones, ``source`` the best
    ``source_share``, ``idle_days`` since the last activity.  A project that is
    no known kind of venue loses points; one record has no depth.
    """
    w = {k: float(v) for k, v in WEIGHTS.items()}
    stages = F.create_map(*[F.lit(x) for k, v in STAGE_POINTS.items() for x in (k, float(v))])
    points = {
        "money": money_points(amount, w["money"]),
        "party": F.when(private, w["party"]),
        "representation": F.when(represented, w["representation"]),
        "stage": F.element_at(stages, stage),
        "depth": F.when(records > 1, F.least(F.lit(1.0), F.log10(records) / F.log10(F.lit(12.0))) * w["depth"]),
        "span": F.when(span_days.isNotNull(), F.least(F.lit(1.0), span_days / 730.0) * w["span"]),
        "venue": F.when(F.coalesce(venue, F.lit("")) == "", -0.5 * w["venue"]).when(venue.isin(*TOP_VENUES), w["venue"]).when(venue.isin(*MIDDLE_VENUES), 0.65 * w["venue"]).otherwise(0.3 * w["venue"]),
        "target": F.when(watched, w["target"]),
        "source": source * w["source"],
        "recency": F.when(idle_days <= 90, w["recency"]).when(idle_days <= 365, 0.7 * w["recency"]).when(idle_days <= 730, 0.4 * w["recency"]),
        "transaction": F.when(transactions, float(TRANSACTION)),
    }
    tenth = lambda x: F.floor(F.coalesce(x, F.lit(0.0)) * 10 + 0.5) / 10
    rounded = {k: tenth(v) for k, v in points.items()}
    total = sum(rounded.values(), F.lit(0.0))
    score = tenth(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)))
    return score, F.map_from_arrays(F.array(*map(F.lit, rounded)), F.array(*rounded.values()))


def single_entity_hits(records: DataFrame, entities: DataFrame, id: str, text: str, market: str, entity: str) -> DataFrame:
    """(id, entity): records with the one known entity of their market that their text holds as whole words; texts with several are ambiguous and left out."""
    hits = term_hits(records, entities.select(F.col(entity).alias("entity"), market), id, text, "entity", market)
    per = hits.groupBy(id).agg(F.min("entity").alias("entity"), F.max("entity").alias("__last"))
    return per.where(F.col("entity") == F.col("__last")).select(id, "entity")


def without_contained(rows: DataFrame, group: str, value: str, least: int = 6) -> DataFrame:
    """Rows whose value isn't a part of a longer value of the same group; values under ``least`` characters stay.

    A longer value offers each of its stretches of ``least`` characters; a value
    asks with its first one, so only values that share it are compared.
    """
    values = rows.select(F.col(group).alias("__g"), F.col(value).alias("__v")).where(F.length("__v") >= least).distinct()
    starts = F.sequence(F.lit(1), F.length("__v") - least + 1)
    offered = values.select("__g", F.col("__v").alias("__long"), F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("__v", i, F.lit(least))))).alias("__gram"))
    asked = values.withColumn("__gram", F.substring("__v", 1, least))
    inside = (F.length("__long") > F.length("__v")) & F.contains(F.col("__long"), F.col("__v"))
    parts = asked.join(offered, ["__g", "__gram"]).where(inside).select(F.col("__g").alias(group), F.col("__v").alias(value)).distinct()
    return rows.join(parts, [group, value], "left_anti").select(*rows.columns)


def merge_prefixes(keys: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, merged): each key with the longest key of its group that it begins, at a word's end.

    Every key tells its own beginnings, so keys meet by equality.
    """
    each = keys.select(group, key).distinct()
    words = F.split(key, " ")
    begins = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    longer = each.where(F.size(words) > 1).select(group, F.explode(begins).alias("__short"), F.col(key).alias("__long")).where(F.col("__long").startswith(F.concat(F.col("__short"), F.lit(" "))))
    best = longer.groupBy(group, F.col("__short").alias(key)).agg(F.max_by("__long", F.struct(F.length("__long"), "__long")).alias("merged"))
    return each.join(best, [group, key], "left").select(group, key, F.coalesce("merged", key).alias("merged"))


def richest(rows: DataFrame, key: str, id: str, *columns: str) -> DataFrame:
    """Of rows that share a key the one with most columns filled; ties to the smaller id."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(filled, -F.col(id))).alias("__row"))
    return best.select(*[F.col(c) if c == key else F.col(f"__row.{c}").alias(c) for c in rows.columns])


def near_duplicate_records(records: DataFrame, id: str, block: list[str], words: str, least: float = 0.6, shared: int = 4) -> DataFrame:
    """(id, kept_id): records of one block (project and day) merged greedily.

    Two are the same if their word sets are equal or share ``shared`` words or
    more (one at least) and that is ``least`` of the smaller set; the record
    with more words stays, ties to the smaller id, and the others go to the
    first that stays.  Ids are unique; null words are ignored.

    Equal sets are one row.  Pairs are sets that meet in one of the rarest
    words of the smaller, of which one must be shared.  In rounds over the
    pairs, sets that no undecided one is before stay, and those like them go.
    """
    if shared < 1:
        raise ValueError("shared must be 1 or more")
    at = F.struct(*[F.col(c) for c in block]).alias("block")
    rows = records.select(F.col(id).alias("id"), at, F.array_sort(F.array_distinct(F.array_compact(F.coalesce(words, F.array())))).alias("w"))
    sets = written(rows.groupBy("block", "w").agg(F.min("id").alias("s")), "sets")
    each = sets.select("s", F.explode("w").alias("word"))
    ranks = each.groupBy("word").agg(F.count("*").alias("n"))
    by_rank = each.join(ranks, "word").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("rare"))
    need = F.greatest(F.lit(shared), F.ceil(F.lit(float(least)) * F.size("w")))
    small = sets.join(by_rank, "s").withColumn("need", need.cast("int")).where(F.col("need") <= F.size("w"))
    small = small.withColumn("rare", F.slice(F.col("rare.word"), F.lit(1), F.size("w") - F.col("need") + 1))
    small = small.select("block", F.col("s").alias("y"), F.col("w").alias("v"), "rare", "need", F.explode("rare").alias("word"))
    large = sets.select("block", F.col("s").alias("x"), "w", F.explode("w").alias("word"))
    before = (F.size("w") > F.size("v")) | (F.size("w") == F.size("v")) & (F.col("x") < F.col("y"))
    once = F.array_intersect("rare", "w")[0] == F.col("word")
    near = small.join(large, ["block", "word"]).where(before & once & (F.size(F.array_intersect("v", "w")) >= F.col("need")))
    pairs = written(near.select("x", "y", F.struct(-F.size("w"), "x").alias("place")), "pairs")
    gone, left = None, pairs.select("x", "y")
    while not left.isEmpty():
        stay = left.select("x").distinct().join(left.select(F.col("y").alias("x")).distinct(), "x", "left_anti")
        lost = written(left.join(stay, "x", "left_semi").select("y").distinct(), "lost")
        gone = lost if gone is None else gone.unionByName(lost)
        left = written(left.join(lost, "y", "left_anti").join(lost.select(F.col("y").alias("x")), "x", "left_anti"), "pairs")
    kept = sets.select("block", "w", "s", F.col("s").alias("kept_id"))
    if gone is not None:
        into = pairs.join(gone, "y", "left_semi").join(gone.select(F.col("y").alias("x")), "x", "left_anti").groupBy("y").agg(F.min_by("x", "place").alias("into"))
        kept = kept.join(into.withColumnRenamed("y", "s"), "s", "left").select("block", "w", F.coalesce("into", "s").alias("kept_id"))
    return rows.join(kept.select("block", "w", "kept_id"), ["block", "w"]).select(F.col("id").alias(id), "kept_id")


def project_name(rungs: dict[str, Column], least: int = 1) -> Column:
    """struct<name, rung>: the first rung that gives a name."""
    found = [F.when(F.length(F.trim(c)) >= least, F.struct(F.trim(c).alias("name"), F.lit(k).alias("rung"))) for k, c in rungs.items()]
    return F.coalesce(*found)


def parties(records: DataFrame, id: str, roles: dict[str, str], key) -> DataFrame:
    """(id, role, party, key): named parties of every record, one row a role and key; generic public bodies are refused."""
    told = F.array(*[F.struct(F.lit(r).alias("role"), F.trim(F.col(c)).alias("party")) for c, r in roles.items()])
    # keys are made before the rows are, so that no filter makes them again
    named = F.transform(F.filter(told, lambda t: F.length(t["party"]) > 0), lambda t: F.struct(t["role"].alias("role"), t["party"].alias("party"), key(t["party"]).alias("key")))
    rows = records.select(id, F.inline(named))
    return rows.where(~is_generic_party("key")).groupBy(id, "role", "key").agg(F.min("party").alias("party")).select(id, "role", "party", "key")


def party_blocks(parties_: DataFrame, id: str) -> DataFrame:
    """(id, key, display, roles, mentions): a project's parties folded by key, most mentioned first by ``place``; the least shouted name shows."""
    shouted = F.length(F.regexp_replace("party", "[^A-Z]", ""))
    per = parties_.groupBy(id, "key").agg(F.min_by("party", F.struct(shouted, "party")).alias("display"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("mentions"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy(id).orderBy(F.desc("mentions"), "key")))
