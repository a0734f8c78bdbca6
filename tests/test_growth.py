"""What is compared and read must not grow faster than the input."""

import random

from pyspark.sql import functions as F

from sparrowgrid.operators import resolve


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_names_that_end_alike_are_not_all_compared(spark, monkeypatch):
    seen = []
    written = resolve.written

    def counted(df, name):
        out = written(df, name)
        if name == "pieces":
            few = out.where("n <= 4 * ways or size(gaps) = 0").groupBy("key").agg((F.count_if("offered") * F.count_if(~F.col("offered"))).alias("n"))
            seen.append(few.agg(F.sum("n")).first()[0] or 0)
        return out

    monkeypatch.setattr(resolve, "written", counted)
    rng = random.Random(3)
    names = sorted({f"anvil {rng.randrange(16**12):012x} partnerz" for _ in range(4000)})
    names += [n.replace("z", "y") for n in names[:5]]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.a, r.b) for r in resolve.fuzzy_pairs(df, "name", "name", F.lit("m")).collect()}
    # all names share their last piece: 16 million pairs would meet
    assert got == {(b, a) for a, b in zip(names[:5], names[-5:], strict=True)}
    assert 0 < sum(seen) < 100 * len(names)


def test_pieces_of_pieces_miss_no_pair(spark):
    rng = random.Random(5)
    names = []
    for _ in range(60):
        name = "anvil " + "".join(rng.choice("01") for _ in range(rng.randint(4, 14))) + rng.choice(["", " partner", " partnerz", " partner é"])
        names.append(name)
        for _ in range(2):
            t = list(name)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 1)] = rng.choice(["", "0", "a"])
            names.append("".join(t))
    rows = [(f"k{i}", n, rng.choice("mn")) for i, n in enumerate(names)]
    got = resolve.fuzzy_pairs(spark.createDataFrame(rows, "id string, name string, market string"), "id", "name", F.col("market"), 0.8, most=1).collect()
    want = {}
    for i, (a, x, m) in enumerate(rows):
        for b, y, n in rows[i + 1 :]:
            if m == n and min(len(x), len(y)) >= 10:
                like = 1 - edits(x, y) / max(len(x), len(y))
                if like >= 0.8:
                    want[min(a, b), max(a, b)] = round(like, 9)
    assert {(r.a, r.b): round(r.similarity, 9) for r in got} == want and len(got) == len(want) > 0


def test_patterns_are_asked_of_few_and_find_the_same(spark):
    from sparrowgrid.functions import text
    from sparrowgrid.operators import signals

    said = [
        "A CITY-INITIATED plan", "Location: CityWide", "city initiated", "initiated by a city", "the annual budget", "Annual  budget", "appropriations limits", "an appropriation",
        "Adopting the fiscal year 2020 budget", "apn: 123-45-678-901 and APN 1234-56789", "Project: Old Mill", "project : no", "at 12 north elm street today", "at 1 elm street",
        "at 100\tmain st and 200 oak ave, city hall", "packets and a PACKET", "The following matters have been scheduled", "BL2020-1234 and Z-1-A, rs2021-001", "", None,
    ]
    rows = spark.createDataFrame([(x, m) for x in said for m in ("Nashville", "Phoenix", None)], "title string, market string")
    rows = rows.selectExpr("*", "cast(null as string) as body", "title as url", "'x' as source", "'' as representative", "'' as presented_by")
    held = [(signals.CITYWIDE, signals.IN_CITYWIDE), (signals.FISCAL, signals.IN_FISCAL), (signals.CONTAINER_TITLE, signals.IN_CONTAINER)]
    for pattern, words in held:
        assert rows.where(~signals._holds(F.col("title"), pattern, words).eqNullSafe(F.col("title").rlike(pattern))).count() == 0
    got = {(r.title, r.market): (r.roots, r.sites) for r in rows.select("title", "market", signals.case_roots().alias("roots"), signals.site_keys().alias("sites")).collect()}
    assert got["BL2020-1234 and Z-1-A, rs2021-001", "Nashville"][0] == ["bl2020-1234", "rs2021-001"] and got["BL2020-1234 and Z-1-A, rs2021-001", None][0] == []
    assert got["apn: 123-45-678-901 and APN 1234-56789", None][1] == ["apn:123-45-678-901", "apn:1234-56789"] and got["Project: Old Mill", None][1] == ["proj:old mill"]
    assert got["at 12 north elm street today", None][1] == ["addr:12 north elm street"] and got["at 1 elm street", None][1] == [] and got[None, "Phoenix"] == ([], [])
    names = {"A & B Holdings LLC": "a b", "The Group Holdings": "the", "Sand, LLC and Stone, Inc.": "sand", "LLC": "llc", "Partners Trust": "partners", "Andover Co Group": "andover"}
    keys = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.entity_key("n").alias("k")).collect()
    assert {r.n: r.k for r in keys} == names
    # with no watched project nothing is searched for one
    assert "ballot" not in spark._jvm.PythonSQLUtils.explainString(signals.emit(rows.selectExpr("*", "1L as id", "'' as location", "'' as stream", "'' as applicant"))._jdf.queryExecution(), "simple")
