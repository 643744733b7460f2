"""Facts of many scopes against the operators of one scope, and exact medians whatever the sketch."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import compare, insights, scopes, stats
from spindrift.plans.lens import DAY_MS, Lens

FIELDS = "id int, regime string, bloc string, constellation string, operator string, country string, mission string, sector string, inclination double, mean_alt_km float, launch_ms long"
NOW = 1000 * DAY_MS


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    some = [(i, rng.choice(["LEO", "LEO", "MEO", "GEO"]), rng.choice(["US", "CN", "KR"]), rng.choice([None, "starlink", "gps"]), rng.choice("ABCD"), rng.choice(["US", "KR"]), "comms", "civil", rng.uniform(-1, 181), rng.choice([550.0, 550.0, rng.uniform(100, 50_000)]), rng.choice([None, rng.randrange(0, NOW)])) for i in range(1, 700)]
    return spark.createDataFrame(some, FIELDS).cache()


CONDITIONS = {"us": "bloc = 'US'", "geo": "regime = 'GEO'", "few": "id <= 2", "one": "id = 7", "none": "false", "null": "cast(null as boolean)", "all": "true"}


def each():
    return {k: F.expr(c) for k, c in CONDITIONS.items()}


def test_facts_as_of_each_scope_alone(spark, rows):
    seen = rows.filter("id % 3 = 0").select("id")
    got = {r["scope"]: r for r in scopes.facts(rows, each(), NOW, in_view=seen.unionByName(seen)).collect()}
    assert got.keys() == CONDITIONS.keys()
    for name, condition in each().items():
        mine, r = rows.filter(condition), got[name]
        total, last_365, last_30 = stats.recency(mine, NOW).first()
        assert (r["total"], r["last_365"], r["last_30"], r["in_view"]) == (total, last_365, last_30, mine.filter("id % 3 = 0").count())
        assert r["median_alt_km"] == stats.upper_median(mine).first()[0]
        assert [tuple(m) for m in r["modes"]] == [(m["inc"], m["count"]) for m in stats.inclination_modes(mine).orderBy("rank").collect()]
        band = stats.densest_band(mine).first()
        assert (r["band"] and tuple(r["band"])) == (band and tuple(band))
        for key in ("constellation", "operator", "country"):
            top = stats.top_entries(mine, key, 1).first()
            assert (r[f"top_{key}"] and tuple(r[f"top_{key}"])) == (top and (top["key"], top["n"]))
        assert r["regimes"] == ",".join(sorted({x["regime"] for x in mine.collect()}))
        assert (r["leo"], r["geo"], r["kr"]) == tuple(mine.filter(c).count() for c in ("regime = 'LEO'", "regime = 'GEO'", "bloc = 'KR'"))


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_medians_are_exact_whatever_the_sketch(spark, accuracy):
    """Coarse sketches, most rows equal, and values that fall to one side."""
    rng = random.Random(2)
    values = {"even": [rng.uniform(0, 1000) for _ in range(5000)], "equal": [550.0] * 3000 + [rng.uniform(0, 1000) for _ in range(2000)], "skewed": [rng.random() ** 40 * 1e6 for _ in range(5001)], "two": [1.0, 2.0]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, mean_alt_km double")
    got = {r["scope"]: r["median_alt_km"] for r in scopes.medians(df, {k: F.col("k") == k for k in values}, accuracy).collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in values.items()}


def test_counted_scopes_and_callers(spark, rows):
    counts = scopes.key_counts(rows, each(), NOW, counted=("all",))
    assert [tuple(r)[1:4] for r in counts.filter("scope = 'all'").collect()] == [("all", None, 699)]
    table = {r["side"]: r for r in compare.compare_table(rows, Lens(blocs=("US",)), Lens(blocs=("KR",)), NOW, in_view=rows.filter("id < 100")).collect()}
    n = {b: rows.filter(F.col("bloc") == b).count() for b in ("US", "KR")}
    assert {s: (r["total"], r["share"], r["wins_total"]) for s, r in table.items()} == {s: (n[b], n[b] / 699, n[b] > min(n.values())) for s, b in (("a", "US"), ("b", "KR"))}
    assert table["a"]["in_view"] == rows.filter("id < 100 and bloc = 'US'").count()
    # A plan of three passes, and of one where no median is asked for.
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation")
    assert scans(compare.compare_table(rows, Lens(blocs=("US",)), Lens(blocs=("KR",)), NOW)) == 3 and scans(insights.scope_insights(rows, NOW)) == 1
    assert compare.compare_table(rows.limit(0), Lens(blocs=("US",)), Lens(blocs=("KR",)), NOW).select("total", "median_alt_km", "wins_total").collect() == [(0, 0.0, False)] * 2


def test_sections_of_insights(spark):
    found = lambda n: spark.createDataFrame([(i * 2, f"i{i}", "v", "l", None) for i in range(n)], "ord int, id string, value string, label string, lens string")
    places = lambda n, where: [(r["id"], r["section"], r["place"]) for r in insights.shown(found(n), where).orderBy("ord").collect()]
    assert places(7, "view") == [*[(f"i{i}", "Worth knowing", i + 1) for i in range(3)], *[(f"i{i}", "Also in this view", i - 2) for i in range(3, 7)]]
    assert places(9, "overview")[-1] == ("i6", "More facts", 4) and len(places(6, "lens")) == 5 and places(0, "lens") == []
