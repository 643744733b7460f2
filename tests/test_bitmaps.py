"""Counts from bitmaps against counts of rows."""

import random

import pytest

from spindrift.operators import bitmaps, stats
from spindrift.plans.lens import DAY_MS, Lens

FIELDS = "id long, constellation string, country string, operator string, bloc string, mission string, regime string, sector string, launch_ms long"
NOW = 1000 * DAY_MS
LENSES = {
    "all": Lens(), "one": Lens(regimes=("GEO",)), "or": Lens(countries=("US", "KR")), "and": Lens(blocs=("US",), regimes=("LEO", "MEO"), sectors=("civil",)),
    "new": Lens(launched_within_days=30), "new us": Lens(countries=("US",), launched_within_days=365), "none": Lens(operators=("nobody",)), "apart": Lens(constellations=("gps",), operators=("nobody",)),
    "ids": Lens(ids=(3, 70_001, 5_000_000, -5)), "ids us": Lens(ids=tuple(range(1, 400)), countries=("US",)), "0 days": Lens(launched_within_days=0),
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    ids = [-40_000, -5, 0, 32_768, 32_769, 2**40, *range(1, 500), *range(70_000, 70_200)]
    some = [(i, rng.choice([None, "gps", "starlink"]), rng.choice(["US", "KR", "FR"]), rng.choice("AB"), rng.choice(["US", "EU"]), "nav", rng.choice(["LEO", "MEO", "GEO"]), rng.choice(["civil", "military"]), rng.choice([None, rng.randrange(600, 1001) * DAY_MS])) for i in ids]
    return spark.createDataFrame(some, FIELDS).cache()


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    # A row without an id is no bit, a repeated row no second one.
    return bitmaps.build(rows.unionByName(rows.limit(50)).unionByName(rows.limit(1).selectExpr("cast(null as bigint) as id", *rows.columns[1:])), str(tmp_path_factory.mktemp("bits") / "one"))


def test_counts(rows, index):
    got = {r["name"]: r["n"] for r in index.counts({k: (v,) for k, v in LENSES.items()}, NOW).collect()}
    assert got == {k: rows.filter(v.to_column(NOW)).count() for k, v in LENSES.items()}


def test_overlaps_and_intersections(rows, index):
    for a, b in (("or", "new"), ("and", "one"), ("ids", "all"), ("none", "or"), ("new us", "or")):
        assert index.overlap(LENSES[a], LENSES[b], NOW).first() == stats.overlap(rows, LENSES[a], LENSES[b], NOW).first()
    three = index.counts({"x": (LENSES["or"], LENSES["new us"], LENSES["ids us"])}, NOW).first()["n"]
    assert three == rows.filter(LENSES["or"].to_column(NOW) & LENSES["new us"].to_column(NOW) & LENSES["ids us"].to_column(NOW)).count()


def test_only_named_values_are_read(index, spark, rows, tmp_path):
    plan = index.counts({"x": (LENSES["or"],)}, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "In(key, [,KR,US])" in plan or "In(key," in plan
    with pytest.raises(ValueError, match="altitude"):
        index.counts({"x": (Lens(altitude=(1, 2)),)}, NOW)
    empty = bitmaps.build(rows.limit(0), str(tmp_path / "none"))
    assert empty.counts({"x": (Lens(),), "y": (LENSES["ids"],)}, NOW).collect() == [("x", 0), ("y", 0)]
