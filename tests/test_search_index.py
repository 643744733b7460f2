"""The stored index gives what a search over all names gives, and reads little of itself."""

import random

import pytest

from spindrift.operators import search, search_index

FIELDS = "id long, name string, cospar string, constellation string, operator string, country string, bloc string, mission string, regime string"


def some(n, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["STAR", "LINK", "SAT", "COSMOS", "iss", "Straße", "É", "A", "X-9", "漢字"])
    return [(i, rng.choice(["", " "]).join(word() for _ in range(rng.randrange(1, 4))) + rng.choice(["", f" {i % 50}"]), f"{1990 + i % 30}-{i % 100:03d}A" if i % 4 else None, rng.choice([None, "starlink"]), rng.choice(["SpaceX", "Star Co"]), "US", "US", "comms", "LEO") for i in range(n)]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(some(900), FIELDS).cache()


@pytest.fixture(scope="module")
def index(catalog, tmp_path_factory):
    return search_index.build(catalog, str(tmp_path_factory.mktemp("index") / "one"))


RAW = ["star", "S", "SATCOSMOS", "link 4", "osm", "7", "12", "1995-005a", "strasse", "straße", "é", "字", "x-9", "nothing here", "", "hubble", "STARLINKSAT 3"]


@pytest.mark.parametrize("step", [4_096, 20])
def test_satellites_as_without_an_index(catalog, index, monkeypatch, step):
    monkeypatch.setattr(search_index, "FIRST_STEP", step)
    for raw in RAW:
        for limit in (60,) if step == 20 else (8,):
            got, want = ([tuple(r) for r in f.collect()] for f in (index.satellites(raw, limit), search.search_satellites(catalog, raw, limit)))
            assert got == want, raw


def test_merged_as_without_an_index(catalog, index):
    for raw in ("star", "link", "us", "leo", "é"):
        assert [tuple(r) for r in index.search(raw).collect()] == [tuple(r) for r in search.search(catalog, raw).collect()]


def test_steps_go_from_short_to_long(index, monkeypatch):
    monkeypatch.setattr(search_index, "FIRST_STEP", 20)
    steps, lengths = index._steps("size"), index.lengths["size"]
    assert steps[0][0] == lengths[0][0] and steps[-1][1] == lengths[-1][0] and all(a[1] < b[0] for a, b in zip(steps, steps[1:])) and len(steps) < 8
    assert index.rarest("SATX-9") in {"ATX", "TX-", "X-9"} and index.rarest("QQQQ") is None


def test_filters_reach_the_files(catalog, index):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram" in plan(index.parts("COSMOS")) and "StringContains(upper" in plan(index.parts("COSMOS"))
    assert "StringStartsWith(upper" in plan(index._table("names").filter("startswith(upper, 'STAR')"))


def test_odd_catalogues(spark, tmp_path):
    rows = [(None, "NOBODY", *[None] * 7), (5, None, *[None] * 7), (6, "", *[None] * 7), (7, "AB", *[None] * 7)]
    index = search_index.build(spark.createDataFrame(rows, FIELDS), str(tmp_path / "odd"))
    assert [r["id"] for r in index.satellites("ab").collect()] == [7] and index.satellites("nobody").count() == 0
    empty = search_index.build(spark.createDataFrame([], FIELDS), str(tmp_path / "none"))
    assert empty.satellites("ab").count() == 0 and empty.satellites("7").count() == 0
