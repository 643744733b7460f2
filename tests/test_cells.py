"""Views from cells give what views of all points give, and open fewer folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import cells, view

POINTS = "id long, x double, y double, z double, style int, cell string"


def shell(n, seed):
    """Points in three shells, a crowd at one place, and some without a position."""
    rng = np.random.default_rng(seed)
    d = rng.normal(size=(n, 3))
    d *= (rng.choice([1.08, 4.2, 6.6], n, p=[0.7, 0.1, 0.2]) / np.linalg.norm(d, axis=1))[:, None]
    d[: n // 5] = [0.0, 0.9, 0.7]
    rows = [(i, *map(float, p), int(i % 4), "mine") for i, p in enumerate(d)]
    return [*rows, (n, None, None, None, 2, "mine"), (n + 1, float("nan"), 0.0, 0.0, 2, "mine")]


CAMERAS = [view.Camera.looking_at_centre(x, y, z, 1.6, offset) for x, y, z, offset in [(0.0, 0.0, 5.0, (0.0, 0.0)), (1.0, 2.0, 0.5, (0.1, -0.1)), (9.0, -3.0, 4.0, (0.0, 0.0)), (0.3, 1.4, 0.2, (0.0, 0.0)), (0.0, 30.0, 0.1, (0.2, 0.0))]]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(shell(3000, 4), POINTS).cache()


@pytest.fixture(scope="module")
def stored(points, tmp_path_factory):
    return cells.build(points, str(tmp_path_factory.mktemp("cells") / "one"), per_cell=60)


@pytest.mark.parametrize("camera", CAMERAS)
def test_views_are_the_same(points, stored, camera):
    got, want = ({r["id"] for r in f.collect()} for f in (stored.in_view(camera), view.in_view(points, camera)))
    assert got == want
    for px, py, radius in ((800, 500, 40), (300, 900, 200), (-50, 20, 60)):
        a, b = (f.collect() for f in (stored.pick(camera, px, py, 1600, 1000, radius), view.pick(points, camera, px, py, 1600, 1000, radius)))
        assert a == b


def test_only_cells_in_sight_are_read(points, stored):
    near = view.Camera.looking_at_centre(9.0, -3.0, 4.0, 1.6, fov=6.0)
    assert stored.share(near) < 0.6 < stored.share(CAMERAS[4]) and stored.points(near).count() == round(stored.share(near) * 3000)
    assert stored.share(CAMERAS[4], low=(-0.9, -0.9), high=(-0.8, -0.8)) < 0.1
    plan = stored.points(near)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    sizes = [r["n"] for r in stored.bounds.collect()]
    assert sum(sizes) == 3000 and 20 < len(sizes) <= 50 + 16**3 and sorted(stored.points(near).columns) == sorted(points.columns)


def test_curve_keeps_neighbours_together(spark):
    grid = spark.createDataFrame([(x, y, z) for x in range(8) for y in range(8) for z in range(8)], "x int, y int, z int")
    place = cells.curve_place(*[(F.col(c) + 0.5) / 4 - 1 for c in "xyz"], reach=1.0, bits=3)
    got = {(r["x"], r["y"], r["z"]): r["p"] for r in grid.select("x", "y", "z", place.alias("p")).collect()}
    want = {(x, y, z): sum((((v >> b) & 1) << (3 * b + k)) for b in range(3) for k, v in enumerate((x, y, z))) for x, y, z in got}
    assert got == want


def test_odd_points(spark, tmp_path):
    for k, rows in enumerate(([], shell(5, 1)[5:], [(1, 0.0, 0.0, 0.0, 2, "m")] * 9)):
        found = cells.build(spark.createDataFrame(rows, POINTS), str(tmp_path / str(k)), per_cell=3)
        assert found.in_view(CAMERAS[0]).count() == view.in_view(spark.createDataFrame(rows, POINTS), CAMERAS[0]).count()
