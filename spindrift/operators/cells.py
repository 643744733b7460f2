"""Positions stored along a space-filling curve, in cells with bounds: a view skips whole cells before it looks at rows.

A point's place on the curve has the bits of its three coordinates in turn, so that points near each other on it are near each
other in space. The curve is cut where about as many points lie between the cuts; each piece is a cell and a folder of its own.
The curve jumps where it leaves a cube, so a cell has a bounding box for each of NODES cubes a side that it has points in: together
a small table, of as many rows as there are cells and cubes. A cell is read if one of its boxes is in sight. A box is out of sight if it lies beyond one edge of the image, or wholly behind
the sphere: what the sphere hides is convex, so a box is hidden if its corners are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import view
from .view import Camera

#: Bits of a coordinate on the curve, and points of a cell.
BITS, PER_CELL = 10, 1_000_000
#: Bits of the cubes' places: 16 cubes a side.
NODES = 4
#: What rounding may add to a distance from an edge, and take from the sphere's radius: a cell is rather read than lost.
SLACK = 1e-6


def curve_place(x: Column, y: Column, z: Column, reach: float, bits: int = BITS) -> Column:
    """Place on the curve of a point whose coordinates are between -reach and reach."""
    steps = (1 << bits) - 1
    whole = lambda c: F.least(F.greatest(F.floor((c / reach + 1) / 2 * (1 << bits)), F.lit(0)), F.lit(steps)).cast("long")
    axes = [whole(c) for c in (x, y, z)]
    bit = lambda axis, b, k: F.shiftleft(F.shiftright(axis, b).bitwiseAND(F.lit(1).cast("long")), 3 * b + k)
    return reduce(lambda a, b: a.bitwiseOR(b), [bit(axis, b, k) for b in range(bits) for k, axis in enumerate(axes)])


def build(points: DataFrame, folder: str, per_cell: int = PER_CELL) -> Cells:
    """Store `points` (with x, y, z in scene units; other columns come along) in a new `folder`.

    Points without a position are in no view and are left out; repeated ones are all kept. A single point that stands more often
    than `per_cell` is one cell.
    """
    spark = points.sparkSession
    placed = points.filter("x is not null and y is not null and z is not null and not isnan(x + y + z)")
    n, reach = placed.agg(F.count("*"), F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z")))).first()
    names, cell, place = points.columns, "cell", "place"
    while {cell, place} & {c.lower() for c in names}:
        cell, place = f"{cell}_", f"{place}_"
    number = max(1, -(-n // per_cell))
    along = placed.withColumn(place, curve_place(F.col("x"), F.col("y"), F.col("z"), float(reach or 1) or 1.0))
    along.repartitionByRange(number, place).withColumn(cell, F.spark_partition_id()).sortWithinPartitions(place).write.partitionBy(cell).parquet(f"{folder}/points")
    stored = spark.read.schema(along.schema.add(cell, IntegerType())).parquet(f"{folder}/points")
    edges = [f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("low", F.min), ("high", F.max))]
    # Few rows: one file.
    stored.groupBy(F.col(cell).alias("cell"), F.shiftright(place, 3 * (BITS - NODES)).alias("node")).agg(F.count("*").alias("n"), *edges).coalesce(1).write.parquet(f"{folder}/bounds")
    return Cells(spark, folder, stored, names, cell)


class Cells:
    def __init__(self, spark: SparkSession, folder: str, stored: DataFrame, names: list[str], cell: str):
        self.spark, self.stored, self.names, self.cell = spark, stored, names, cell
        self.bounds = spark.read.parquet(f"{folder}/bounds")

    def in_sight(self, camera: Camera, low: tuple[float, float] = (-1.0, -1.0), high: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
        """Bounds of the boxes that may have a visible point between the image's coordinates `low` and `high` (-1 to 1 is all)."""
        sizes = lambda row: F.greatest(*[sum((row[i] * F.col(f"{e}_{c}") for i, (e, c) in enumerate(zip(edge, "xyz"))), F.lit(row[3])) for edge in _CORNERS])
        across, up, _, depth = camera.matrix
        # Each edge is a linear function that is not below 0 on its inner side: its greatest value is at a corner.
        planes = [depth, *[tuple(a - f * w for a, w in zip(axis, depth)) for axis, f in ((across, low[0]), (up, low[1]))], *[tuple(f * w - a for a, w in zip(axis, depth)) for axis, f in ((across, high[0]), (up, high[1]))]]
        inside = reduce(lambda a, b: a & b, [sizes(p) >= -SLACK * (1 + sum(map(abs, p))) for p in planes])
        corners = [view.occluded(camera, *[F.col(f"{e}_{c}") for e, c in zip(edge, "xyz")], radius=1 - SLACK) for edge in _CORNERS]
        return self.bounds.filter(inside & ~reduce(lambda a, b: a & b, corners))

    def points(self, camera: Camera, **part) -> DataFrame:
        """The points of the cells in sight: a filter on the folders, from as many numbers as there are cells."""
        seen = sorted(r["cell"] for r in self.in_sight(camera, **part).select("cell").distinct().collect())
        return self.stored.filter(F.col(self.cell).isin(seen)).select(*self.names)

    def share(self, camera: Camera, **part) -> float:
        """Of all points, the part in cells that are read."""
        read = self.bounds.join(self.in_sight(camera, **part).select("cell").distinct(), "cell", "left_semi")
        count = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return count(read) / max(1, count(self.bounds))

    def in_view(self, camera: Camera) -> DataFrame:
        return view.in_view(self.points(camera), camera)

    def pick(self, camera: Camera, px: float, py: float, width: float, height: float, radius: float = view.MOUSE_RADIUS, style: str = "style") -> DataFrame:
        """As `view.pick`, from the cells that the circle around the pixel meets."""
        x, y, rx, ry = px / width * 2 - 1, 1 - py / height * 2, radius / width * 2 + SLACK, radius / height * 2 + SLACK
        near = self.points(camera, low=(x - rx, y - ry), high=(x + rx, y + ry))
        return view.pick(near, camera, px, py, width, height, radius, style)


_CORNERS = [(a, b, c) for a in ("low", "high") for b in ("low", "high") for c in ("low", "high")]
