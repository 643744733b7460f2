"""What a camera sees: projection, occlusion by the unit sphere, picking, label anchors, and interpolation of positions."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import compare

FIELD_OF_VIEW, NEAR, FAR = 42.0, 0.005, 2000.0
MOUSE_RADIUS, TOUCH_RADIUS = 12.0, 24.0


@dataclass(frozen=True)
class Camera:
    """A camera that looks at the centre; `matrix` is projection times view, row by row."""

    x: float
    y: float
    z: float
    matrix: tuple[tuple[float, ...], ...]

    @staticmethod
    def looking_at_centre(x: float, y: float, z: float, aspect: float, offset: tuple[float, float] = (0.0, 0.0), fov: float = FIELD_OF_VIEW) -> Camera:
        """offset: shift of the image, as a share of its width and height."""
        r = math.sqrt(x * x + y * y + z * z)
        back = (x / r, y / r, z / r)
        side = (back[2], 0.0, -back[0])  # up (0, 1, 0) x back
        n = math.hypot(side[0], side[2])
        side = (side[0] / n, 0.0, side[2] / n) if n else (1.0, 0.0, 0.0)
        up = (back[1] * side[2] - back[2] * side[1], back[2] * side[0] - back[0] * side[2], back[0] * side[1] - back[1] * side[0])
        view = [(*axis, -sum(a * p for a, p in zip(axis, (x, y, z)))) for axis in (side, up, back)]
        f = 1 / math.tan(math.radians(fov) / 2)
        a, b = (FAR + NEAR) / (NEAR - FAR), 2 * FAR * NEAR / (NEAR - FAR)
        w = tuple(-v for v in view[2])
        rows = (
            tuple(f / aspect * s + 2 * offset[0] * k for s, k in zip(view[0], view[2])),
            tuple(f * u - 2 * offset[1] * k for u, k in zip(view[1], view[2])),
            tuple(a * v + (b if i == 3 else 0.0) for i, v in enumerate(view[2])),
            w,
        )
        return Camera(x, y, z, rows)


def _clip(camera: Camera, row: int, p: tuple[Column, Column, Column]) -> Column:
    m = camera.matrix[row]
    return m[0] * p[0] + m[1] * p[1] + m[2] * p[2] + m[3]


def occluded(camera: Camera, x: Column, y: Column, z: Column, radius: float = 1.0) -> Column:
    """Whether the line from the camera meets the sphere (the unit sphere if not said) first."""
    dx, dy, dz = x - camera.x, y - camera.y, z - camera.z
    a = dx * dx + dy * dy + dz * dz
    b = 2 * (camera.x * dx + camera.y * dy + camera.z * dz)
    disc = b * b - 4 * a * (camera.x**2 + camera.y**2 + camera.z**2 - radius**2)
    t = (-b - F.sqrt(F.greatest(disc, F.lit(0.0)))) / (2 * a)
    return (disc > 0) & (t > 0) & (t < 1)


def _projected(positions: DataFrame, camera: Camera) -> DataFrame:
    """Rows that have a position, with a struct `clip`: cx, cy, cz and cw, and whether they are hidden.

    What is generated is a column: the position, and then the clip coordinates, are computed once, however many
    conditions use them, and the generated code stays small.
    """
    others = [F.col(f"`{c}`") for c in positions.columns if c not in ("x", "y", "z")]
    points = positions.filter("x is not null").select(*others, F.inline(F.array(F.struct("x", "y", "z"))))
    p = (F.col("x"), F.col("y"), F.col("z"))
    clip = [_clip(camera, i, p).alias(n) for i, n in enumerate(("cx", "cy", "cz", "cw"))]
    return points.select("*", F.explode(F.array(F.struct(*clip, occluded(camera, *p).alias("hidden")))).alias("clip"))


def in_view(positions: DataFrame, camera: Camera) -> DataFrame:
    """Rows (with x, y, z) inside the image's edges and not behind the sphere; rows without a position are not in view."""
    w = F.col("clip.cw")
    return _projected(positions, camera).filter((w > 0) & (F.abs(F.col("clip.cx") / w) <= 1) & (F.abs(F.col("clip.cy") / w) <= 1) & ~F.col("clip.hidden")).select(*positions.columns)


def pick(positions: DataFrame, camera: Camera, px: float, py: float, width: float, height: float, radius: float = MOUSE_RADIUS, style: str = "style") -> DataFrame:
    """At most one row (id, score, sx, sy): the nearest visible row to a pixel; focused rows are favoured, ghosts are not."""
    w = F.col("clip.cw")
    sx, sy = (F.col("clip.cx") / w + 1) * 0.5 * width, (1 - F.col("clip.cy") / w) * 0.5 * height
    d2 = (sx - px) * (sx - px) + (sy - py) * (sy - py)
    weight = F.when(F.col(style) == compare.GHOST, 120.0).when(F.col(style) >= compare.FOCUS, -40.0).otherwise(0.0)
    near = _projected(positions.filter(F.col(style) != compare.HIDDEN), camera).filter((w > 0) & (d2 <= radius * radius) & ~F.col("clip.hidden"))
    return near.select("id", (d2 + weight).alias("score"), sx.alias("sx"), sy.alias("sy")).orderBy("score", "id").limit(1)


def anchors(points: DataFrame, camera: Camera, width: float, height: float, occlude: bool = True) -> DataFrame:
    """id, sx, sy and visible of label points; of a point without a position they are null."""
    nx, ny, nz = (F.col(f"clip.{c}") / F.col("clip.cw") for c in ("cx", "cy", "cz"))
    seen = (nz > -1) & (nz < 1) & (F.abs(nx) < 1.05) & (F.abs(ny) < 1.05)
    none = points.filter("x is null").select("id", *[F.lit(None).cast(t).alias(n) for n, t in (("sx", "double"), ("sy", "double"), ("visible", "boolean"))])
    shown = (seen & ~F.col("clip.hidden") if occlude else seen).alias("visible")
    return _projected(points, camera).select("id", ((nx * 0.5 + 0.5) * width).alias("sx"), ((0.5 - ny * 0.5) * height).alias("sy"), shown).unionByName(none)


def interpolate(a: DataFrame, b: DataFrame, t_a: float, t_b: float, t: float) -> DataFrame:
    """id, x, y, z at t between two snapshots; what has no position at `a` has none."""
    mix = min(1.0, max(0.0, (t - t_a) / (t_b - t_a))) if t_b > t_a else 0.0
    later = b.select("id", *[F.col(c).alias(f"{c}2") for c in "xyz"])
    return a.select("id", "x", "y", "z").join(later, "id", "left").select("id", *[(F.col(c) + (F.coalesce(f"{c}2", c) - F.col(c)) * mix).alias(c) for c in "xyz"])


def camera_distance(r: float) -> float:
    """Distance from which a satellite at radius r is shown."""
    return r + max(1.6, 0.75 * r)


@dataclass(frozen=True)
class SimClock:
    """now = base + (wall - origin) * warp; `epoch` counts changes of time, warp and pause. All times in milliseconds."""

    base: float
    origin: float
    warp: float = 1.0
    paused: bool = False
    epoch: int = 0

    def now(self, wall: float) -> float:
        return self.base if self.paused else self.base + (wall - self.origin) * self.warp

    def set_time(self, ms: float, wall: float) -> SimClock:
        return replace(self, base=ms, origin=wall, epoch=self.epoch + 1)

    def set_warp(self, warp: float, wall: float) -> SimClock:
        return replace(self, base=self.now(wall), origin=wall, warp=warp, epoch=self.epoch + 1)

    def pause(self, wall: float) -> SimClock:
        return replace(self, base=self.now(wall), origin=wall, paused=True, epoch=self.epoch + 1)

    def resume(self, wall: float) -> SimClock:
        return replace(self, origin=wall, paused=False, epoch=self.epoch + 1)

    def go_live(self, wall: float) -> SimClock:
        return SimClock(wall, wall, epoch=self.epoch + 1)

    def is_live(self, wall: float) -> bool:
        return abs(self.now(wall) - wall) < 5000 and self.warp == 1 and not self.paused


def window_span(warp: float) -> float:
    """Milliseconds between two snapshots that are interpolated."""
    return min(max(warp, 1.0) * 1000, 60_000.0)


@dataclass(frozen=True)
class Window:
    """Two snapshots that positions are interpolated between, and the next one. Times are in simulated milliseconds."""

    t_a: float
    t_b: float
    clock_epoch: int
    prefetched: float | None = None

    @staticmethod
    def opened(now: float, clock: SimClock) -> Window:
        return Window(now, now + window_span(clock.warp), clock.epoch)

    def advanced(self, now: float, clock: SimClock) -> Window:
        """The window to use at `now`: a new one after a jump or far behind, the next one when this has passed, else this."""
        span = window_span(clock.warp)
        if clock.epoch != self.clock_epoch:
            return Window.opened(now, clock)
        ahead = self if self.prefetched is not None or clock.paused else replace(self, prefetched=self.t_b + span)
        if now < self.t_b or ahead.prefetched is None:
            return ahead
        moved = Window(self.t_b, ahead.prefetched, self.clock_epoch)
        return Window.opened(now, clock) if now > moved.t_b + span else moved
