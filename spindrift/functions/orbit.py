"""Orbit quantities and altitude scales as Columns. Constants are those of WGS-72, which SGP4 uses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MU, EARTH_RADIUS_KM, SCENE_UNIT_KM = 398600.8, 6378.135, 6371.0
GEO_ALTITUDE_KM, LEO_CEILING_KM = 35786.0, 2000.0
#: Bins of the altitude histogram, even in the logarithm.
ALT_BINS, ALT_MIN, ALT_MAX = 72, 150.0, 45_000.0
_LOG_MIN, _LOG_SPAN = math.log10(ALT_MIN), math.log10(ALT_MAX) - math.log10(ALT_MIN)
#: Altitudes of the rings that are drawn, in km, and their radii in scene units.
RING_ALTITUDES = (2000, 20200, 35786)
RING_RADII = tuple(1 + km / SCENE_UNIT_KM for km in RING_ALTITUDES)


def semi_major_axis(mean_motion: Column) -> Column:
    n = mean_motion * 2 * math.pi / 86400
    return F.cbrt(MU / (n * n))


def classify_regime(mean_motion: Column, eccentricity: Column, altitude: Column) -> Column:
    return (
        F.when(eccentricity > 0.25, "HEO")
        .when(altitude < LEO_CEILING_KM, "LEO")
        .when((mean_motion > 0.95) & (mean_motion < 1.05) & (eccentricity < 0.1), "GEO")
        .when(altitude > GEO_ALTITUDE_KM + 1500, "HEO")
        .otherwise("MEO")
    )


def orbit_columns(mean_motion: Column, eccentricity: Column) -> dict[str, Column]:
    """Derived columns by name; altitudes and period are stored as 32-bit floats."""
    a = semi_major_axis(mean_motion)
    return {
        "perigee_km": (a * (1 - eccentricity) - EARTH_RADIUS_KM).cast("float"),
        "apogee_km": (a * (1 + eccentricity) - EARTH_RADIUS_KM).cast("float"),
        "mean_alt_km": (a - EARTH_RADIUS_KM).cast("float"),
        "period_min": (1440 / mean_motion).cast("float"),
        "regime": classify_regime(mean_motion, eccentricity, a - EARTH_RADIUS_KM),
    }


def orbital_speed(radius_km: Column, semi_major_km: Column) -> Column:
    """Vis-viva, km/s."""
    return F.sqrt(MU * (2 / radius_km - 1 / semi_major_km))


def altitude_unit(km: Column) -> Column:
    """0 to 1 on the logarithmic scale; altitudes beyond its ends count as the ends."""
    return (F.log10(F.greatest(F.lit(ALT_MIN), F.least(F.lit(ALT_MAX), km))) - _LOG_MIN) / _LOG_SPAN


def unit_altitude(u: Column) -> Column:
    return F.pow(F.lit(10.0), _LOG_MIN + F.greatest(F.lit(0.0), F.least(F.lit(1.0), u)) * _LOG_SPAN)


def altitude_bin(km: Column) -> Column:
    """0 to ALT_BINS - 1; altitudes beyond the ends fall in the end bins."""
    t = (F.log10(F.greatest(km, F.lit(ALT_MIN))) - _LOG_MIN) / _LOG_SPAN
    return F.greatest(F.lit(0), F.least(F.lit(ALT_BINS - 1), F.floor(t * ALT_BINS))).cast("int")


def bin_altitude(b: Column) -> Column:
    """Lower edge of a bin, km."""
    return F.pow(F.lit(10.0), _LOG_MIN + b / ALT_BINS * _LOG_SPAN)


def bin_altitude_value(b: float) -> float:
    return 10 ** (_LOG_MIN + b / ALT_BINS * _LOG_SPAN)


def brush_band(u0: float, u1: float) -> tuple[int, int]:
    """Altitude band in km of a drag between two places (0 to 1) of the histogram; a drag within a bin takes the bin."""
    lo, hi = sorted((min(max(u, 0.0), 1.0) for u in (u0, u1)))
    if (hi - lo) * ALT_BINS < 1:
        b = min(ALT_BINS - 1, math.floor(lo * ALT_BINS))
        lo, hi = b / ALT_BINS, (b + 1) / ALT_BINS
    at = lambda u: 10 ** (_LOG_MIN + u * _LOG_SPAN)
    return math.floor(at(lo)), math.ceil(at(hi))


def brush_columns(u0: Column, u1: Column) -> tuple[Column, Column]:
    """`brush_band` of columns."""
    low, high = (f(*[F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) for u in (u0, u1)]) for f in (F.least, F.greatest))
    within = (high - low) * ALT_BINS < 1
    b = F.least(F.lit(ALT_BINS - 1), F.floor(low * ALT_BINS))
    low, high = F.when(within, b / ALT_BINS).otherwise(low), F.when(within, (b + 1) / ALT_BINS).otherwise(high)
    at = lambda u: F.pow(F.lit(10.0), _LOG_MIN + u * _LOG_SPAN)
    return F.floor(at(low)).cast("int"), F.ceil(at(high)).cast("int")


def focus_scale(count: Column) -> Column:
    """Point size by the number of focused rows."""
    return F.when(count == 0, 1.0).when(count < 120, 1.8).when(count < 1500, 1.3).otherwise(1.0)


def ring_samples(rows: Column) -> Column:
    return F.when(rows > 90, 96).otherwise(160)


def ring_opacity(rows: Column) -> Column:
    return F.least(F.lit(0.35), 2.2 / F.sqrt(rows))


def bar_height(count: Column, most: Column, height: Column) -> Column:
    return F.when(count <= 0, 0.0).otherwise(F.greatest(F.lit(1.5), F.log10(1 + count) / F.log10(1 + most) * (height - 4)))
