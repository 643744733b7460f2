"""Display formats, as Columns; `*_value` variants format one Python number. Rounding is half up."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def fmt_int_value(x: float) -> str:
    return f"{math.floor(x + 0.5):,}"


def fmt_int(x: Column) -> Column:
    return F.format_number(half_up(x), 0)


def fmt_km(x: Column) -> Column:
    return F.concat(fmt_int(x), F.lit(" km"))


def _fixed(x: Column, digits: int) -> Column:
    """Fixed digits without thousands separators."""
    return F.format_string(f"%.{digits}f", x.cast("double"))


def fmt_compact(x: Column) -> Column:
    short = lambda digits: F.concat(F.regexp_replace(_fixed(x / 1000, digits), r"\.0\z", ""), F.lit("k"))
    return F.when(x >= 100_000, short(0)).when(x >= 10_000, short(1)).otherwise(fmt_int(x))


def share(part: Column, whole: Column) -> Column:
    """Whole percent, 0 of nothing."""
    return F.when(whole == 0, 0).otherwise(half_up(part / F.nullif(whole, F.lit(0)) * 100)).cast("int")


def pct(part: Column, whole: Column) -> Column:
    p = part / F.nullif(whole, F.lit(0)) * 100
    return F.when(whole == 0, "0%").when((p > 0) & (p < 1), "<1%").otherwise(F.concat(half_up(p).cast("string"), F.lit("%")))


def round_altitude(km: Column) -> Column:
    """To tens below 1,000 km, hundreds below 10,000 km, else five hundreds."""
    to = lambda k: half_up(km / k) * k
    return F.when(km < 1000, to(10)).when(km < 10_000, to(100)).otherwise(to(500))


def rel_time(from_ms: Column, now_ms: Column) -> Column:
    s = half_up((now_ms - from_ms) / 1000)
    m = half_up(s / 60)
    h = half_up(m / 60)
    return F.when(s < 60, "just now").when(m < 60, F.concat(m.cast("string"), F.lit(" min ago"))).when(h < 48, F.concat(h.cast("string"), F.lit(" h ago"))).otherwise(F.concat(half_up(h / 24).cast("string"), F.lit(" days ago")))


def fmt_lat(x: Column) -> Column:
    return F.concat(_fixed(F.abs(x), 1), F.lit("°"), F.when(x >= 0, "N").otherwise("S"))


def fmt_lon(x: Column) -> Column:
    return F.concat(_fixed(F.abs(x), 1), F.lit("°"), F.when(x >= 0, "E").otherwise("W"))


def fmt_duration(minutes: Column) -> Column:
    h = minutes / 60
    return F.when(minutes < 120, F.concat(half_up(minutes).cast("string"), F.lit(" min"))).when(h < 48, F.concat(F.regexp_replace(_fixed(h, 1), r"\.0\z", ""), F.lit(" h"))).otherwise(F.concat(_fixed(h / 24, 1), F.lit(" days")))


def fmt_age(launch_ms: Column, now_ms: Column) -> Column:
    """Empty for an unknown launch."""
    d = (now_ms - launch_ms) / 86_400_000
    text = lambda n, unit: F.concat(half_up(n).cast("string"), F.lit(f" {unit} in orbit"))
    return F.coalesce(F.when(d < 1, "launched today").when(d < 60, text(d, "days")).when(d < 730, text(d / 30.4, "months")).otherwise(F.when(d.isNotNull(), text(d / 365.25, "years"))), F.lit(""))


def utc_clock(ms: Column) -> Column:
    """In a session whose time zone is UTC."""
    return F.date_format(F.timestamp_millis(ms), "HH:mm:ss 'UTC'")


def utc_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def offset_label(delta_ms: Column) -> Column:
    """A signed distance in time: days from 48 hours on, else hours and minutes, minutes, or seconds."""
    s = half_up(delta_ms / 1000)
    a = F.abs(s)
    h, m = F.floor(a / 3600), F.floor(F.pmod(a, F.lit(3600)) / 60)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("long").cast("string") for p in parts])
    body = F.when(h >= 48, text(half_up(h / 24), " d")).when(h > 0, text(h, " h ", m, " m")).when(m > 0, text(m, " m")).otherwise(text(a, " s"))
    return F.concat(F.when(s >= 0, "+").otherwise("−"), body)


def inclination_kind(degrees: Column) -> Column:
    return F.when(degrees > 90, "retrograde").when(degrees < 1, "equatorial").otherwise("prograde")


def freshness(origin: Column, mode: Column) -> Column:
    """Live, Cached or Snapshot, by where a catalogue came from (api, browser-cache, snapshot) and its mode."""
    return F.when((origin == "api") & (mode == "live"), "Live").when((mode == "warm-cache") | (origin == "browser-cache"), "Cached").otherwise("Snapshot")
