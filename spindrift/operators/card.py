"""The card of one satellite: its metadata, live state, group sizes and the crowding of its altitude, as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import format as fmt
from . import motion, stats

BUSY_FROM = 0.6


def shell_note(busiest: Column, percentile: Column) -> Column:
    return F.when(busiest, "most crowded").when(percentile >= BUSY_FROM, F.concat(F.lit("busier than "), fmt.pct(percentile, F.lit(1)))).otherwise("quiet")


def satellite_card(catalog: DataFrame, id: int, ms: float, now_ms: int) -> DataFrame:
    """At most one row. The satellite is found by a filter; what is counted over the catalogue is counted for it alone."""
    own = catalog.filter(F.col("id") == id).withColumn("period_min", 1440 / F.col("mean_motion"))
    group = own.select("constellation").join(catalog.filter("constellation is not null").groupBy("constellation").agg(F.count("*").alias("constellation_size")), "constellation")
    shell = stats.shell_percentile(catalog, own)
    state = motion.state_at(own, ms).select("id", "lat", "lon", F.col("alt").alias("alt_km"), "speed")
    per_day = F.col("mean_motion")
    return (
        own.join(shell, "id").join(state, "id").join(F.broadcast(group), "constellation", "left")  # one row on each side
        .select(
            "id", "name", "operator", F.concat(classify.country_flag(F.col("country")), F.lit(" "), classify.country_name(F.col("country"))).alias("country"), "constellation", "constellation_size", "mission", "sector", "regime",
            fmt.fmt_duration(F.col("period_min")).alias("period"), F.concat(F.when(per_day < 2, F.format_string("%.2f", per_day)).otherwise(F.format_string("%.1f", per_day)), F.lit(" orbits/day")).alias("rate"),
            fmt.inclination_kind(F.col("inclination")).alias("kind"), fmt.fmt_age(F.col("launch_ms"), F.lit(now_ms)).alias("age"),
            fmt.fmt_lat(F.col("lat")).alias("lat"), fmt.fmt_lon(F.col("lon")).alias("lon"), fmt.fmt_km(F.col("alt_km")).alias("altitude"), "speed",
            "neighbours", shell_note(F.col("busiest"), F.col("percentile")).alias("shell"),
        )
    )
