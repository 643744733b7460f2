"""Facts of many scopes of a catalogue at once, in three scans however many scopes there are.

The first scan sends each row to the scopes that it is in and counts all keys of all dimensions in one grouping; what it leaves is a
row per scope and key. The second makes a sketch of the altitudes of each scope, which brackets the place of the median; the third
counts what lies below the bracket and the values in it, so that the median is exact and only a few values are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.format import half_up
from ..functions.orbit import ALT_BINS, altitude_bin, bin_altitude
from ..plans.lens import DAY_MS
from . import stats

#: Accuracy of the sketches: a rank is at most one in so many rows off.
ACCURACY = 10_000


def _alt() -> Column:
    return F.col("mean_alt_km").cast("double")


def _spread(catalog: DataFrame, scopes: dict[str, Column], *columns: Column) -> DataFrame:
    """A row per row and scope that it is in."""
    inside = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in scopes.items()]), lambda s: s.isNotNull())
    return catalog.select(F.explode(inside).alias("scope"), *columns)


def key_counts(catalog: DataFrame, scopes: dict[str, Column], now_ms: int, counted: tuple[str, ...] = (), seen: Column | None = None) -> DataFrame:
    """scope, dimension, key, n, first (smallest id), new_365, new_30, in_view of all keys; dimension `all` has one key, null.

    counted: scopes of which only the number of rows is wanted.
    """
    degree = F.greatest(F.lit(0), F.least(F.lit(180), half_up(F.col("inclination")))).cast("int")
    keys = {"regime": F.col("regime"), "bloc": F.col("bloc"), "constellation": F.col("constellation"), "operator": F.col("operator"), "country": F.col("country"), "inc": degree.cast("string"), "bin": altitude_bin(_alt()).cast("string")}
    pair = lambda d, k: F.struct(F.lit(d).alias("dimension"), k.cast("string").alias("key"))
    whole = F.array(pair("all", F.lit(None)))
    each = F.array(pair("all", F.lit(None)), *[pair(d, k) for d, k in keys.items()])
    within = lambda days: F.coalesce(F.col("launch_ms") >= now_ms - days * DAY_MS, F.lit(False)).alias(f"new_{days}")
    dims = each if not counted else F.when(F.col("scope").isin(*counted), whole).otherwise(each)
    rows = _spread(catalog, scopes, "id", "regime", "bloc", "constellation", "operator", "country", "inclination", "mean_alt_km", within(365), within(30), (F.lit(False) if seen is None else seen).alias("seen"))
    out = rows.select("scope", "id", "new_365", "new_30", "seen", F.inline(dims)).filter("dimension = 'all' or key is not null")
    return out.groupBy("scope", "dimension", "key").agg(F.count("*").alias("n"), F.min("id").alias("first"), *[F.count_if(c).alias(name) for c, name in (("new_365", "new_365"), ("new_30", "new_30"), ("seen", "in_view"))])


def medians(catalog: DataFrame, scopes: dict[str, Column], accuracy: int = ACCURACY) -> DataFrame:
    """scope and median_alt_km: the element n div 2 of the sorted altitudes of each scope that has some; exact."""
    rows = _spread(catalog, scopes, _alt().alias("alt")).filter("alt is not null")
    sketch = rows.groupBy("scope").agg(F.count("*").alias("n"), F.min("alt").alias("low"), F.max("alt").alias("high"), F.percentile_approx("alt", [0.5 - 3 / accuracy, 0.5 + 3 / accuracy], accuracy).alias("near"))
    # Of a few rows all are in the bracket; of more, the sketch's error is a third of the bracket's half.
    few = F.col("n") <= 2 * accuracy
    edges = sketch.select(F.col("scope").alias("of"), "n", F.when(few, F.col("low")).otherwise(F.col("near")[0]).alias("low"), F.when(few, F.col("high")).otherwise(F.col("near")[1]).alias("high"))
    # A row per scope is broadcast. Below the bracket all rows are one value, null.
    held = rows.join(F.broadcast(edges), F.col("scope") == F.col("of")).filter("alt <= high").groupBy("scope", "n", F.when(F.col("alt") >= F.col("low"), F.col("alt")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("scope").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("upto", upto).filter("upto > n div 2").groupBy("scope").agg(F.min("v").alias("median_alt_km"))


def _band(bins: Column) -> Column:
    """The two neighbouring bins with the most rows, the lower on ties: struct(lo, hi, count), null without rows."""
    count = lambda b: F.coalesce(F.try_element_at(bins, b), F.lit(0).cast("long"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(ALT_BINS - 2)), lambda b: F.struct(count(b) + count(b + 1), (-b).alias("at")))
    best = F.array_max(pairs)
    low = -best["at"]
    return F.when(best["col1"] > 0, F.struct(bin_altitude(low).alias("lo"), bin_altitude(low + 2).alias("hi"), best["col1"].alias("count")))


def facts(catalog: DataFrame, scopes: dict[str, Column], now_ms: int, counted: tuple[str, ...] = (), in_view: DataFrame | None = None, modes: int = 3) -> DataFrame:
    """A row per scope: scope, total, last_365, last_30, in_view (null if not asked), leo, geo, kr, regimes, top_constellation,
    top_operator and top_country (struct of key and n), modes, band, median_alt_km. A scope without rows has zeros and nulls.

    in_view: rows with the ids in view; joined once for all scopes.
    """
    spark = catalog.sparkSession
    seen = None
    if in_view is not None:
        catalog = catalog.join(in_view.select("id").distinct().withColumn("in_sight", F.lit(True)), "id", "left")
        seen = F.coalesce("in_sight", F.lit(False))
    of = lambda d, c: F.when(F.col("dimension") == d, c)
    key_n, best = F.struct("key", "n"), F.struct("n", -F.col("first"))
    size = lambda d, k: F.coalesce(F.max(F.when((F.col("dimension") == d) & (F.col("key") == k), F.col("n"))), F.lit(0))
    counts = key_counts(catalog, scopes, now_ms, counted, seen)
    # A few hundred keys of a scope come together; of operators, the many, only the first.
    one = counts.groupBy("scope").agg(
        *[F.coalesce(F.max(of("all", F.col(c))), F.lit(0)).alias(name) for c, name in (("n", "total"), ("new_365", "last_365"), ("new_30", "last_30"), ("in_view", "seen"))],
        size("regime", "LEO").alias("leo"), size("regime", "GEO").alias("geo"), size("bloc", "KR").alias("kr"),
        F.array_join(F.array_sort(F.collect_set(of("regime", F.col("key")))), ",").alias("regimes"),
        *[F.max_by(of(d, key_n), of(d, best)).alias(f"top_{d}") for d in ("constellation", "operator", "country")],
        F.array_sort(F.collect_list(of("inc", F.struct((-F.col("n")).alias("by"), F.col("key").cast("int").alias("d"), F.col("n").alias("c"))))).alias("h"),
        F.map_from_entries(F.collect_list(of("bin", F.struct(F.col("key").cast("int"), "n")))).alias("bins"),
    )
    wanted = {k: c for k, c in scopes.items() if k not in counted}
    named = spark.createDataFrame([(k,) for k in scopes], "scope string")
    joined = F.broadcast(named).join(one, "scope", "left").join(F.broadcast(medians(catalog, wanted)), "scope", "left")
    zero = ["total", "last_365", "last_30", "leo", "geo", "kr"]
    return joined.select(
        "scope", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zero], (F.lit(None).cast("long") if in_view is None else F.coalesce("seen", F.lit(0).cast("long"))).alias("in_view"),
        F.coalesce("regimes", F.lit("")).alias("regimes"), "top_constellation", "top_operator", "top_country",
        stats.modes_of(F.coalesce("h", F.expr("cast(array() as array<struct<by:bigint,d:int,c:bigint>>)")), modes).alias("modes"), _band(F.coalesce("bins", F.expr("cast(map() as map<int,bigint>)"))).alias("band"), F.coalesce("median_alt_km", F.lit(0.0)).alias("median_alt_km"),
    )

