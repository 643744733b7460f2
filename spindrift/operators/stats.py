"""Statistics of a scope (the catalogue or a filtered part of it).

Everything that orders by "first seen" orders by the smallest id: the catalogue is sorted by id, so the first row of a
key is that of its smallest id, and no global row number is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.format import half_up
from ..functions.orbit import ALT_BINS, altitude_bin, bin_altitude
from ..plans import vocab
from ..plans.lens import DAY_MS, PRESETS, Lens

DIMENSIONS = ("mission", "bloc", "regime", "sector", "constellation", "operator", "country", "alt_bin")
MAX_ORBITS = 320


def _alt() -> Column:
    return F.col("mean_alt_km").cast("double")


def dimension_counts(scope: DataFrame) -> DataFrame:
    """dimension, key, n and first_id of every key of every dimension, and one row `total` (key null).

    Rows are counted once by the combination of all keys, with a partial sum in each task; the sets are counted from that.
    """
    keys = scope.select("id", *DIMENSIONS[:-1], altitude_bin(_alt()).cast("string").alias("alt_bin"))
    combined = keys.groupBy(*DIMENSIONS).agg(F.count("*").alias("c"), F.min("id").alias("i"))
    each = F.array(F.struct(F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("key")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("key")) for d in DIMENSIONS])
    out = combined.select("c", "i", F.inline(each)).filter("dimension = 'total' or key is not null")
    return out.groupBy("dimension", "key").agg(F.sum("c").alias("n"), F.min("i").alias("first_id"))


def spine(spark: SparkSession) -> DataFrame:
    """dimension, key and ord of the dense dimensions: the fixed vocabularies and the altitude bins."""
    fixed = {"mission": vocab.MISSIONS, "bloc": vocab.BLOCS, "regime": vocab.REGIMES, "sector": vocab.SECTORS}
    rows = [(d, r[0], i) for d, table in fixed.items() for i, r in enumerate(table)] + [("alt_bin", str(b), b) for b in range(ALT_BINS)]
    return spark.createDataFrame(rows, "dimension string, key string, ord int")


def dense_counts(counts: DataFrame) -> DataFrame:
    """The dense dimensions with zeros: dimension, key, ord, n."""
    fixed = F.broadcast(spine(counts.sparkSession))  # under a hundred rows
    seen = counts.filter(F.col("dimension").isin("mission", "bloc", "regime", "sector", "alt_bin")).select("dimension", "key", "n")
    return fixed.join(seen, ["dimension", "key"], "left").select("dimension", "key", "ord", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(scope: DataFrame) -> DataFrame:
    """alt_bin, n of all bins."""
    bins = scope.sparkSession.range(ALT_BINS).select(F.col("id").cast("int").alias("alt_bin"))
    seen = scope.groupBy(altitude_bin(_alt()).alias("alt_bin")).agg(F.count("*").alias("n"))
    return bins.join(F.broadcast(seen), "alt_bin", "left").select("alt_bin", F.coalesce("n", F.lit(0)).alias("n"))


def recency(scope: DataFrame, now_ms: int) -> DataFrame:
    within = lambda days: F.count_if(F.col("launch_ms") >= now_ms - days * DAY_MS)
    return scope.agg(F.count("*").alias("total"), within(365).alias("last_365"), within(30).alias("last_30"))


def kth_value(scope: DataFrame, value: Column, k: Column) -> DataFrame:
    """One row (value): the value at place k (from 0, a Column of n) in ascending order; no row if the scope is empty.

    Equal values are counted first, so that what is sorted is distinct values; a range of them is found by the sums of
    1024 equal-width bins, and only the bin with the place is sorted.
    """
    values = scope.select(value.alias("v")).groupBy("v").agg(F.count("*").alias("c"))
    span = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))  # one row
    binned = values.crossJoin(F.broadcast(span)).withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(1023), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1024))).otherwise(0))
    sums = binned.groupBy("bin", "n").agg(F.sum("c").alias("in_bin"))  # at most 1024 rows
    before = F.coalesce(F.sum("in_bin").over(Window.partitionBy("n").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = sums.withColumn("before", before).withColumn("k", k).filter("before <= k and k < before + in_bin").select("bin", "before", "k")
    own = binned.select("bin", "v", "c").join(F.broadcast(hit), "bin")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("upto", upto).filter("upto > k").agg(F.min("v").alias("value")).filter("value is not null")


def upper_median(scope: DataFrame) -> DataFrame:
    """One row (median_alt_km): the element n div 2 of the sorted altitudes; 0 for an empty scope."""
    return kth_value(scope, _alt(), F.floor(F.col("n") / 2)).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("median_alt_km"))


def framing_distance(scope: DataFrame) -> DataFrame:
    """One row (distance): camera distance that frames nine tenths of the orbits, in scene units."""
    radius = 1 + F.col("apogee_km").cast("double") / 6371
    at = kth_value(scope, radius, F.least(F.floor(F.col("n") * 0.9), F.col("n") - 1))
    return at.select(F.greatest(F.lit(3.8), F.least(F.lit(30.0), F.col("value") * 2.05)).alias("distance"))


def top_entries(scope: DataFrame, key: str, n: int) -> DataFrame:
    """key, n, first_id of the n most frequent values; ties keep the order in which they are first seen."""
    counts = scope.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return counts.orderBy(F.desc("n"), "first_id").limit(n)


def first_seen_codes(catalog: DataFrame, key: str, bins: int = 1024) -> DataFrame:
    """value and code (from 0) of a column's values, in the order in which they are first seen.

    Places are counted within ranges of ids and added up over the ranges, so no task has all values.
    """
    firsts = catalog.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.min("id").alias("first"))
    ends = firsts.agg(F.min("first").alias("lo"), F.max("first").alias("hi"))  # one row
    binned = firsts.crossJoin(F.broadcast(ends)).select("value", "first", F.floor((F.col("first") - F.col("lo")) * bins / (F.col("hi") - F.col("lo") + 1)).alias("bin"))
    sizes = binned.groupBy("bin").agg(F.count("*").alias("n"))  # at most `bins` rows
    before = sizes.select("bin", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bin").orderBy("first")) - 1
    return binned.withColumn("place", place).join(F.broadcast(before), "bin").select("value", (F.col("before") + F.col("place")).cast("long").alias("code"))


def preset_counts(catalog: DataFrame, now_ms: int) -> DataFrame:
    """preset, n of the twelve presets, from one pass."""
    one = catalog.agg(*[F.count_if(p.lens.to_column(now_ms)).alias(p.id) for p in PRESETS])
    return one.select(F.inline(F.array(*[F.struct(F.lit(p.id).alias("preset"), F.col(f"`{p.id}`").alias("n")) for p in PRESETS])))


def shell_neighbours(catalog: DataFrame, probes: DataFrame | None = None, band: float = 25.0) -> DataFrame:
    """id, neighbours: rows of the catalogue whose altitude is within `band` km of each probe's, itself included.

    Altitudes are counted by distinct value first. A value counts in its cell, as wide as the band, and in the two beside
    it; a running sum over the sorted values of a cell counts what is near a probe's value. Values never meet each other.
    """
    cell = F.floor(F.col("alt") / band).cast("long")
    values = catalog.select(_alt().alias("alt")).groupBy("alt").agg(F.count("*").alias("c")).withColumn("own", cell)
    asked = (catalog if probes is None else probes).select("id", _alt().alias("alt"))
    given = values.select("alt", "c", F.lit(False).alias("asks"), F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("cell"))
    asks = asked.select("alt").distinct().select("alt", F.lit(0).cast("long").alias("c"), F.lit(True).alias("asks"), cell.alias("cell"))
    around = f"sum(c) over (partition by cell order by alt range between {float(band)}D preceding and {float(band)}D following)"
    found = given.unionByName(asks).withColumn("neighbours", F.expr(around)).filter("asks").select("alt", "neighbours")
    return asked.join(found, "alt").select("id", "neighbours")


def shell_percentile(catalog: DataFrame, probes: DataFrame | None = None, band: float = 25.0) -> DataFrame:
    """id, neighbours, percentile (share of occupied bands with fewer) and busiest."""
    bins = catalog.groupBy(F.floor(_alt() / (2 * band)).alias("b")).agg(F.count("*").alias("c"))
    sizes = bins.groupBy("c").agg(F.count("*").alias("bins"))
    listed = sizes.agg(F.collect_list(F.struct("c", "bins")).alias("sizes"), F.sum("bins").alias("all"), F.max("c").alias("most"))  # one row; a band per 50 km
    out = shell_neighbours(catalog, probes, band).crossJoin(F.broadcast(listed))
    below = F.aggregate(F.filter("sizes", lambda s: s["c"] < F.col("neighbours")), F.lit(0).cast("long"), lambda a, s: a + s["bins"])
    return out.select("id", "neighbours", (below / F.col("all")).alias("percentile"), (F.col("neighbours") >= F.col("most")).alias("busiest"))


def modes_of(h: Column, n: int) -> Column:
    """array of struct(inc, count): the peaks of `h`, an array of (-count, degree, count) in order, with the free neighbours of each."""

    def take(state: Column, _: Column) -> Column:
        free = state["free"]
        best = free[0]
        near = F.filter(free, lambda x: F.abs(x["d"] - best["d"]) <= 1)
        found = F.struct(best["d"].alias("inc"), F.aggregate(near, F.lit(0).cast("long"), lambda a, x: a + x["c"]).alias("count"))
        return F.when(F.size(free) == 0, state).otherwise(F.struct(F.filter(free, lambda x: F.abs(x["d"] - best["d"]) > 1).alias("free"), F.array_append(state["out"], found).alias("out")))

    start = F.struct(h.alias("free"), F.from_json(F.lit("[]"), "array<struct<inc:int,count:bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, take, lambda s: s["out"])


def inclination_modes(scope: DataFrame, n: int = 3) -> DataFrame:
    """rank (from 1), inc and count of the dominant inclinations: peaks of whole degrees with the free neighbours of each."""
    degree = F.greatest(F.lit(0), F.least(F.lit(180), half_up(F.col("inclination")))).cast("int")
    hist = scope.groupBy(degree.alias("d")).agg(F.count("*").alias("c"))
    one = hist.agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("by"), "d", "c"))).alias("h"))  # one row of at most 181 bins
    return one.select(F.posexplode(modes_of(F.col("h"), n)).alias("at", "m")).select((F.col("at") + 1).alias("rank"), "m.inc", "m.count")


def densest_band(scope: DataFrame) -> DataFrame:
    """One row (lo, hi, count): the two neighbouring altitude bins with the most rows, the lower on ties; none if empty."""
    bins = histogram(scope)  # 72 rows
    pair = F.col("n") + F.lead("n").over(Window.orderBy("alt_bin"))
    best = bins.withColumn("pair", pair).filter("pair > 0").orderBy(F.desc("pair"), "alt_bin").limit(1)
    return best.select(bin_altitude(F.col("alt_bin")).alias("lo"), bin_altitude(F.col("alt_bin") + 2).alias("hi"), F.col("pair").alias("count"))


def histogram_max(*layers: DataFrame) -> DataFrame:
    """One row (most): the largest bin of several histograms, 1 at least."""
    return reduce(DataFrame.unionByName, layers).agg(F.greatest(F.coalesce(F.max("n"), F.lit(0)), F.lit(1)).alias("most"))


def share_rows(counts: DataFrame, most: int = 4) -> DataFrame:
    """key, n of the largest entries without zeros, largest first, and `rest` (how many are left out) on each row."""
    full = counts.filter("n > 0")
    top = full.orderBy(F.desc("n"), "ord").limit(most)
    return top.crossJoin(F.broadcast(full.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("rest")))).select("key", "n", "rest")


def key_count(catalog: DataFrame, key: str, value: str) -> DataFrame:
    """One row (n): how many rows have a value."""
    return catalog.agg(F.count_if(F.col(key) == value).alias("n"))


def scoped(catalog: DataFrame, lens: Lens, now_ms: int, in_view: DataFrame | None = None) -> DataFrame:
    """Rows that match a lens, of all or of those in view (a table with their ids)."""
    base = catalog if in_view is None else catalog.join(in_view.select("id"), "id", "left_semi")
    return base.filter(lens.to_column(now_ms))


def overlap(catalog: DataFrame, a: Lens, b: Lens, now_ms: int) -> DataFrame:
    """One row (only_a, only_b, both): comparison counts a row on both sides."""
    x, y = a.to_column(now_ms), b.to_column(now_ms)
    return catalog.agg(F.count_if(x & ~y).alias("only_a"), F.count_if(y & ~x).alias("only_b"), F.count_if(x & y).alias("both"))


def orbit_rows(catalog: DataFrame, groups: list[Lens], now_ms: int) -> DataFrame:
    """Rows whose orbits are drawn. Groups of over MAX_ORBITS are left out; of the others, in turn, rows by id are listed
    until there are MAX_ORBITS + 1, and one of each group that comes after that."""
    sizes = catalog.agg(*[F.count_if(g.to_column(now_ms)).alias(f"g{i}") for i, g in enumerate(groups)]).first()  # one row
    out, listed = [], 0
    for i, (group, size) in enumerate(zip(groups, sizes)):
        if 0 < size <= MAX_ORBITS:
            take = min(size, max(1, MAX_ORBITS + 1 - listed))
            rows = catalog.filter(group.to_column(now_ms))
            out.append((rows if take == size else rows.orderBy("id").limit(take)).withColumn("group", F.lit(i)))
            listed += take
    return reduce(DataFrame.unionByName, out) if out else catalog.withColumn("group", F.lit(0)).limit(0)
