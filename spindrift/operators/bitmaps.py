"""A bitmap index of a catalogue: which ids have a value, as bits; lenses are counted by them without reading the catalogue.

Ids are cut into buckets of 32,768; a value has one bitmap in each bucket in which it occurs. A lens is, in each bucket, the union of
a field's values and the intersection of its fields. The index is stored by dimension and value, so a count reads only the bitmaps of
the values that it names. Days of launch are values too; recency is a union of the last ones. Altitudes have no bitmaps: they
are not a few values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lens import DAY_MS, Lens

#: Field of a lens and column of the catalogue for each dimension of the index.
DIMENSIONS = {"constellations": "constellation", "countries": "country", "operators": "operator", "blocs": "bloc", "missions": "mission", "regimes": "regime", "sectors": "sector"}
_TERM = "name string, field string, dimension string, key string, since long"


def build(catalog: DataFrame, folder: str) -> BitmapIndex:
    """Write the index of `catalog` to a new `folder`. Rows without an id are left out; an id that stands twice is one bit."""
    entry = lambda d, k: F.struct(F.lit(d).alias("dimension"), k.cast("string").alias("key"))
    each = F.array(entry("all", F.lit("")), *[entry(d, F.col(c)) for d, c in DIMENSIONS.items()], entry("launch", F.col("launch_ms")))
    rows = catalog.filter("id is not null").select(F.col("id").cast("long").alias("id"), F.inline(each)).filter("key is not null")
    bits = rows.groupBy("dimension", "key", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    order = ("dimension", "key", "bucket")
    bits.withColumn("at", F.when(F.col("dimension") == "launch", F.col("key").cast("long"))).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(folder)
    return BitmapIndex(catalog.sparkSession, folder)


class BitmapIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.stored = spark, spark.read.parquet(folder)

    @staticmethod
    def _terms(name: str, lenses: tuple[Lens, ...], now_ms: int) -> list[tuple]:
        """The values that each field unites; every name has the field of all rows, so that an empty lens is all of them."""
        out = [(name, "all", "all", "", None)]
        for i, lens in enumerate(lenses):
            if lens.altitude is not None:
                raise ValueError("altitudes have no bitmaps")
            out += [(name, f"{i}.{d}", d, str(v), None) for d in DIMENSIONS for v in getattr(lens, d) or ()]
            if lens.launched_within_days:
                out.append((name, f"{i}.launch", "launch", None, int(now_ms - lens.launched_within_days * DAY_MS)))
        return out

    def bitmaps(self, scopes: dict[str, tuple[Lens, ...]], now_ms: int) -> DataFrame:
        """name, bucket, bits: the rows that are in all lenses of a scope."""
        terms = [t for name, lenses in scopes.items() for t in self._terms(name, lenses, now_ms)]
        listed = [(name, f"{i}.ids", int(v)) for name, lenses in scopes.items() for i, lens in enumerate(lenses) for v in lens.ids or ()]
        fields = {name: {t[1] for t in terms if t[0] == name} | {x[1] for x in listed if x[0] == name} for name in scopes}
        # Only the dimensions and values that are named are read.
        named = sorted({t[3] for t in terms if t[3] is not None})
        first = min((t[4] for t in terms if t[4] is not None), default=None)
        wanted = F.col("dimension").isin(sorted({t[2] for t in terms})) & (F.col("key").isin(named) if first is None else F.col("key").isin(named) | (F.col("at") >= first))
        asked = F.broadcast(self.spark.createDataFrame(terms, _TERM).withColumnsRenamed({"dimension": "d", "key": "k"}))  # as many rows as values in the lenses
        hit = (F.col("dimension") == F.col("d")) & ((F.col("key") == F.col("k")) | (F.col("at") >= F.col("since")))
        found = self.stored.filter(wanted).join(asked, hit).select("name", "field", "bucket", "bits")
        if listed:
            ids = self.spark.createDataFrame(listed, "name string, field string, id long")
            found = found.unionByName(ids.groupBy("name", "field", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")))
        each = found.groupBy("name", "bucket", "field").agg(F.bitmap_or_agg("bits").alias("bits"))
        needed = F.create_map(*[F.lit(x) for name, f in fields.items() for x in (name, len(f))])[F.col("name")]
        return each.groupBy("name", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("fields")).filter(F.col("fields") == needed).drop("fields")

    def counts(self, scopes: dict[str, tuple[Lens, ...]], now_ms: int) -> DataFrame:
        """name and n: how many rows are in all lenses of each scope."""
        n = self.bitmaps(scopes, now_ms).groupBy("name").agg(F.sum(F.bitmap_count("bits")).alias("n"))
        names = self.spark.createDataFrame([(x,) for x in scopes], "name string")
        return F.broadcast(names).join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))

    def overlap(self, a: Lens, b: Lens, now_ms: int) -> DataFrame:
        """One row (only_a, only_b, both) as of `stats.overlap`."""
        n = self.counts({"a": (a,), "b": (b,), "both": (a, b)}, now_ms)
        of = lambda k: F.max(F.when(F.col("name") == k, F.col("n")))
        return n.agg((of("a") - of("both")).alias("only_a"), (of("b") - of("both")).alias("only_b"), of("both").alias("both"))
