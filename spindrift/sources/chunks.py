"""The payload in parts: for a catalogue that one document shouldn't hold.

A folder has `chunks` (a JSON line for up to so many rows, under the payload's column names, rows by id), `dict` (dict, code,
value: codes in the order in which values are first seen) and `head`, one line that is written last. Without a head, or with
one that doesn't agree with the chunks, a folder is no payload. No task holds more than a chunk or a range of a dictionary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from . import files

ROWS = 10_000
_DICTS = {"operator": ("operators", "op"), "country": ("countries", "cc"), "constellation": ("constellations", "cs")}
_HEAD = f"{files.HEAD_SCHEMA}, count long"
_CHUNK = f"cols struct<{','.join(f'{c}:array<{t}>' for c, t in files.PAYLOAD.items())}>"
_ROW_BITS = (1 << 33) - 1


def dictionaries(catalog: DataFrame, ranges: int = 1024) -> DataFrame:
    """dict, code, value of the three coded columns, from one pass; codes go by the smallest id, then by value.

    Places are counted within ranges of first ids and added up over the ranges.
    """
    cells = catalog.select("id", F.inline(F.array(*[F.struct(F.lit(d).alias("dict"), F.col(c).alias("value")) for c, (d, _) in _DICTS.items()])))
    firsts = cells.filter("value is not null").groupBy("dict", "value").agg(F.min("id").alias("first"))
    ends = firsts.groupBy("dict").agg(F.min("first").alias("low"), F.max("first").alias("high"))  # three rows
    ranged = firsts.join(F.broadcast(ends), "dict").withColumn("range", F.floor((F.col("first") - F.col("low")).cast("double") * ranges / (F.col("high") - F.col("low") + 1)))
    sizes = ranged.groupBy("dict", "range").agg(F.count("*").alias("n"))  # at most `ranges` rows for each
    before = F.coalesce(F.sum("n").over(Window.partitionBy("dict").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("dict", "range").orderBy("first", "value")) - 1
    counted = ranged.withColumn("place", place).join(F.broadcast(sizes.select("dict", "range", before.alias("before"))), ["dict", "range"])
    return counted.select("dict", (F.col("before") + F.col("place")).cast("int").alias("code"), "value")


def write_chunks(catalog: DataFrame, folder: str, source: dict[str, str], generated_at: str, rows: int = ROWS) -> int:
    """Write a catalogue to a new folder; its number of rows. The catalogue is read twice, so it should be a stored table.

    rows: most rows of a chunk. Rows that repeat an id stay, as many as there are. An empty catalogue has a head alone.
    """
    spark, folder = catalog.sparkSession, folder.rstrip("/")
    dictionaries(catalog).write.json(f"{folder}/dict")
    chunks = grouped(coded(catalog, lambda d: _dictionary(spark, folder, d)), rows)
    chunks.select(F.struct(*[F.col(f"r.{c}").alias(c) for c in files.PAYLOAD]).alias("cols")).write.option("ignoreNullFields", False).json(f"{folder}/chunks")
    count = _held(spark, folder)["n"]  # of what was written, whatever tasks ran twice
    spark.range(1).select(*files.head(source, generated_at), F.lit(count).cast("long").alias("count")).coalesce(1).write.json(f"{folder}/head")
    return count


def coded(catalog: DataFrame, words: Callable[[str], DataFrame]) -> DataFrame:
    """The catalogue with the codes of its values and __tie; words(dictionary): its code and value."""
    found = catalog
    for c, (d, _) in _DICTS.items():
        found = found.join(words(d).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code")), c, "left")
    return found.withColumn("__tie", F.xxhash64(*catalog.columns))


def grouped(coded: DataFrame, rows: int) -> DataFrame:
    """range, part, r: the rows by id, in the payload's columns, up to so many in an array; arrays go by range and part."""
    order = ("id", "__tie")
    sorted_rows = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    at = sorted_rows.select(F.monotonically_increasing_id().alias("at"), *[v.alias(c) for c, v in files.encoded().items()])
    part = [F.shiftright("at", 33).alias("range"), F.floor(F.col("at").bitwiseAND(F.lit(_ROW_BITS)) / rows).alias("part")]
    return at.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("at", *files.PAYLOAD))).alias("r"))  # a group has at most `rows`


def _dictionary(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema("dict string, code int, value string").json(f"{folder}/dict").filter(F.col("dict") == name)


def _held(spark: SparkSession, folder: str) -> Row:
    """n, uneven: rows of the chunks, and chunks whose columns differ in length."""
    sizes = [F.size(f"cols.{c}") for c in files.PAYLOAD]
    return spark.read.schema(_CHUNK).json(f"{folder}/chunks").agg(F.coalesce(F.sum(sizes[0]), F.lit(0)).alias("n"), F.count_if(F.least(*sizes) != F.greatest(*sizes)).alias("uneven")).first()


def read_head(spark: SparkSession, folder: str) -> dict:
    """version, generatedAt, source and count of a folder; an error where there is none or it doesn't agree with the chunks."""
    try:
        found = spark.read.schema(_HEAD).json(f"{folder}/head").limit(1).collect()
    except AnalysisException as e:
        raise files.SourceError("invalid", f"{folder} has no head") from e
    if not found or found[0]["version"] != 1:
        raise files.SourceError("invalid", f"{folder} is no payload of version 1")
    held = _held(spark, folder)
    if held["n"] != found[0]["count"] or held["uneven"]:
        raise files.SourceError("invalid", f"{folder} has {held['n']} rows, {held['uneven']} uneven chunks; its head says {found[0]['count']}")
    return found[0].asDict(recursive=True)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a folder, in the columns of `files.payload_rows`; dictionaries are joined, so they may have any size."""
    folder = folder.rstrip("/")
    read_head(spark, folder)
    rows = spark.read.schema(_CHUNK).json(f"{folder}/chunks").select(F.inline(F.arrays_zip(*[F.col(f"cols.{c}").alias(c) for c in files.PAYLOAD])))
    for _, (d, code) in _DICTS.items():
        rows = rows.join(_dictionary(spark, folder, d).select(F.col("code").alias(code), F.col("value").alias(d)), code, "left")
    return files.decoded(rows, lambda name, code: F.col(name))
