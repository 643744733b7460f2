"""Sources: element sets and registry rows from CSV and TSV files, and the columnar JSON payload, as DataFrames.

Every reader has an explicit schema of strings and converts by itself; nothing is inferred. Where a key repeats, the row
that stands last in its file wins; of a folder's files the last by path. Files are read in splits, so a row carries its place.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classify import epoch_ms
from ..plans import vocab

USER_AGENT = "spindrift/1"
MINIMUM_ROWS = 1000
#: Column of a row's place in its source, where a reader adds it.
PLACE = "__place"
GP_COLUMNS = ["OBJECT_NAME", "OBJECT_ID", "EPOCH", "MEAN_MOTION", "ECCENTRICITY", "INCLINATION", "RA_OF_ASC_NODE", "ARG_OF_PERICENTER", "MEAN_ANOMALY", "EPHEMERIS_TYPE", "CLASSIFICATION_TYPE", "NORAD_CAT_ID", "ELEMENT_SET_NO", "REV_AT_EPOCH", "BSTAR", "MEAN_MOTION_DOT", "MEAN_MOTION_DDOT"]


class SourceError(Exception):
    """kind: rate-limited, http, network or invalid."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def fetch_text(url: str, timeout: float = 25.0) -> str:
    """GET on the driver, for an ingest step that lands files; readers take files only."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": USER_AGENT, "Cache-Control": "no-store"}), timeout=timeout) as response:
            return response.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        raise SourceError("rate-limited" if e.code in (403, 429) else "http", f"{url}: {e.code}") from e
    except OSError as e:
        raise SourceError("network", f"{url}: {e}") from e


def check_header(spark: SparkSession, path: str, first: str) -> list[str]:
    """The header's columns; an error if the file doesn't begin with the column `first`."""
    head = spark.read.text(path).limit(1).collect()  # one row
    text = head[0][0] if head else ""
    if not text.lstrip("﻿").startswith(first):
        start = text[:120].lower()
        throttled = any(x in start for x in ("not updated", "too many", "exceeded", "blocked"))
        raise SourceError("rate-limited" if throttled else "invalid", text[:120])
    return [c.strip() for c in text.lstrip("﻿").split(",")]


def place() -> Column:
    """Where a row stands: its file, the first byte of its split, and a number that grows within the split.

    A split is read by one task from its start to its end, so places are in the order of the lines in however many splits a file
    is read, and however splits are dealt to tasks. To be taken in the first select over a file source.
    """
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell may hold a line break: a line keeps a quote when doubled quotes and whole quoted cells are gone."""
    kept = F.regexp_replace(F.replace("value", F.lit('""'), F.lit("")), r'(^|,)"[^"]*+"(?=,|$)', "$1")
    return not spark.read.text(path).filter(F.contains("value", F.lit('"')) & F.contains(kept, F.lit('"'))).isEmpty()


def read_csv(spark: SparkSession, path: str, first: str, line_breaks: bool | None = None) -> DataFrame:
    """Strings, trimmed, empty where a cell is missing, and PLACE; extra cells are dropped.

    line_breaks: whether cells may hold line breaks. Then a file is one split; else it is read in many. None looks at the lines.
    """
    columns = check_header(spark, path, first)
    whole = spans_lines(spark, path) if line_breaks is None else line_breaks
    raw = spark.read.csv(path, schema=", ".join(f"`{c}` string" for c in columns), header=True, quote='"', escape='"', multiLine=whole, enforceSchema=True)
    return raw.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in columns], place().alias(PLACE))


def placed(rows: DataFrame) -> list[str]:
    """PLACE, if the table has it."""
    return [PLACE] if PLACE in rows.columns else []


def last_by(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: the last by PLACE; of a table without places, the last by partition and order within it."""
    numbered = rows.withColumn("__at", F.col(PLACE) if placed(rows) else F.monotonically_increasing_id())
    names = [c for c in rows.columns if c not in (key, PLACE)]
    return numbered.groupBy(key).agg(F.max_by(F.struct(*names), "__at").alias("r")).select(key, "r.*")


def _number(c: str) -> Column:
    return F.col(c).try_cast("double")


def read_elements(spark: SparkSession, path: str, minimum: int = 0) -> DataFrame:
    """Element sets that have an id, an epoch and a positive mean motion. Fewer than `minimum` rows are an error."""
    raw = read_csv(spark, path, "OBJECT_NAME")
    missing = set(GP_COLUMNS) - {"EPHEMERIS_TYPE", "CLASSIFICATION_TYPE"} - set(raw.columns)
    raw = raw.withColumns({c: F.lit("") for c in missing})
    zero = lambda c: F.coalesce(_number(c), F.lit(0.0))
    rows = raw.select(
        F.col("NORAD_CAT_ID").try_cast("int").alias("id"), F.col("OBJECT_NAME").alias("name"), F.col("OBJECT_ID").alias("cospar"), epoch_ms(F.col("EPOCH")).alias("epoch_ms"),
        _number("MEAN_MOTION").alias("mean_motion"), zero("ECCENTRICITY").alias("eccentricity"), zero("INCLINATION").alias("inclination"), zero("RA_OF_ASC_NODE").alias("raan"),
        zero("ARG_OF_PERICENTER").alias("arg_pericenter"), zero("MEAN_ANOMALY").alias("mean_anomaly"), zero("BSTAR").alias("bstar"), zero("MEAN_MOTION_DOT").alias("mean_motion_dot"), zero("MEAN_MOTION_DDOT").alias("mean_motion_ddot"),
        F.coalesce(F.nullif(F.col("ELEMENT_SET_NO").try_cast("int"), F.lit(0)), F.lit(999)).alias("element_set_no"), F.coalesce(F.col("REV_AT_EPOCH").try_cast("int"), F.lit(0)).alias("rev_at_epoch"),
    ).filter("id is not null and epoch_ms is not null and mean_motion > 0")
    if minimum and rows.limit(minimum).count() < minimum:
        raise SourceError("invalid", f"fewer than {minimum} element sets")
    return rows


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """id, owner, registered (launch date) and object_type by catalogue number."""
    raw = read_csv(spark, path, "OBJECT_NAME")
    column = lambda c: F.col(c) if c in raw.columns else F.lit("")
    rows = raw.select(F.col("NORAD_CAT_ID").try_cast("int").alias("id"), column("OWNER").alias("owner"), column("LAUNCH_DATE").alias("registered"), column("OBJECT_TYPE").alias("object_type"), PLACE)
    return last_by(rows.filter("id is not null"), "id")


def optional_registry(spark: SparkSession, path: str | None) -> DataFrame:
    """The registry, or an empty table of its columns where it can't be read."""
    try:
        if path:
            return read_registry(spark, path)
    except Exception:  # the registry only adds to the elements: any failure counts as its absence
        pass
    return spark.createDataFrame([], "id int, owner string, registered string, object_type string")


def read_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Rows under the column names of the first `#` line, trimmed, with PLACE, and the last comment that begins with `Updated`."""
    lines = spark.read.text(path).select("value", place().alias(PLACE))
    comments = [r[0] for r in lines.filter("value like '#%'").orderBy(PLACE).select("value").collect()]  # a file has a few
    if not comments:
        raise SourceError("invalid", f"{path} has no header")
    header = [c.strip() for c in comments[0].lstrip("#").split("\t")]
    updated = [c.lstrip("# ").removeprefix("Updated").strip() for c in comments if c.lstrip("# ").startswith("Updated")]
    cells = F.split("value", "\t", -1)
    rows = lines.filter("value not like '#%' and trim(value) <> ''").select(*[F.coalesce(F.trim(F.get(cells, F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(header)], PLACE)
    return rows, updated[-1] if updated else ""


PAYLOAD = {
    "id": "int", "name": "string", "cospar": "string", "epoch": "double", "mm": "double", "ecc": "double", "inc": "double", "raan": "double", "argp": "double", "ma": "double", "bstar": "double",
    "ndot": "double", "nddot": "double", "esn": "int", "rev": "int", "op": "int", "cc": "int", "cs": "int", "mi": "int", "se": "int", "ld": "string", "ms": "double",
}
_SOURCE = "mode string, elementsFetchedAt string, newestEpoch string, elementsProvider string, metadataProvider string, metadataUpdatedAt string, note string"
SOURCE = [x.split(" ")[0] for x in _SOURCE.split(", ")]
HEAD_SCHEMA = f"version int, generatedAt string, source struct<{', '.join(x.replace(' ', ':', 1) for x in _SOURCE.split(', '))}>"
PAYLOAD_SCHEMA = f"{HEAD_SCHEMA}, count int, dict struct<operators:array<string>,countries:array<string>,constellations:array<string>>, cols struct<{','.join(f'{c}:array<{t}>' for c, t in PAYLOAD.items())}>"


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a payload file; an error if its version, count and columns don't agree."""
    rows = spark.read.schema(PAYLOAD_SCHEMA).json(path, multiLine=True)
    if not rows.filter("version = 1 and count > 0 and size(cols.id) = count").head(1):
        raise SourceError("invalid", f"{path} is no payload of version 1")
    return rows


def decoded(rows: DataFrame, of: Callable[[str, str], Column]) -> DataFrame:
    """Rows under the payload's column names as elements and metadata; of(dictionary, code) is the value of a code, null for -1."""
    word = lambda table, code, default: F.coalesce(F.get(F.array(*[F.lit(r[0]) for r in table]), F.when(F.col(code) >= 0, F.col(code))), F.lit(default))
    return rows.select(
        "id", "name", "cospar", F.floor(F.col("epoch") * 1000 + 0.5).cast("long").alias("epoch_ms"), F.col("mm").alias("mean_motion"), F.col("ecc").alias("eccentricity"), F.col("inc").alias("inclination"), "raan",
        F.col("argp").alias("arg_pericenter"), F.col("ma").alias("mean_anomaly"), "bstar", F.col("ndot").alias("mean_motion_dot"), F.col("nddot").alias("mean_motion_ddot"), F.col("esn").alias("element_set_no"), F.col("rev").alias("rev_at_epoch"),
        of("operators", "op").alias("operator"), of("countries", "cc").alias("country"), of("constellations", "cs").alias("constellation"),
        word(vocab.MISSIONS, "mi", "tech").alias("mission"), word(vocab.SECTORS, "se", "unknown").alias("sector"), F.col("ld").alias("launch_date"), F.nullif(F.col("ms").cast("float"), F.lit(0.0).cast("float")).alias("mass_kg"),
    )


def payload_rows(payload: DataFrame) -> DataFrame:
    """Rows of a payload, elements and metadata, with codes turned into values and sentinels into nulls."""
    zipped = payload.select("dict", F.inline(F.arrays_zip(*[F.col(f"cols.{c}").alias(c) for c in PAYLOAD])))
    return decoded(zipped, lambda name, code: F.when(F.col(code) >= 0, F.get(F.col(f"dict.{name}"), F.col(code))))


def encoded() -> dict[str, Column]:
    """The payload's columns of a catalogue that has operator_code, country_code and constellation_code."""
    at = lambda table, c, default: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r[0]) for r in table]), F.col(c)), F.lit(0)) - 1, F.lit(default)).cast("int")
    return {
        "id": F.col("id").cast("int"), "name": F.col("name"), "cospar": F.col("cospar"), "epoch": F.col("epoch_ms") / 1000.0, "mm": F.col("mean_motion"), "ecc": F.col("eccentricity"), "inc": F.col("inclination"), "raan": F.col("raan"), "argp": F.col("arg_pericenter"),
        "ma": F.col("mean_anomaly"), "bstar": F.col("bstar"), "ndot": F.col("mean_motion_dot"), "nddot": F.col("mean_motion_ddot"), "esn": F.col("element_set_no"), "rev": F.col("rev_at_epoch"), "op": F.coalesce("operator_code", F.lit(-1)), "cc": F.coalesce("country_code", F.lit(-1)),
        "cs": F.coalesce("constellation_code", F.lit(-1)), "mi": at(vocab.MISSIONS, "mission", 6), "se": at(vocab.SECTORS, "sector", 4), "ld": F.coalesce("launch_date", F.lit("")), "ms": F.floor(F.coalesce("mass_kg", F.lit(0.0)) + 0.5).cast("double"),
    }


def head(source: dict[str, str], generated_at: str) -> list[Column]:
    """The columns of HEAD_SCHEMA."""
    return [F.lit(1).alias("version"), F.lit(generated_at).alias("generatedAt"), F.struct(*[F.lit(source.get(f)).cast("string").alias(f) for f in SOURCE]).alias("source")]


def write_payload(catalog: DataFrame, source: dict[str, str], generated_at: str) -> DataFrame:
    """The columnar payload as one row of PAYLOAD_SCHEMA, for exchange; a catalogue itself is kept as Parquet.

    As one row its arrays meet in one task, which bounds it to what a task holds. `document` writes and reads the same document in
    lines, which no task holds; `chunks` has the same columns in parts.
    """
    order = Window.partitionBy("c").orderBy("first")
    ords = {}
    for c in ("operator", "country", "constellation"):
        firsts = catalog.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.min("id").alias("first"))
        ords[c] = firsts.withColumn("c", F.lit(0)).select("v", (F.row_number().over(order) - 1).alias("code"))
    rows = catalog
    for c, codes in ords.items():
        rows = rows.join(F.broadcast(codes.select(F.col("v").alias(c), F.col("code").alias(f"{c}_code"))), c, "left")
    one = rows.select(F.struct(F.col("id").alias("k"), *[v.alias(f"_{c}") for c, v in encoded().items()]).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("r"))
    names = lambda c: ords[c].agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "v"))), lambda x: x["v"]).alias({"operator": "operators", "country": "countries", "constellation": "constellations"}[c]))
    for c in ords:
        one = one.crossJoin(names(c))  # rows of one
    return one.select(
        *head(source, generated_at), F.size("r").alias("count"),
        F.struct("operators", "countries", "constellations").alias("dict"), F.struct(*[F.col(f"r._{c}").alias(c) for c in PAYLOAD]).alias("cols"),
    )

