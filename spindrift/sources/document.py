"""The payload as one columnar document that no task holds: text in lines, written and read in parts.

A folder has `text`: its files one after the other, by name, are the document, also where they are gzip files. A line is either a
mark, which closes an array and opens the next one, or some of an array's values, as many rows for each column. A mark begins with
a bracket, which no value does. `rows`, `dict` and `sums` are what the text was made from and can go.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks, files

ROWS = 5_000
#: Lines of a file of the text.
LINES = 128
#: Arrays in their order, with the kind of their values.
_ARRAYS = [*[(d, "string") for d in ("operators", "countries", "constellations")], *files.PAYLOAD.items()]
_DICTS = 3
#: Marks after the first.
_MARKS = [*[("]},\"cols\":{" if i == _DICTS else "],") + f'"{name}":[' for i, (name, _) in enumerate(_ARRAYS)][1:], "]}}"]
_OPENS = ',"dict":{"operators":['
#: A longer head isn't taken for one.
_LONGEST = 65_536


def write_document(catalog: DataFrame, folder: str, source: dict[str, str], generated_at: str, rows: int = ROWS, compression: str = "none") -> str:
    """Write a catalogue to a new folder; the path of the text. The catalogue is read twice, so it should be a stored table.

    rows: most values of a line. Rows are in the order of their ids; those that repeat an id stay.
    """
    spark, folder = catalog.sparkSession, folder.rstrip("/")
    chunks.dictionaries(catalog).write.parquet(f"{folder}/dict")
    words = spark.read.parquet(f"{folder}/dict")
    coded = chunks.coded(catalog, lambda d: words.filter(F.col("dict") == d))
    inner = lambda array: F.expr(f"substring({array}, 2, length({array}) - 2)")
    # Stored, so that rows are sorted once: what deals lines out by range reads them twice.
    texts = chunks.grouped(coded, rows).select("range", "part", F.size("r").alias("n"), *[F.to_json(F.col(f"r.{c}")).alias(c) for c in files.PAYLOAD])
    texts.select("range", "part", "n", *[inner(c).alias(c) for c in files.PAYLOAD]).write.option("compression", "zstd").parquet(f"{folder}/rows")
    stored = spark.read.parquet(f"{folder}/rows")
    sums = stored.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min(F.struct("range", "part")).alias("first")).first()  # one row
    of_rows = stored.select("range", "part", F.inline(F.array(*[F.struct(F.lit(2 * i + 1).alias("section"), F.col(name).alias("text")) for i, (name, _) in enumerate(_ARRAYS) if i >= _DICTS])))
    held = words.withColumn("part", F.floor(F.col("code") / rows)).groupBy("dict", "part").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("code", "value"))), lambda x: x["value"])).alias("text"))
    names = F.array(*[F.lit(name) for name, _ in _ARRAYS[:_DICTS]])
    of_dicts = held.select(F.lit(0).cast("long").alias("range"), F.col("part").cast("long").alias("part"), (2 * F.array_position(names, F.col("dict")) - 1).cast("int").alias("section"), inner("text").alias("text"))
    begins = (F.col("section") < 2 * _DICTS) & (F.col("part") == 0)
    if sums["n"]:
        begins = begins | (F.col("section") > 2 * _DICTS) & (F.col("range") == sums["first"]["range"]) & (F.col("part") == sums["first"]["part"])
    values = of_rows.unionByName(of_dicts).select("section", "range", "part", F.when(begins, F.col("text")).otherwise(F.concat(F.lit(","), "text")).alias("value"))
    head = json.dumps({"version": 1, "generatedAt": generated_at, "source": {f: source.get(f) for f in files.SOURCE}, "count": sums["n"]}, separators=(",", ":"))
    marks = spark.createDataFrame([(2 * i, 0, 0, text) for i, text in enumerate([head[:-1] + _OPENS, *_MARKS])], "section int, range long, part long, value string")
    order = ("section", "range", "part")
    # By number: by bytes, columns of few values would be a long text that is a small file.
    several = 1 + (stored.count() * len(files.PAYLOAD) + held.count()) // LINES
    values.unionByName(marks).repartitionByRange(several, *order).sortWithinPartitions(*order).select("value").write.option("compression", compression).text(f"{folder}/text")
    return f"{folder}/text"


def _runs(lines: DataFrame) -> tuple[dict, list[tuple]] | None:
    """The head, and the runs of lines between marks and ends of splits: path, split, first and last line, array, chunk of the first
    line. None if the marks aren't those of a document in lines."""
    mark = F.when(F.substring("value", 1, 1).isin("{", "]"), F.struct(files.PLACE + ".line", F.substring("value", 1, _LONGEST).alias("text")))
    # A row for each split; all splits together have as many marks as a document has.
    splits = lines.groupBy(f"{files.PLACE}.path", f"{files.PLACE}.split").agg(F.min(f"{files.PLACE}.line").alias("first"), F.max(f"{files.PLACE}.line").alias("last"), F.slice(F.array_sort(F.collect_list(mark)), 1, 2 * len(_ARRAYS)).alias("marks")).collect()
    head, at, chunk, runs, seen = None, -1, 0, [], []
    for s in sorted(splits, key=lambda s: (s["path"], s["split"])):
        begin = s["first"]
        for line, text in [*[tuple(m) for m in s["marks"]], (s["last"] + 1, None)]:
            if line > begin:
                runs.append((s["path"], s["split"], begin, line - 1, at, chunk))
                chunk += line - begin
            if text is not None:
                seen.append(text)
                begin, at, chunk = line + 1, at + 1, 0
    if not seen or seen[1:] != _MARKS or not seen[0].endswith(_OPENS) or any(not 0 <= r[4] < len(_ARRAYS) for r in runs):
        return None
    try:
        head = json.loads(seen[0].removesuffix(_OPENS) + "}")
    except ValueError:
        return None
    return head, runs


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a document, in the columns of `files.payload_rows`. One that isn't in such lines is read whole, by one task.

    An error if version, count and columns don't agree: at once, or for a chunk whose columns differ in length when it is read.
    """
    lines = spark.read.text(path).select("value", files.place().alias(files.PLACE))
    found = _runs(lines)
    if found is None:
        return files.payload_rows(files.read_payload(spark, path))
    head, runs = found
    table = spark.createDataFrame(runs, "path string, split long, begin long, end long, array int, chunk long")
    place = F.col(files.PLACE)
    at = lines.join(F.broadcast(table), (place["path"] == table["path"]) & (place["split"] == table["split"]) & (place["line"] >= table["begin"]) & (place["line"] <= table["end"]))
    at = at.select("array", (F.col("chunk") + place["line"] - F.col("begin")).alias("chunk"), F.concat(F.lit("["), F.ltrim(F.col("value"), F.lit(",")), F.lit("]")).alias("text"))
    held = at.agg(F.sum(F.when(F.col("array") == _DICTS, F.size(F.from_json("text", "array<int>")))).alias("ids"), F.count("*").alias("lines")).first()
    if head.get("version") != 1 or not held["ids"] or held["ids"] != head.get("count") or held["lines"] != sum(r[3] - r[2] + 1 for r in runs):
        raise files.SourceError("invalid", f"{path} is no payload of version 1 with {head.get('count')} rows")
    chunked = at.filter(F.col("array") >= _DICTS).groupBy("chunk").agg(*[F.first(F.when(F.col("array") == i, F.col("text")), ignorenulls=True).alias(name) for i, (name, _) in enumerate(_ARRAYS) if i >= _DICTS])
    arrays = chunked.select(*[F.from_json(name, f"array<{kind}>").alias(name) for name, kind in _ARRAYS[_DICTS:]])
    # A missing array has the size -1 or none here.
    sizes = [F.coalesce(F.size(name), F.lit(-1)) for name, _ in _ARRAYS[_DICTS:]]
    even = arrays.withColumn("id", F.when(F.least(*sizes) == F.greatest(*sizes), F.col("id")).otherwise(F.raise_error(F.lit(f"columns of {path} differ in length")).cast("array<int>")))
    rows = even.select(F.inline(F.arrays_zip(*files.PAYLOAD)))
    # Conditions on words are tried on all lines, so those of other arrays are null there.
    words = at.filter(F.col("array") < _DICTS).select("array", "chunk", F.from_json(F.when(F.col("array") < _DICTS, F.col("text")), "array<string>").alias("words"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("array").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = words.select("array", "chunk", F.size("words").alias("n")).select("array", "chunk", before.alias("before"))  # a row for each line
    coded = words.join(starts, ["array", "chunk"]).select("array", "before", F.posexplode("words").alias("place", "value"))
    for i, code in enumerate(("op", "cc", "cs")):
        named = coded.filter(F.col("array") == i).select((F.col("before") + F.col("place")).cast("int").alias(code), F.col("value").alias(_ARRAYS[i][0]))
        rows = rows.join(named, code, "left")
    return files.decoded(rows, lambda name, code: F.col(name))
