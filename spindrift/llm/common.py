"""Shared plumbing of the text operators: materialised tables, splits, stable ids."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a private one only where the setting is unset and Spark runs in one process,
    as in tests: executors elsewhere would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spindrift-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{folder}")
        folder = f"file://{folder}"
    return folder.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts the lineage, computes it once, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of `df` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Tables that this Python worker keeps from task to task, by the operator that they serve.
_held: dict[str, tuple] = {}


def claim(owner: str, *tables) -> None:
    """At the start of an operator's task: empties what tasks of others left in this worker; `tables` stay for its own.

    Workers live on from stage to stage, so that a run of several operators would fill them with the tables of all.
    """
    others = [x for x in _held if x != owner]
    for table in (t for x in others for t in _held.pop(x)):
        table.clear()
    if others:
        gc.collect()
    _held[owner] = tables


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def bucket_of(key: Column, splits: list) -> Column:
    """Number of `splits` (sorted, bounded in number by the caller) that are at most `key`.

    A binary search over the splits, which are one constant of the plan: a row looks at as many as their number has bits,
    and the plan has them once.
    """
    if not splits:
        return F.lit(0)
    table = F.lit(splits)
    steps = [1 << i for i in reversed(range(len(splits).bit_length()))]
    # `found` splits are known to be at most the key; are `step` more?
    ahead = lambda found, step: F.when(F.coalesce(F.get(table, found + step - 1) <= key, F.lit(False)), found + step).otherwise(found)
    return F.aggregate(F.lit(steps), F.lit(0), ahead)
