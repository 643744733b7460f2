"""A store of versions with a log: the last good copy stays until a new one is whole.

A version is a folder that is written once and never again. The log is a table with a row per version that became current, and a
row is appended only when its version is written and has passed its gate; the last row is the pointer. A write that fails, at
whatever point, leaves a folder that no row names; whoever read before reads on. Figures for the gate are observed in the pass
that writes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import files

LOG = "number long, version string, written_s double, figures map<string,double>"
Gate = Callable[[dict[str, float], "dict[str, float] | None"], "str | None"]


class Refused(files.SourceError):
    """A version that the gate didn't let become current."""

    def __init__(self, reason: str):
        super().__init__("refused", reason)


class VersionedStore:
    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock

    def log(self) -> DataFrame:
        """The versions that became current, in columns of LOG."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")
        except AnalysisException:  # nothing has been published yet
            return self.spark.createDataFrame([], LOG)

    def last(self) -> dict | None:
        """The log's last row. Of two that were published at the same time the later one by the clock, then by name, counts."""
        row = self.log().orderBy(F.desc("number"), F.desc("written_s"), F.desc("version")).limit(1).collect()
        return row[0].asDict() if row else None

    def read(self, version: str | None = None) -> DataFrame:
        """A version, the current one if not said."""
        if version is None:
            last = self.last()
            if last is None:
                raise files.SourceError("invalid", "nothing has been published")
            version = last["version"]
        return self.spark.read.parquet(f"{self.folder}/versions/{version}")

    def publish(self, rows: DataFrame, figures: dict[str, Column] | None = None, gate: Gate | None = None) -> dict:
        """Write `rows` as a new version and make it current; the log's new row.

        figures: aggregates over the rows, beside their number `rows`. gate(figures, figures of the current version or None) gives a
        reason to refuse, or None; a refused version raises Refused and the current one stays.
        """
        before, version, seen = self.last(), uuid.uuid4().hex, Observation()
        watched = rows.observe(seen, F.count("*").alias("rows"), *[c.cast("double").alias(name) for name, c in (figures or {}).items()])
        watched.write.parquet(f"{self.folder}/versions/{version}")
        found = {k: float(v) for k, v in seen.get.items() if v is not None}
        reason = gate(found, before and before["figures"]) if gate else None
        if reason:
            raise Refused(reason)
        row = (before["number"] + 1 if before else 1, version, float(self.clock()), found)
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return dict(zip(("number", "version", "written_s", "figures"), row))


def coverage_figures(general_hit: Column) -> dict[str, Column]:
    """What a refresh of the catalogue is judged by."""
    return {"general_hits": F.count_if(general_hit), "unknown_country": F.count_if(F.col("country") == "XX"), "newest_epoch_ms": F.max("epoch_ms")}


def coverage_gate(least_rows: int = files.MINIMUM_ROWS, unknown_share: float = 0.5, shrink: float = 0.5) -> Gate:
    """Refuses few rows, many of unknown country, and under `shrink` of the rows of the current version."""

    def judge(now: dict[str, float], before: dict[str, float] | None) -> str | None:
        if now["rows"] < least_rows:
            return f"{now['rows']:.0f} rows, fewer than {least_rows}"
        if now.get("unknown_country", 0.0) > unknown_share * now["rows"]:
            return f"{now['unknown_country']:.0f} of {now['rows']:.0f} rows are of unknown country"
        if before and now["rows"] < shrink * before["rows"]:
            return f"{now['rows']:.0f} rows after {before['rows']:.0f}"
        return None

    return judge
