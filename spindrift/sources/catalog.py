"""From element sets and registries to the catalogue: enrichment by joins and rules, derived columns, and the source chain."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.classify import filled
from ..functions.orbit import orbit_columns
from . import files, store

META = "operator string, country string, constellation string, mission string, sector string, launch_date string, mass_kg float"
HALF_DAY_MS, TTL_S = 6 * 3_600_000, 7200


def organisation_name(code: Column, known: Column, listed: Column) -> Column:
    """Name of an organisation: the known one of its code, else the first filled one of the registry of organisations."""
    return F.when(code.isNull() | code.isin("", "-"), None).otherwise(F.coalesce(known, listed))


def general_registry(satcat: DataFrame, payloads: DataFrame, orgs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """id, g_owner_name, g_state, g_date, g_mass, g_category and g_class of the general catalogue, last rows winning.

    names: table (code, name) of preferred names; codes are tried whole, then without a final `?` and what follows a slash.
    """
    spark = satcat.sparkSession
    names = names if names is not None else spark.createDataFrame([], "code string, name string")
    rows = files.last_by(satcat.withColumn("id", F.col("Satcat").try_cast("int")).filter("id > 0"), "id")
    kinds = files.last_by(payloads.select("JCAT", F.col("Category").alias("g_category"), F.col("Class").alias("g_class"), *files.placed(payloads)), "JCAT")
    plain = lambda c: F.nullif(filled(F.trim(F.col(c))), F.lit("-"))
    listed = files.last_by(orgs.select(F.col("Code").alias("code"), F.coalesce(plain("ShortEName"), plain("EName"), plain("ShortName"), plain("Name")).alias("listed"), *files.placed(orgs)), "code")
    part = F.split(F.regexp_replace("Owner", r"\?\z", ""), "/")[0]
    out = rows.withColumn("part", part).join(kinds, "JCAT", "left")
    out = out.join(names.select(F.col("code").alias("Owner"), F.col("name").alias("whole_name")), "Owner", "left").join(names.select(F.col("code").alias("part"), F.col("name").alias("part_name")), "part", "left")
    out = out.join(listed.select(F.col("code").alias("Owner"), "listed"), "Owner", "left").join(listed.select(F.col("code").alias("part"), F.col("listed").alias("part_listed")), "part", "left")
    name = organisation_name(F.col("Owner"), F.coalesce("whole_name", "part_name"), F.coalesce("listed", "part_listed"))
    return out.select("id", name.alias("g_owner_name"), F.col("State").alias("g_state"), classify.catalogue_date(F.col("LDate")).alias("g_date"), F.col("Mass").try_cast("float").alias("g_mass"), "g_category", "g_class")


def _unnamed(name: Column) -> Column:
    return F.when(name.rlike(r"\A\d{4}-\d{3}[A-Z]+\z"), "Unidentified").otherwise("Unknown operator")


def enrich(elements: DataFrame, registry: DataFrame, general: DataFrame) -> DataFrame:
    """Elements with metadata. What wins: for a named constellation its rule; else general catalogue, registry, rule."""
    # After the joins: tried in the pass that reads a file, the rules take longer.
    rows = classify.with_rule(elements.join(registry, "id", "left").join(general, "id", "left"))
    rule = lambda f: F.col(f"rule_{f}")
    crewed = rule("constellation").isNotNull() | (rule("mission") == "human")
    return rows.select(
        *elements.columns,
        F.coalesce(F.when(rule("constellation").isNotNull(), rule("operator")), filled(F.col("g_owner_name")), rule("operator"), _unnamed(F.col("name"))).alias("operator"),
        F.coalesce(classify.state_country(F.col("g_state")), classify.owner_country(F.col("owner")), rule("country"), F.lit("XX")).alias("country"),
        rule("constellation").alias("constellation"),
        F.coalesce(F.when(crewed, rule("mission")), classify.category_mission(F.col("g_category"), F.col("g_class")), rule("mission"), F.lit("tech")).alias("mission"),
        F.coalesce(classify.class_sector(F.col("g_class")), rule("sector"), F.lit("unknown")).alias("sector"),
        F.coalesce(filled(F.col("registered")), filled(F.col("g_date")), F.lit("")).alias("launch_date"),
        F.nullif("g_mass", F.lit(0.0).cast("float")).alias("mass_kg"),
    )


def resolve(elements: DataFrame, known: DataFrame, registry: DataFrame) -> DataFrame:
    """Elements with metadata of a snapshot (`known`: id and META columns) where it has the id, else inferred."""
    fields = [x.split(" ")[0] for x in META.split(", ")]
    seen = files.last_by(known.select("id", *fields), "id").select("id", *[F.col(f).alias(f"k_{f}") for f in fields], F.lit(True).alias("k"))
    rows = classify.with_rule(elements).join(registry, "id", "left").join(seen, "id", "left")
    rule = lambda f: F.col(f"rule_{f}")
    inferred = {
        "operator": F.coalesce(rule("operator"), _unnamed(F.col("name"))), "country": F.coalesce(classify.owner_country(F.col("owner")), rule("country"), F.lit("XX")), "constellation": rule("constellation"),
        "mission": F.coalesce(rule("mission"), F.lit("tech")), "sector": F.coalesce(rule("sector"), F.lit("unknown")), "launch_date": F.coalesce(filled(F.col("registered")), classify.cospar_year(F.col("cospar"))), "mass_kg": F.lit(None).cast("float"),
    }
    return rows.select(*elements.columns, *[F.when(F.col("k"), F.col(f"k_{f}")).otherwise(inferred[f]).alias(f) for f in fields])


def decode(rows: DataFrame) -> DataFrame:
    """The catalogue: enriched rows with bloc, launch_ms, search_name and the derived orbit columns."""
    return rows.withColumns({"bloc": classify.country_bloc(F.col("country")), "launch_ms": classify.launch_ms(F.col("launch_date")), "search_name": F.upper("name"), **orbit_columns(F.col("mean_motion"), F.col("eccentricity"))})


def sgp4_record(rows: DataFrame) -> DataFrame:
    """The columns that propagation takes, under the names of the exchange format."""
    names = {"OBJECT_NAME": "name", "OBJECT_ID": "cospar", "NORAD_CAT_ID": "id", "MEAN_MOTION": "mean_motion", "ECCENTRICITY": "eccentricity", "INCLINATION": "inclination", "RA_OF_ASC_NODE": "raan", "ARG_OF_PERICENTER": "arg_pericenter", "MEAN_ANOMALY": "mean_anomaly", "BSTAR": "bstar", "MEAN_MOTION_DOT": "mean_motion_dot", "MEAN_MOTION_DDOT": "mean_motion_ddot", "ELEMENT_SET_NO": "element_set_no", "REV_AT_EPOCH": "rev_at_epoch"}
    return rows.select(*[F.col(c).alias(n) for n, c in names.items()], F.date_format(F.timestamp_millis("epoch_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("EPOCH"))


def by_id(catalog: DataFrame, id: int) -> DataFrame:
    return catalog.filter(F.col("id") == id)


def newest_epoch(elements: DataFrame, now_ms: int) -> DataFrame:
    """One row (newest_ms): the latest epoch that isn't over six hours ahead of now; now if there is none."""
    return elements.agg(F.coalesce(F.max(F.when(F.col("epoch_ms") <= now_ms + HALF_DAY_MS, F.col("epoch_ms"))), F.lit(now_ms)).alias("newest_ms"))


def coverage(elements: DataFrame, general: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row: rows, general_hits, unknown_country, operators, countries, constellations."""
    hits = elements.join(general.select("id"), "id", "left_semi").agg(F.count("*").alias("general_hits"))
    return enriched.agg(F.count("*").alias("rows"), F.count_if(F.col("country") == "XX").alias("unknown_country"), F.countDistinct("operator").alias("operators"), F.countDistinct("country").alias("countries"), F.countDistinct("constellation").alias("constellations")).crossJoin(hits)


def refresh(into: store.VersionedStore, elements: DataFrame, registry: DataFrame, general: DataFrame, gate: store.Gate | None = None) -> dict:
    """Enrich the elements, write them as a new version of `into`, and make it current if its coverage passes the gate.

    The figures (rows, general_hits, unknown_country, newest_epoch_ms) are observed in the pass that writes; they stand in the log.
    """
    marked = elements.join(general.select("id", F.lit(True).alias("in_general")), "id", "left")
    rows = enrich(marked, registry, general)
    return into.publish(rows, store.coverage_figures(F.coalesce("in_general", F.lit(False))), gate or store.coverage_gate())


#: What is said of a catalogue that isn't live.
NOTES = {
    "offline": "Offline mode: serving bundled snapshot.",
    "warm-cache": "Upstream unavailable; serving last good copy.",
    "snapshot": "Live source unavailable at build time; serving bundled snapshot.",
}


class CatalogStore:
    """The chain of sources: offline -> snapshot; fresh copy; live; last good copy after any failure; snapshot; error.

    Copies are versions in `cache_path`: a live source that fails while it is written harms none of them, frames that were handed
    out before can still be read, and a store that is opened anew finds the last good copy of the one before.
    """

    def __init__(self, spark: SparkSession, live: Callable[[], DataFrame], snapshot: Callable[[], DataFrame], cache_path: str, offline: bool = False, production: bool = False, ttl_s: float = TTL_S, clock: Callable[[], float] = time.time, gate: store.Gate | None = None):
        self.live, self.snapshot, self.versions = live, snapshot, store.VersionedStore(spark, cache_path, clock)
        self.offline, self.production, self.ttl_s, self.clock, self.gate = offline, production, ttl_s, clock, gate

    @staticmethod
    def _said(rows: DataFrame, mode: str, note: str | None = None) -> DataFrame:
        return rows.withColumns({"source_mode": F.lit(mode), "source_note": F.lit(note).cast("string")})

    def get(self) -> DataFrame:
        """The catalogue with the columns source_mode (live, warm-cache or snapshot) and source_note (null: live)."""
        if self.offline:
            return self._said(self.snapshot(), "snapshot", NOTES["offline"])
        last = self.versions.last()
        if last is not None and self.clock() - last["written_s"] < self.ttl_s:
            return self._said(self.versions.read(last["version"]), "live")
        try:
            made = self.versions.publish(self.live(), gate=self.gate)
            return self._said(self.versions.read(made["version"]), "live")
        except Exception:  # whatever the source or the write failed of
            if last is not None:
                return self._said(self.versions.read(last["version"]), "warm-cache", NOTES["warm-cache"])
            if self.production:
                raise
            return self._said(self.snapshot(), "snapshot", NOTES["snapshot"])


def load_best(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, str]:
    """The payload of `api` if it can be read; else of `browser-cache` and `snapshot` the one with the greater newest epoch."""
    found = []
    for origin in ("api", "browser-cache", "snapshot"):
        try:
            payload = files.read_payload(spark, paths[origin]) if origin in paths else None
        except Exception:  # a missing or broken file is one candidate less
            payload = None
        if payload is None:
            continue
        if origin == "api":
            return payload, origin
        found.append((payload.select("source.newestEpoch").first()[0] or "", origin == "snapshot", payload, origin))
    if not found:
        raise files.SourceError("invalid", "no catalogue can be read")
    best = max(found, key=lambda x: (x[0], x[1]))
    return best[2], best[3]
