"""A catalogue made from the orders and customer tables, for queries over generated data; the same SQL runs on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, orbit
from . import vocab

#: 2001-08-01T00:00:00Z: the latest order date.
NOW_MS = 996_624_000_000

ELEMENTS_SQL = """
select o.o_orderkey as id,
  case o.o_orderkey % 12
    when 0 then 'STARLINK-' || cast(o.o_orderkey as string) when 1 then 'ONEWEB-' || cast(o.o_orderkey as string)
    when 2 then 'COSMOS ' || cast(o.o_orderkey as string) when 3 then 'GPS BIIR-' || cast(o.o_orderkey as string)
    when 4 then 'ISS (' || cast(o.o_orderkey as string) || ')' when 5 then 'LEMUR-2 ' || cast(o.o_orderkey as string)
    when 6 then 'COSMOS ' || cast(o.o_orderkey as string) || ' [GLONASS-M]' when 7 then 'YAOGAN-' || cast(o.o_orderkey as string)
    when 8 then 'KOMPSAT-' || cast(o.o_orderkey as string) when 9 then 'QIANFAN-' || cast(o.o_orderkey as string)
    when 10 then 'NEXTSAT-' || cast(o.o_orderkey as string) else 'OBJ ' || cast(o.o_orderkey as string) end as name,
  c.c_mktsegment as operator,
  split_part('US,CN,RU,JP,IN,KR,GB,FR,DE,EU,IT,ES,LU,FI,CA,AU,BR,AE,TR,IL,TW,HK,SG,INT,XX', ',', c.c_nationkey + 1) as country,
  case when o.o_orderkey % 53 = 0 then null
    when o.o_orderkey % 37 = 0 then make_date(cast(year(o.o_orderdate) as int), 7, 1)
    else cast(o.o_orderdate as date) end as launch_date,
  case o.o_custkey % 10 when 7 then 2.0056e0 when 8 then 1.0027e0 when 9 then 2.006e0
    else 11.5e0 + ((o.o_orderkey * 7919) % 4300) / 1000e0 end as mean_motion,
  case o.o_custkey % 10 when 9 then 0.72e0 else (o.o_orderkey % 97) / 10000e0 end as eccentricity,
  ((o.o_orderkey * 7) % 1800) / 10e0 as inclination
from {orders} o join {customer} c on o.o_custkey = c.c_custkey
"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ELEMENTS_SQL, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the generated catalogue, the columns that need no rule of names; for queries of positions and altitudes alone."""
    rows = elements(spark, sf_dir)
    alt = orbit.semi_major_axis(F.col("mean_motion")) - orbit.EARTH_RADIUS_KM
    return rows.select("id", "country", "mean_motion", "eccentricity", "inclination", F.round(alt, 3).cast("float").alias("mean_alt_km"))


def catalog(spark: SparkSession, sf_dir: str, rules: bool = True) -> DataFrame:
    """The generated catalogue with its derived columns; altitudes are rounded to metres, so that engines agree on bins.

    rules: whether names are tried against the rules; without, there are no constellations, and defaults for the rest.
    """
    none = {f"rule_{f}": F.lit(None).cast("string") for f in ("constellation", "mission", "sector")}
    rows = classify.with_rule(elements(spark, sf_dir)) if rules else elements(spark, sf_dir).withColumns(none)
    alt = orbit.semi_major_axis(F.col("mean_motion")) - orbit.EARTH_RADIUS_KM
    derived = orbit.orbit_columns(F.col("mean_motion"), F.col("eccentricity"))
    return rows.select(
        "id", "name", "operator", "country", classify.country_bloc(F.col("country")).alias("bloc"), F.col("rule_constellation").alias("constellation"),
        F.coalesce("rule_mission", F.lit("tech")).alias("mission"), F.coalesce("rule_sector", F.lit("unknown")).alias("sector"),
        (F.datediff("launch_date", F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000).alias("launch_ms"),
        "mean_motion", "eccentricity", "inclination", F.round(alt, 3).cast("float").alias("mean_alt_km"), F.round(orbit.semi_major_axis(F.col("mean_motion")) * (1 + F.col("eccentricity")) - orbit.EARTH_RADIUS_KM, 3).cast("float").alias("apogee_km"),
        derived["regime"].alias("regime"),
    )


def _quoted(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def _case(column: int, otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches(upper(name), {_quoted(r[0])}) then {_quoted(r[column])}" for r in vocab.NAME_RULES) + f" else {otherwise} end"


_BLOCS = "case " + " ".join(f"when country in ({', '.join(_quoted(c) for c, _, x in vocab.COUNTRIES if x == b)}) then '{b}'" for b, _, _ in vocab.BLOCS if b != "OT") + " else 'OT' end"
#: The common table `cat` for the SQL of an oracle, to be followed by more tables or a select.
ORACLE_CATALOG = f"""
el as ({ELEMENTS_SQL.format(orders="orders", customer="customer")}),
a0 as (select *, cbrt(398600.8e0 / ((mean_motion * 2e0 * pi() / 86400e0) * (mean_motion * 2e0 * pi() / 86400e0))) as axis from el),
cat as (
  select id, name, operator, country, {_BLOCS} as bloc, {_case(1, "null")} as constellation, coalesce({_case(3, "null")}, 'tech') as mission,
    coalesce({_case(5, "null")}, 'unknown') as sector, (launch_date - date '1970-01-01')::bigint * 86400000 as launch_ms,
    mean_motion, eccentricity, inclination, cast(round(axis - 6378.135e0, 3) as float) as mean_alt_km,
    cast(round(axis * (1 + eccentricity) - 6378.135e0, 3) as float) as apogee_km,
    case when eccentricity > 0.25e0 then 'HEO' when axis - 6378.135e0 < 2000e0 then 'LEO'
      when mean_motion > 0.95e0 and mean_motion < 1.05e0 and eccentricity < 0.1e0 then 'GEO'
      when axis - 6378.135e0 > 37286e0 then 'HEO' else 'MEO' end as regime
  from a0)
"""
