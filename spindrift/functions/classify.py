"""Classification of names, codes and dates as Columns; null is "unknown"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import vocab

RULE_FIELDS = ("constellation", "operator", "mission", "country", "sector")


def filled(c: Column) -> Column:
    """Null where a text is empty."""
    return F.nullif(c, F.lit(""))


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a fixed map (a literal of the plan), or null."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def with_rule(rows: DataFrame, name: str = "name", prefix: str = "rule_") -> DataFrame:
    """`rows` with rule_number (from 1; 0: none) and the RULE_FIELDS of the first rule that the upper-case name matches.

    The patterns are one CASE, tried once per row; what the rule says is joined from a table of 42 rows, so that a filter
    on it is a filter on a column and not the patterns again.
    """
    upper, rules = F.upper(name), vocab.NAME_RULES
    number = reduce(lambda out, i: out.when(upper.rlike(rules[i][0]), i + 1), range(1, len(rules)), F.when(upper.rlike(rules[0][0]), 1)).otherwise(0)
    said = rows.sparkSession.createDataFrame([(i + 1, *r[1:]) for i, r in enumerate(rules)], f"{prefix}number int, " + ", ".join(f"{prefix}{f} string" for f in RULE_FIELDS))
    return rows.withColumn(f"{prefix}number", number).join(F.broadcast(said), f"{prefix}number", "left")


def country_bloc(code: Column) -> Column:
    return F.coalesce(lookup({c: b for c, _, b in vocab.COUNTRIES}, code), F.lit("OT"))


def country_name(code: Column) -> Column:
    return F.coalesce(lookup({c: n for c, n, _ in vocab.COUNTRIES}, code), code)


def country_flag(code: Column) -> Column:
    """Regional indicators of two capitals; a globe for anything else and for XX."""
    indicator = lambda i: F.substring(F.lit("".join(chr(0x1F1E6 + k) for k in range(26))), F.ascii(F.substring(code, i, 1)) - 64, F.lit(1))
    return F.when(code.rlike(r"\A[A-Z]{2}\z") & (code != "XX"), F.concat(indicator(1), indicator(2))).otherwise("🌐")


def owner_country(owner: Column) -> Column:
    return lookup(vocab.OWNER_COUNTRY, owner)


def state_country(state: Column) -> Column:
    return F.when((state == "") | (state == "-"), None).otherwise(F.coalesce(lookup(vocab.STATE_COUNTRY, state), F.when(state.startswith("I-"), "INT"), F.when(state.rlike(r"\A[A-Z]{2}\z"), state)))


def class_sector(cls: Column) -> Column:
    return lookup(vocab.CLASS_SECTOR, F.substring(cls, 1, 1))


def category_mission(category: Column, cls: Column) -> Column:
    """Defence satellites count as military unless they are for navigation or crews."""
    head = F.split(F.regexp_replace(category, "[?*]", ""), "/")[0]
    mission = F.coalesce(lookup(vocab.CATEGORY_MISSION, head), F.lit("tech"))
    military = F.coalesce(cls.startswith("D"), F.lit(False)) & ~mission.isin("nav", "human")
    return F.when(category.isNull() | category.isin("", "-"), None).otherwise(F.when(military, "military").otherwise(mission))


def catalogue_date(text: Column) -> Column:
    """`2020 Jan  5` with anything after it -> 2020-01-05; empty if it has no such form."""
    month = lookup({m: f"{i + 1:02d}" for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}, F.regexp_extract(text, r"\A(\d{4})\s+([A-Z][a-z]{2})\s+(\d{1,2})", 2))
    part = lambda i: F.regexp_extract(text, r"\A(\d{4})\s+([A-Z][a-z]{2})\s+(\d{1,2})", i)
    return F.coalesce(F.when(text.rlike(r"\A\d{4}\s+[A-Z][a-z]{2}\s+\d{1,2}"), F.concat_ws("-", part(1), F.coalesce(month, F.lit("01")), F.lpad(part(3), 2, "0"))), F.lit(""))


def launch_ms(date: Column) -> Column:
    """Midnight UTC of an ISO date, 1 July of a bare year; null where it is neither or no such day."""
    year = F.when(date.rlike(r"\A\d{4}\z"), F.make_date(F.try_to_number(date, F.lit("9999")).cast("int"), F.lit(7), F.lit(1)))
    day = F.when(date.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(date, "yyyy-MM-dd"))
    return F.datediff(F.coalesce(year, day), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000


def cospar_year(cospar: Column) -> Column:
    return F.regexp_extract(cospar, r"\A(\d{4})-", 1)


def epoch_ms(text: Column) -> Column:
    """Milliseconds of `YYYY-MM-DDTHH:MM:SS[.fraction]`, UTC, rounded half up; null for other texts."""
    pattern = r"\A(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(\.\d+)?"
    part = lambda i: F.regexp_extract(text, pattern, i)
    days = F.datediff(F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")).cast("long")
    fraction = F.floor(F.coalesce(part(7).try_cast("double"), F.lit(0.0)) * 1000 + 0.5).cast("long")
    number = lambda i: part(i).try_cast("long")
    return F.when(text.rlike(pattern), ((days * 24 + number(4)) * 60 + number(5)) * 60_000 + number(6) * 1000 + fraction)
