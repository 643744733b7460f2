"""Queries of formats, codes, dates, scales, lenses, search, insights and sources over the generated tables, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify, frames, orbit
from .functions import format as fmt
from .operators import card, compare, insights, motion, search, search_index, stats
from .plans import viewstate, vocab
from .plans.fixture import NOW_MS, _case, catalog, elements, orbits
from .plans.lens import PRESETS, Lens, preset_for_lens
from .queries import _BIN, _ENTRIES, _NAMED, _PRESET_SQL, ORACLES, _orbits, query
from .session import scratch
from .sources import catalog as sources
from .sources import chunks, document, files, store


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _nth(values: list, by: Column) -> Column:
    """The value at place `by` modulo their number."""
    kind = "string" if any(isinstance(v, str) for v in values) else "double"
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (by % len(values) + 1).cast("int"))


def _nth_sql(values: list, by: str) -> str:
    listed = ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{listed}][({by} % {len(values)} + 1)::int]"


_INT = "format('{{:,}}', floor({0} + 0.5)::bigint)"
_PCT = "case when {1} = 0 then '0%' when {0} / {1}::double * 100 > 0 and {0} / {1}::double * 100 < 1 then '<1%' else floor({0} / {1}::double * 100 + 0.5)::bigint || '%' end"


@query(
    "format_numbers",
    f"select id, {_INT.format('x')} || ' km' as km, case when x >= 100000 then printf('%.0f', x / 1000) || 'k' when x >= 10000 then regexp_replace(printf('%.1f', x / 1000), '\\.0$', '') || 'k' else {_INT.format('x')} end as compact, "
    f"case when w = 0 then 0 else floor(p / w::double * 100 + 0.5)::int end as share, {_PCT.format('p', 'w')} as pct, "
    "printf('%.1f', abs(lat)) || '°' || case when lat >= 0 then 'N' else 'S' end as lat, printf('%.1f', abs(lat)) || '°' || case when lat >= 0 then 'E' else 'W' end as lon "
    "from (select o_orderkey as id, floor(o_totalprice) / 3 + 0.37 as x, o_custkey % 211 as p, o_orderkey % 300 as w, (o_orderkey % 3600) / 20e0 - 90.013 as lat from orders)",
)
def format_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.floor("o_totalprice") / 3 + 0.37).alias("x"), (F.col("o_custkey") % 211).alias("p"), (F.col("o_orderkey") % 300).alias("w"), ((F.col("o_orderkey") % 3600) / 20.0 - 90.013).alias("lat")
    )
    return o.select("id", fmt.fmt_km(F.col("x")).alias("km"), fmt.fmt_compact(F.col("x")).alias("compact"), fmt.share(F.col("p"), F.col("w")).alias("share"), fmt.pct(F.col("p"), F.col("w")).alias("pct"), fmt.fmt_lat(F.col("lat")).alias("lat"), fmt.fmt_lon(F.col("lat")).alias("lon"))


_CLOCK = "floor({0})::bigint"


@query(
    "format_times",
    "select id, case when s < 60 then 'just now' when m < 60 then m || ' min ago' when h < 48 then h || ' h ago' else floor(h / 24e0 + 0.5)::bigint || ' days ago' end as ago, "
    "(case when dd >= 0 then '+' else '−' end) || case when ah >= 48 then floor(ah / 24e0 + 0.5)::bigint || ' d' when ah > 0 then ah || ' h ' || am || ' m' when am > 0 then am || ' m' else a || ' s' end as apart, "
    "strftime(make_timestamp(ms * 1000), '%H:%M:%S') || ' UTC' as clock, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') as day, "
    "case when p < 120 then floor(p + 0.5)::bigint || ' min' when p / 60 < 48 then regexp_replace(printf('%.1f', p / 60), '\\.0$', '') || ' h' else printf('%.1f', p / 1440) || ' days' end as period "
    "from (select *, floor(m / 60e0 + 0.5)::bigint as h, a // 3600 as ah, (a % 3600) // 60 as am from (select *, floor(s / 60e0 + 0.5)::bigint as m, abs(dd) as a from "
    "(select event_id as id, (epoch_us(ts) // 1000) as ms, floor((1706659200000 - (epoch_us(ts) // 1000)) / 1000e0 + 0.5)::bigint as s, floor(((epoch_us(ts) // 1000) - 1705276800000 - event_id * 977) / 1000e0 + 0.5)::bigint as dd, (event_id % 7001) * 0.613 + 0.011 as p from events)))",
)
def format_times(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").select(F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    apart = F.col("ms") - 1_705_276_800_000 - F.col("id") * 977
    return e.select("id", fmt.rel_time(F.col("ms"), F.lit(1_706_659_200_000)).alias("ago"), fmt.offset_label(apart).alias("apart"), fmt.utc_clock(F.col("ms")).alias("clock"), fmt.utc_date(F.col("ms")).alias("day"), fmt.fmt_duration((F.col("id") % 7001) * F.lit(0.613) + 0.011).alias("period"))


@query(
    "format_ages",
    "select id, coalesce(case when a < 1 then 'launched today' when a < 60 then floor(a + 0.5)::bigint || ' days in orbit' when a < 730 then floor(a / 30.4e0 + 0.5)::bigint || ' months in orbit' else floor(a / 365.25e0 + 0.5)::bigint || ' years in orbit' end, '') as age "
    f"from (select id, ({NOW_MS} - launch_ms) / 86400000e0 as a from cat)",
)
def format_ages(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("id", fmt.fmt_age(F.col("launch_ms"), F.lit(NOW_MS)).alias("age"))


#: Where a catalogue came from, its mode, and the word for it.
_FRESH = [("api", "live", "Live"), ("api", "warm-cache", "Cached"), ("browser-cache", "live", "Cached"), ("snapshot", "snapshot", "Snapshot"), ("api", "snapshot", "Snapshot")]


@query("freshness", f"select id, {_nth_sql([x[2] for x in _FRESH], 'id')} as word from cat")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("id", fmt.freshness(_nth([x[0] for x in _FRESH], F.col("id")), _nth([x[1] for x in _FRESH], F.col("id"))).alias("word"))


@query(
    "country_labels",
    "select id, case country when 'US' then 'United States' when 'KR' then 'South Korea' when 'GB' then 'United Kingdom' when 'HK' then 'Hong Kong (China)' when 'ZZ' then 'ZZ' end as name, "
    "case country when 'US' then '🇺🇸' when 'KR' then '🇰🇷' when 'GB' then '🇬🇧' when 'HK' then '🇭🇰' when 'ZZ' then '🇿🇿' end as flag, case country when 'US' then 'US' when 'KR' then 'KR' when 'GB' then 'EU' when 'HK' then 'CN' else 'OT' end as bloc "
    f"from (select id, {_nth_sql(['US', 'KR', 'GB', 'HK', 'ZZ'], 'id')} as country from cat)",
)
def country_labels(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("code")
    return catalog(spark, d).select("id", _nth(["US", "KR", "GB", "HK", "ZZ"], F.col("id")).alias("code")).select("id", classify.country_name(code).alias("name"), classify.country_flag(code).alias("flag"), classify.country_bloc(code).alias("bloc"))


#: Codes of registries and what they stand for: owner, state, (category, class, mission, sector).
_OWNERS = [("US", "US"), ("PRC", "CN"), ("CIS", "RU"), ("JPN", "JP"), ("ESA", "EU"), ("SKOR", "KR"), ("ZZZ", None)]
_STATES = [("UK", "GB"), ("J", "JP"), ("I-ESA", "EU"), ("I-ARAB", "INT"), ("KR", "KR"), ("-", None), ("", None), ("zzz", None)]
_KINDS = [("IMG", "D", "military", "military"), ("NAV", "D", "nav", "military"), ("COM", "B", "comms", "commercial"), ("IMG-R", "C", "eo", "civil"), ("SS", "C", "human", "civil"), ("-", "B", None, "commercial"), ("COM/NAV?", "A", "comms", "academic")]


@query("registry_codes", f"select id, {_nth_sql([x[1] for x in _OWNERS], 'id')} as owner, {_nth_sql([x[1] for x in _STATES], 'id')} as state, {_nth_sql([x[2] for x in _KINDS], 'id')} as mission, {_nth_sql([x[3] for x in _KINDS], 'id')} as sector from cat")
def registry_codes(spark: SparkSession, d: str) -> DataFrame:
    of = lambda table, k: _nth([x[k] for x in table], F.col("id"))
    rows = catalog(spark, d).select("id", of(_OWNERS, 0).alias("o"), of(_STATES, 0).alias("s"), of(_KINDS, 0).alias("k"), of(_KINDS, 1).alias("c"))
    return rows.select("id", classify.owner_country(F.col("o")).alias("owner"), classify.state_country(F.col("s")).alias("state"), classify.category_mission(F.col("k"), F.col("c")).alias("mission"), classify.class_sector(F.col("c")).alias("sector"))


#: Names and the constellation that a rule gives them.
_RULED = [("STARLINK-1008", "starlink"), ("ONEWEB-0115", "oneweb"), ("KUIPER-00008", "kuiper"), ("COSMOS 2433 [GLONASS-M]", "glonass"), ("COSMOS 2503", None), ("GSAT0201 (GALILEO 5)", "galileo"), ("GSAT-30", None), ("starlink-77", "starlink")]


@query("name_rule_cases", f"select id, {_nth_sql([x[1] for x in _RULED], 'id')} as constellation from cat")
def name_rule_cases(spark: SparkSession, d: str) -> DataFrame:
    names = catalog(spark, d).select("id", _nth([x[0] for x in _RULED], F.col("id")).alias("name"))
    return classify.with_rule(names).select("id", F.col("rule_constellation").alias("constellation"))


@query(
    "date_columns",
    "select o_orderkey as id, strftime(day, '%Y-%m-%d') as listed, (case when o_orderkey % 5 = 0 then make_date(year(day), 7, 1) else day end - date '1970-01-01')::bigint * 86400000 as launch_ms, "
    "year(day)::varchar as year, epoch_ms(day::timestamp) + (o_orderkey % 24) * 3600000 + 14356 as epoch_ms from (select o_orderkey, o_orderdate::date as day from orders)",
)
def date_columns(spark: SparkSession, d: str) -> DataFrame:
    """Registry dates, launch times, designator years and epochs from their texts."""
    day, id_ = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    months = F.split(F.lit("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec"), " ")
    listed = F.concat(F.year(day).cast("string"), F.lit(" "), F.get(months, F.month(day) - 1), F.lit("  "), F.dayofmonth(day).cast("string"), F.when(id_ % 2 == 0, " 1230").otherwise(""))
    text = F.when(id_ % 5 == 0, F.date_format(day, "yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    epoch = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.lpad((id_ % 24).cast("string"), 2, "0"), F.lit(":00:14.356416"))
    rows = _table(spark, d, "orders").select(id_.alias("id"), listed.alias("a"), text.alias("b"), F.concat(F.date_format(day, "yyyy"), F.lit("-001A")).alias("c"), epoch.alias("e"))
    return rows.select("id", classify.catalogue_date(F.col("a")).alias("listed"), classify.launch_ms(F.col("b")).alias("launch_ms"), classify.cospar_year(F.col("c")).alias("year"), classify.epoch_ms(F.col("e")).alias("epoch_ms"))


@query(
    "orbit_columns",
    "select id, round((a * (1 - eccentricity) - 6378.135e0)::float::double, 1) as perigee, round((a * (1 + eccentricity) - 6378.135e0)::float::double, 1) as apogee, round((1440 / mean_motion)::float::double, 3) as period, round(sqrt(398600.8e0 * (2 / (a * (1 - eccentricity)) - 1 / a)), 6) as speed "
    "from (select id, mean_motion, eccentricity, cbrt(398600.8e0 / ((mean_motion * 2e0 * pi() / 86400e0) * (mean_motion * 2e0 * pi() / 86400e0))) as a from cat)",
)
def orbit_columns(spark: SparkSession, d: str) -> DataFrame:
    """Perigee, apogee and period, and the speed at perigee."""
    rows = orbits(spark, d)
    a = orbit.semi_major_axis(F.col("mean_motion"))
    found = orbit.orbit_columns(F.col("mean_motion"), F.col("eccentricity"))
    return rows.select(
        "id", *[F.round(found[c].cast("double"), k).alias(n) for c, n, k in (("perigee_km", "perigee", 1), ("apogee_km", "apogee", 1), ("period_min", "period", 3))],
        F.round(orbit.orbital_speed(a * (1 - F.col("eccentricity")), a), 6).alias("speed"),
    )


_LOG = "log10(150e0)", "(log10(45000e0) - log10(150e0))"


@query(
    "altitude_scale",
    f"select id, round(u, 9) as unit, round(pow(10e0, {_LOG[0]} + u * {_LOG[1]}), 4) as back, round(pow(10e0, {_LOG[0]} + b / 72e0 * {_LOG[1]}), 4) as low, least(0.35, 2.2 / sqrt(b + 1))::double as opacity, case when b + 60 > 90 then 96 else 160 end as samples, "
    "(case when n = 0 then 1.0 when n < 120 then 1.8 when n < 1500 then 1.3 else 1.0 end)::double as scale, round(case when n <= 0 then 0.0 else greatest(1.5, log10(1 + n) / log10(2001) * 36) end::double, 9) as height "
    f"from (select id, {_BIN} as b, id % 2000 as n, (log10(greatest(150e0, least(45000e0, mean_alt_km::double))) - {_LOG[0]}) / {_LOG[1]} as u from cat)",
)
def altitude_scale(spark: SparkSession, d: str) -> DataFrame:
    """The logarithmic scale forwards and backwards, and the sizes that follow from counts."""
    b, n, u = F.col("b"), F.col("n"), F.col("u")
    alt = F.col("mean_alt_km").cast("double")
    rows = orbits(spark, d).select("id", orbit.altitude_bin(alt).alias("b"), (F.col("id") % 2000).alias("n"), orbit.altitude_unit(alt).alias("u"))
    return rows.select(
        "id", F.round(u, 9).alias("unit"), F.round(orbit.unit_altitude(u), 4).alias("back"), F.round(orbit.bin_altitude(b), 4).alias("low"), orbit.ring_opacity(b + 1).alias("opacity"), orbit.ring_samples(b + 60).alias("samples"),
        orbit.focus_scale(n).alias("scale"), F.round(orbit.bar_height(n, F.lit(2000), F.lit(40)), 9).alias("height"),
    )


@query(
    "brush_bands",
    f"select id, floor(pow(10e0, {_LOG[0]} + lo * {_LOG[1]}))::int as low, ceil(pow(10e0, {_LOG[0]} + hi * {_LOG[1]}))::int as high from ("
    "select id, case when near then least(71, floor(a * 72)) / 72e0 else a end as lo, case when near then (least(71, floor(a * 72)) + 1) / 72e0 else b end as hi from ("
    "select *, (b - a) * 72 < 1 as near from (select id, least(i, j) as a, greatest(i, j) as b from (select id, (id % 1009 + 0.5e0) / 1009 as i, (id % 997 + 0.5e0) / 997 as j from cat))))",
)
def brush_bands(spark: SparkSession, d: str) -> DataFrame:
    """The altitude band of a drag between two places of the histogram, for each satellite; near ones are within a bin."""
    low, high = orbit.brush_columns((F.col("id") % 1009 + 0.5) / 1009, (F.col("id") % 997 + 0.5) / 997)
    return orbits(spark, d).select("id", low.alias("low"), high.alias("high"))


@query(
    "catalogue_facts",
    f"select (select max(launch_ms) from cat where launch_ms <= 900000000000 + 21600000) as newest_ms, (select count(*) from cat where operator = 'BUILDING') as of_operator, (select count(*) from cat where bloc in ('US', 'CN')) as focused, "
    f"(select greatest(1, max(n)) from (select count(*) as n from (select {_BIN} as b, regime from cat) where regime in ('LEO', 'MEO') group by regime, b)) as most",
)
def catalogue_facts(spark: SparkSession, d: str) -> DataFrame:
    """Newest epoch that isn't far ahead, size of a value, rows in focus, largest bin of two histograms."""
    cat = catalog(spark, d)
    newest = sources.newest_epoch(cat.select(F.col("launch_ms").alias("epoch_ms")), 900_000_000_000)
    focused = compare.focused_count(cat.select(compare.style_code(NOW_MS, Lens(blocs=("US",)), Lens(blocs=("CN",))).alias("style")))
    most = stats.histogram_max(stats.histogram(cat.filter("regime = 'LEO'")), stats.histogram(cat.filter("regime = 'MEO'")))
    one = newest.crossJoin(F.broadcast(stats.key_count(cat, "operator", "BUILDING").withColumnRenamed("n", "of_operator")))  # rows of one
    return one.crossJoin(F.broadcast(focused.withColumnRenamed("n", "focused"))).crossJoin(F.broadcast(most))


@query("failed_propagations", "select count(*) filter (where id % 1000 = 0) as failed, count(*) as total from cat")
def failed_propagations(spark: SparkSession, d: str) -> DataFrame:
    """Element sets whose eccentricity no orbit has fail; all others give a position."""
    rows = _orbits(spark, d).withColumn("eccentricity", F.when(F.col("id") % 1000 == 0, 1.5).otherwise(F.col("eccentricity") * 0.01))
    found = motion.positions(rows, float(NOW_MS))
    return found.agg(F.count_if(F.col("x").isNull()).alias("failed"), F.count("*").alias("total"))


@query(
    "sun_direction",
    "select event_id, round(cos(l), 9) as x, round(sin(t) * sin(l), 9) as y, round(-cos(t) * sin(l), 9) as z from ("
    "select event_id, radians(m) + radians(1.915e0 * sin(radians(g)) + 0.02e0 * sin(2 * radians(g))) as l, radians(23.439e0 - 0.0000004e0 * n) as t from ("
    "select event_id, n, (280.46e0 + 0.9856474e0 * n) % 360 as m, (357.528e0 + 0.9856003e0 * n) % 360 as g from (select event_id, (epoch_us(ts) // 1000) / 86400000e0 + 2440587.5e0 - 2451545e0 as n from events)))",
)
def sun_direction(spark: SparkSession, d: str) -> DataFrame:
    events = _table(spark, d, "events")
    found = frames.sun_direction(F.unix_millis(F.col("ts").cast("timestamp")).cast("double"))
    return events.select("event_id", *[F.round(c, 9).alias(n) for c, n in zip(found, "xyz")])


@query("scene_points", "select id, a / 6371e0 as x, b / 6371e0 as y, -c / 6371e0 as z, a / r as nx, b / r as ny, c / r as nz from (select *, sqrt(a * a + b * b + c * c) as r from (select id, mean_alt_km::double + 7000 as a, inclination * 10 + 1 as b, id % 977 - 400e0 as c from cat))")
def scene_points(spark: SparkSession, d: str) -> DataFrame:
    """Inertial kilometres in scene axes, and the point below on the unit sphere."""
    rows = orbits(spark, d).select("id", (F.col("mean_alt_km").cast("double") + 7000).alias("a"), (F.col("inclination") * 10 + 1).alias("b"), (F.col("id") % 977 - 400.0).alias("c"))
    scene = frames.eci_to_scene(F.col("a"), F.col("c"), F.col("b"))
    return rows.select("id", *[c.alias(n) for c, n in zip(scene, "xyz")], *[c.alias(n) for c, n in zip(frames.nadir(F.col("a"), F.col("b"), F.col("c")), ("nx", "ny", "nz"))])


_COUNTRY = "(case country " + " ".join(f"when '{c}' then '{n}'" for c, n, _ in vocab.COUNTRIES) + " else country end)"
_MISSION = "(case mission " + " ".join(f"when '{i}' then '{short}'" for i, _, short in vocab.MISSIONS) + " end)"
_PRESET_OF = "case mission when 'nav' then 'gnss' when 'human' then 'stations' when 'eo' then 'eo' when 'military' then 'military' end"


@query(
    "lens_labels",
    "select count(*) as n, country || ' ' || regime as key, " + _COUNTRY + " || ' · ' || regime as label, false as is_empty, null::varchar as preset from cat group by country, regime "
    "union all select count(*), regime, regime, false, case regime when 'GEO' then 'geo' end from cat group by regime "
    f"union all select count(*), mission, {_MISSION}, false, {_PRESET_OF} from cat group by mission union all select count(*), '', 'All active satellites', true, null from cat",
)
def lens_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels, emptiness and presets of the lenses that the catalogue's own values make: a country in a regime, a regime, a mission,
    nothing. A set of values is a lens: as many as the vocabularies have."""
    cat = catalog(spark, d)
    sets = cat.groupingSets([["country", "regime"], ["regime"], ["mission"], []], "country", "regime", "mission").agg(F.count("*").alias("n")).collect()
    rows = []
    for r in sets:
        # Order and repeats in a list don't matter, nor does a field that is set and taken out again.
        lens = Lens(countries=(r["country"],) * 2 if r["country"] else None, missions=(r["mission"],) if r["mission"] else (), sectors=("civil",)).refined(regimes=(r["regime"],) if r["regime"] else None, sectors=None)
        preset = preset_for_lens(lens)
        rows.append((r["n"], " ".join(x for x in (r["country"], r["regime"], r["mission"]) if x), lens.label(), lens.is_empty(), preset.id if preset else None))
    return spark.createDataFrame(rows, "n long, key string, label string, is_empty boolean, preset string")


_URL = "'?cc=' || lower(country) || '&mission=nope,' || mission || '&regime=' || lower(regime) || '&alt=' || (id % 900 + 100) || '-' || (id % 700 + 300) || '&only=1&sat=' || (id % 50 - 3) || '&follow=1&color=' || case when id % 2 = 0 then 'owner' else 'mission' end || '&warp=' || (id % 5000) || '&junk=1'"


@query(
    "url_states",
    f"select id, {_URL} as url, '?cc=' || country || '&mission=' || mission || '&regime=' || regime || case when id % 700 + 300 > id % 900 + 100 then '&alt=' || (id % 900 + 100) || '-' || (id % 700 + 300) else '' end || '&only=1' "
    "|| case when id % 50 - 3 > 0 then '&sat=' || (id % 50 - 3) || '&follow=1' else '' end || case when id % 2 = 0 then '&color=owner' else '' end || case when id % 5000 between 2 and 3600 then '&warp=' || (id % 5000) else '' end as written from cat",
)
def url_states(spark: SparkSession, d: str) -> DataFrame:
    """Each satellite's view as a URL with faults, and what the view that is read from it is written as."""
    url = catalog(spark, d).select("id", F.expr(_URL).alias("url"))
    written = F.pandas_udf(lambda urls: urls.map(lambda u: viewstate.serialize(viewstate.parse(u))), "string")
    return url.select("id", "url", written("url").alias("written"))


_SUGGESTED = [(i, k, v, json.dumps(search.result_lens(k, v).to_json())) for i, (k, v) in enumerate(search.suggestions())]


@query("search_start", " union all ".join(f"select {i} as place, '{k}' as kind, '{v}' as key, '{f}' as lens, count(*) as n from cat where {_PRESET_SQL[v] if k == 'preset' else f'id = {v}'}" for i, k, v, f in _SUGGESTED))
def search_start(spark: SparkSession, d: str) -> DataFrame:
    """What an empty search suggests, the lens that each suggestion applies, and how many satellites that lens has."""
    counted = catalog(spark, d).agg(*[F.count_if(search.result_lens(k, v).to_column(NOW_MS)).alias(f"n{i}") for i, k, v, _ in _SUGGESTED])
    each = [F.struct(F.lit(i).alias("place"), F.lit(k).alias("kind"), F.lit(v).alias("key"), F.lit(f).alias("lens"), F.col(f"n{i}").alias("n")) for i, k, v, f in _SUGGESTED]
    return counted.select(F.inline(F.array(*each)))


_STAR = _NAMED.replace("COSMOS 2", "STAR")
_MERGED = "select row_number() over (order by score desc, source, a, b) as rank, kind, key, count, score from (select kind, key, count, score::double as score, 0 as source, kk as a, pos as b from g union all select 'satellite', id::varchar, null, score, 1, length(name), id from w) order by score desc, source, a, b limit 12"
query("search_merged", _MERGED, f"{_ENTRIES}, {_STAR}")(lambda spark, d: search.search(catalog(spark, d), "star").drop("title"))


@query("search_merged_stored", _MERGED, f"{_ENTRIES}, {_STAR}")
def search_merged_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same by an index that is built first: the search itself reads the index alone."""
    return search_index.build(catalog(spark, d), scratch(spark)).search("star").drop("title")


#: Beginnings short and long, parts rare and common, a number, a nickname, a whole name, nothing.
_SEARCHES = ["STAR", "COSMOS 2", "B", "AT-1", "GPS BIIR-3", "7", "HUBBLE", "NEXTSAT-10", "ZZZ", "SAT"]


@query(
    "search_stored",
    "select q, id, name, score, place from (select q, id, name, score, row_number() over (partition by q order by score desc, length(name), id) as place from "
    "(select q, id, name, case when q = 'HUBBLE' and id = 20580 then 3.2 when id = try_cast(q as bigint) then 3.0 when name = q then 2.2 when starts_with(name, q) then 1.6 - least(0.5, length(name) / 200e0) "
    "when length(q) >= 3 and contains(name, q) then 1.0 else 0.0 end::double as score from cat, "
    f"(values {', '.join(f"('{x}')" for x in _SEARCHES)}) as s(q)) where score > 0) where place <= 8",
)
def search_stored(spark: SparkSession, d: str) -> DataFrame:
    """Several searches for satellites in one stored index."""
    index = search_index.build(catalog(spark, d), scratch(spark))
    rows = [(q, r["id"], r["name"], r["score"], place) for q in _SEARCHES for place, r in enumerate(index.satellites(q.lower()).collect(), 1)]  # at most 8 of each
    return spark.createDataFrame(rows, "q string, id long, name string, score double, place int")


_NAV = "mission = 'nav'"


def _part(x: str, whole: str = "n") -> str:
    return f"floor(100 * {x} / {whole}::double + 0.5)::int"


_KM = "(case when m < 1000 then floor(m / 10 + 0.5) * 10 when m < 10000 then floor(m / 100 + 0.5) * 100 else floor(m / 500 + 0.5) * 500 end)::bigint"
query(
    "lens_insights",
    f"select * from (select 1 as ord, 'share' as id, case when {_part('n', '\"all\"')} = 0 then '<1%' else {_part('n', '\"all\"')} || '%' end as value, 'of all ' || format('{{:,}}', \"all\") || ' active satellites' as label, null as lens from x where n > 0 "
    f"union all select 2, 'median-alt', format('{{:,}}', {_KM}) || ' km', 'median altitude', null from x, md where n >= 3 "
    "union all select 3, 'shells', string_agg(inc || '°', ' · ' order by rank), 'main orbital inclinations (' || string_agg(format('{:,}', count), ' · ' order by rank) || ')', null from x, m where rank > 0 and count / n::double >= 0.04 and n >= 20 having count(*) > 0 "
    f"union all select 4, 'growth', '+' || format('{{:,}}', y), 'launched in the last 12 months (' || {_part('y')} || '%)', '{{\"missions\": [\"nav\"], \"launchedWithinDays\": 365}}' from x where y > 0 "
    f"union all select 5, 'top-operator', {_part('c')} || '%', 'operated by ' || k, '{{\"missions\": [\"nav\"], \"operators\": [\"' || k || '\"]}}' from x, op where n >= 5 "
    f"union all select 6, 'top-country', {_part('c')} || '%', 'registered to ' || (case k " + " ".join(f"when '{c}' then '{n}'" for c, n, _ in vocab.COUNTRIES) + f" else k end), '{{\"missions\": [\"nav\"], \"countries\": [\"' || k || '\"]}}' from x, co where n >= 5 and {_part('c')} < 100)",
    f"x as (select (select count(*) from cat) as \"all\", count(*) as n, count(*) filter (where launch_ms >= {NOW_MS} - 365 * 86400000::bigint) as y from cat where {_NAV}), "
    f"md as (select max(a) as m from (select mean_alt_km::double as a, row_number() over (order by mean_alt_km) - 1 as k, count(*) over () as n from cat where {_NAV}) where k = n // 2), "
    f"op as (select operator as k, count(*) as c from cat where {_NAV} group by 1 order by c desc, min(id) limit 1), co as (select country as k, count(*) as c from cat where {_NAV} group by 1 order by c desc, min(id) limit 1), "
    f"h as (select least(180, greatest(0, floor(inclination + 0.5)))::int as d, count(*) as c from cat where {_NAV} group by 1), l as (select list({{'d': d, 'c': c}} order by c desc, d) as free from h), "
    "m(rank, inc, count, free) as (select 0, null::int, null::bigint, free from l union all select rank + 1, free[1].d, list_sum(list_transform(list_filter(free, lambda x: abs(x.d - free[1].d) <= 1), lambda x: x.c))::bigint, list_filter(free, lambda x: abs(x.d - free[1].d) > 1) from m where rank < 3 and len(free) > 0)",
)(lambda spark, d: insights.lens_insights(catalog(spark, d), Lens(missions=("nav",)), NOW_MS))


@query(
    "shell_notes",
    f"select n.id, n.neighbours, case when n.neighbours >= (select max(c) from b) then 'most crowded' when p >= 0.6 then 'busier than ' || ({_PCT.format('p', '1')}) else 'quiet' end as note from (select *, (select count(*) filter (where b.c < n.neighbours) / count(*)::double from b) as p from n) n",
    "b as (select floor(mean_alt_km::double / 50) as x, count(*) as c from cat group by 1), n as (select p.id, count(*) as neighbours from cat p join cat o on abs(o.mean_alt_km::double - p.mean_alt_km::double) <= 25 where p.regime = 'GEO' or p.country = 'FR' group by p.id)",
)
def shell_notes(spark: SparkSession, d: str) -> DataFrame:
    """How crowded the altitude of each geostationary or French satellite is, in the words of its card."""
    cat = catalog(spark, d)
    found = stats.shell_percentile(cat, cat.filter("regime = 'GEO' or country = 'FR'"))
    return found.select("id", "neighbours", card.shell_note(F.col("busiest"), F.col("percentile")).alias("note"))


def _csv(rows: DataFrame, name: str) -> str:
    path = f"{scratch(rows.sparkSession)}/{name}"
    rows.write.option("quote", '"').option("escape", '"').option("header", True).csv(path)
    return path


def _tsv(rows: DataFrame, name: str) -> str:
    """A folder with a header line, a comment, and a line per row."""
    path, spark = f"{scratch(rows.sparkSession)}/{name}", rows.sparkSession
    head = spark.createDataFrame([("#" + "\t".join(rows.columns),), ("# Updated 2001 Aug  1",)], "value string").coalesce(1)
    head.unionByName(rows.select(F.concat_ws("\t", *rows.columns).alias("value"))).write.text(path)
    return path


def _elements_file(spark: SparkSession, d: str) -> str:
    """The generated elements as a CSV file: names with commas, numbers that begin with a dot, rows without a number."""
    id_ = F.col("id")
    cells = {
        "OBJECT_NAME": F.when(id_ % 7 == 0, F.concat("name", F.lit(', "B"'))).otherwise(F.col("name")), "OBJECT_ID": F.lit("1998-067A"), "EPOCH": F.concat(F.lit("2001-07-31T"), F.lpad((id_ % 24).cast("string"), 2, "0"), F.lit(":16:14.356416")),
        "MEAN_MOTION": F.col("mean_motion").cast("string"), "ECCENTRICITY": F.when(id_ % 3 == 0, ".0006824").otherwise("0.01"), "INCLINATION": F.col("inclination").cast("string"), "RA_OF_ASC_NODE": (id_ % 360).cast("string"), "ARG_OF_PERICENTER": F.lit("10.5"),
        "MEAN_ANOMALY": F.lit(""), "EPHEMERIS_TYPE": F.lit("0"), "CLASSIFICATION_TYPE": F.lit("U"), "NORAD_CAT_ID": F.when(id_ % 50 == 0, "x").otherwise(id_.cast("string")), "ELEMENT_SET_NO": F.when(id_ % 2 == 0, "7").otherwise(""), "REV_AT_EPOCH": F.lit(""),
        "BSTAR": F.lit(".85983E-4"), "MEAN_MOTION_DOT": F.lit("0"), "MEAN_MOTION_DDOT": F.lit("0"),
    }
    return _csv(elements(spark, d).select(*[c.alias(n) for n, c in cells.items()]), "gp.csv")


def _registry_file(spark: SparkSession, d: str) -> str:
    rows = elements(spark, d).filter("id % 2 = 0")
    return _csv(rows.select(F.col("name").alias("OBJECT_NAME"), F.lit("1998-067A").alias("OBJECT_ID"), F.col("id").cast("string").alias("NORAD_CAT_ID"), F.lit("PAY").alias("OBJECT_TYPE"), F.lit("PRC").alias("OWNER"), F.lit("1998-07-09").alias("LAUNCH_DATE")), "satcat.csv")


def _general(spark: SparkSession, d: str) -> DataFrame:
    """The general catalogue of every third element set, read from its three files."""
    rows = elements(spark, d).filter("id % 3 = 0").select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("JCAT"), "id")
    satcat = rows.select("JCAT", F.col("id").cast("string").alias("Satcat"), F.when(F.col("id") % 2 == 0, "AAA/X?").otherwise("BBB").alias("Owner"), F.lit("J").alias("State"), F.lit("1999 Jan  5").alias("LDate"), F.lit("12.5").alias("Mass"))
    payloads = rows.select("JCAT", F.lit("IMG").alias("Category"), F.lit("D").alias("Class"))
    orgs = spark.createDataFrame([("AAA", "Org A", "-", "", "a"), ("BBB", "-", "Org B", "", "b")], "Code string, ShortEName string, EName string, ShortName string, Name string")
    read = lambda df, name: files.read_tsv(spark, _tsv(df, name))[0]
    return sources.general_registry(read(satcat, "satcat.tsv"), read(payloads, "psatcat.tsv"), read(orgs, "orgs.tsv"))


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    read = files.read_elements(spark, _elements_file(spark, d))
    return sources.enrich(read, files.optional_registry(spark, _registry_file(spark, d)), _general(spark, d))


_READ = "e as (select id, name || (case when id % 7 = 0 then ', \"B\"' else '' end) as name, mean_motion, inclination, epoch_ms(timestamp '2001-07-31 00:16:14.356') + (id % 24) * 3600000 as epoch_ms, case when id % 3 = 0 then 0.0006824e0 else 0.01e0 end as ecc from el where id % 50 <> 0)"
_META = (
    f"{_READ}, r as (select *, {_case(1, 'null')} as rc, {_case(2, 'null')} as ro, {_case(3, 'null')} as rm, {_case(4, 'null')} as rcc, {_case(5, 'null')} as rs from e), "
    "m as (select id, name, coalesce(case when rc is not null then ro end, case when id % 6 = 0 then 'Org A' when id % 3 = 0 then 'Org B' end, ro, 'Unknown operator') as operator, "
    "case when id % 3 = 0 then 'JP' when id % 2 = 0 then 'CN' else coalesce(rcc, 'XX') end as country, rc as constellation, "
    "coalesce(case when rc is not null or rm = 'human' then rm end, case when id % 3 = 0 then 'military' end, rm, 'tech') as mission, case when id % 3 = 0 then 'military' else coalesce(rs, 'unknown') end as sector, "
    "case when id % 2 = 0 then '1998-07-09' when id % 3 = 0 then '1999-01-05' else '' end as launch_date, case when id % 3 = 0 then 12.5e0 end as mass from r)"
)


@query("read_elements", "select id, name, '1998-067A' as cospar, epoch_ms, mean_motion, ecc as eccentricity, inclination, (id % 360)::double as raan, 0e0 as mean_anomaly, 0.000085983e0 as bstar, case when id % 2 = 0 then 7 else 999 end as element_set_no, 0 as rev_at_epoch from e", _READ)
def read_elements(spark: SparkSession, d: str) -> DataFrame:
    """Element sets written as CSV and read again."""
    return files.read_elements(spark, _elements_file(spark, d), 10).select("id", "name", "cospar", "epoch_ms", "mean_motion", "eccentricity", "inclination", "raan", "mean_anomaly", "bstar", "element_set_no", "rev_at_epoch")


@query("read_registry", "select id, 'PRC' as owner, '1998-07-09' as registered, 'PAY' as object_type from el where id % 2 = 0")
def read_registry(spark: SparkSession, d: str) -> DataFrame:
    return files.read_registry(spark, _registry_file(spark, d))


@query("registry_last_wins", "select id, ['PRC', 'CIS', 'US'][(id % 3 + 1)::int] as owner, '1998-07-0' || (id % 3) as registered, 'PAY' as object_type from el")
def registry_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """A registry that names an id up to three times, in files that later versions of a row stand further down in: the last one wins."""
    rows = elements(spark, d).select("id", F.explode(F.sequence(F.lit(0), (F.col("id") % 3).cast("int"))).alias("v"))
    cells = {"OBJECT_NAME": F.repeat(F.lit("x"), 9 - 4 * F.col("v")), "NORAD_CAT_ID": F.col("id").cast("string"), "OBJECT_TYPE": F.lit("PAY"), "OWNER": _nth(["PRC", "CIS", "US"], F.col("v")), "LAUNCH_DATE": F.concat(F.lit("1998-07-0"), F.col("v").cast("string"))}
    ordered = rows.repartitionByRange(16, "v", "id").sortWithinPartitions("v", "id")
    return files.read_registry(spark, _csv(ordered.select(*[c.alias(n) for n, c in cells.items()]), "satcat.csv"))


@query("general_registry", "select id, case when id % 2 = 0 then 'Org A' else 'Org B' end as g_owner_name, 'J' as g_state, '1999-01-05' as g_date, 12.5e0 as g_mass, 'IMG' as g_category, 'D' as g_class from el where id % 3 = 0 and id > 0")
def general_registry(spark: SparkSession, d: str) -> DataFrame:
    """Three TSV files joined: owners by their whole code, or the part before a slash; placeholders are no names."""
    return _general(spark, d).withColumn("g_mass", F.col("g_mass").cast("double"))


@query("enrich", "select * from m", _META)
def enrich(spark: SparkSession, d: str) -> DataFrame:
    """Precedence of rules, general catalogue and registry."""
    return _enriched(spark, d).select("id", "name", "operator", "country", "constellation", "mission", "sector", "launch_date", F.col("mass_kg").cast("double").alias("mass"))


@query("coverage", "select count(*) as rows, count(*) filter (where id % 3 = 0) as general_hits, count(*) filter (where country = 'XX') as unknown_country, count(distinct operator) as operators, count(distinct country) as countries, count(distinct constellation) as constellations from m", _META)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = _enriched(spark, d)
    return sources.coverage(rows, _general(spark, d), rows)


@query(
    "resolve",
    "select id, case when id % 5 = 0 then 'Known' else coalesce(ro, 'Unknown operator') end as operator, case when id % 5 = 0 then 'LU' when id % 2 = 0 then 'CN' else coalesce(rcc, 'XX') end as country, case when id % 5 = 0 then null else rc end as constellation, "
    "case when id % 5 = 0 then 'eo' else coalesce(rm, 'tech') end as mission, case when id % 5 = 0 then 'civil' else coalesce(rs, 'unknown') end as sector, case when id % 5 = 0 then '1990' when id % 2 = 0 then '1998-07-09' else '1998' end as launch_date from r",
    _META,
)
def resolve(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of a snapshot where it has the id, else inferred."""
    read = files.read_elements(spark, _elements_file(spark, d))
    known = elements(spark, d).filter("id % 5 = 0").select(F.col("id").cast("int").alias("id"), F.lit("Known").alias("operator"), F.lit("LU").alias("country"), F.lit(None).cast("string").alias("constellation"), F.lit("eo").alias("mission"), F.lit("civil").alias("sector"), F.lit("1990").alias("launch_date"), F.lit(1.0).cast("float").alias("mass_kg"))
    return sources.resolve(read, known, files.read_registry(spark, _registry_file(spark, d))).select("id", "operator", "country", "constellation", "mission", "sector", "launch_date")


_ROUNDTRIP = "select m.*, e.epoch_ms, e.mean_motion, e.ecc as eccentricity from (select id, name, operator, country, constellation, mission, sector, launch_date, floor(mass + 0.5) as mass from m) m join e on e.id = m.id"
_TRIP = ["id", "name", "operator", "country", "constellation", "mission", "sector", "launch_date", "cast(mass_kg as double) as mass", "epoch_ms", "mean_motion", "eccentricity"]


@query("payload_roundtrip", _ROUNDTRIP, _META)
def payload_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """An enriched catalogue as one columnar document, and as rows again."""
    folder = scratch(spark)
    _enriched(spark, d).write.parquet(f"{folder}/catalogue")
    path = document.write_document(spark.read.parquet(f"{folder}/catalogue"), f"{folder}/payload", {"mode": "live"}, "2001-08-01T00:00:00Z", compression="gzip")
    return document.read_document(spark, path).selectExpr(*_TRIP)


@query("payload_chunks", _ROUNDTRIP, _META)
def payload_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The same catalogue in parts of up to 5,000 rows, and as rows again."""
    folder = scratch(spark)
    _enriched(spark, d).write.parquet(f"{folder}/catalogue")
    chunks.write_chunks(spark.read.parquet(f"{folder}/catalogue"), f"{folder}/payload", {"mode": "live"}, "2001-08-01T00:00:00Z", 5000)
    return chunks.read_chunks(spark, f"{folder}/payload").selectExpr(*_TRIP)


@query("payload_dictionaries", "select 'operators' as dict, value, (row_number() over (order by first) - 1)::int as code from (select operator as value, min(id) as first from m group by 1) union all select 'countries', value, (row_number() over (order by first) - 1)::int from (select country as value, min(id) as first from m group by 1) union all select 'constellations', value, (row_number() over (order by first) - 1)::int from (select constellation as value, min(id) as first from m where constellation is not null group by 1)", _META)
def payload_dictionaries(spark: SparkSession, d: str) -> DataFrame:
    """Codes of operators, countries and constellations in the order in which they are first seen."""
    folder = scratch(spark)
    _enriched(spark, d).write.parquet(f"{folder}/catalogue")
    return chunks.dictionaries(spark.read.parquet(f"{folder}/catalogue"))


@query("decode", f"select m.id, m.country, m.launch_date, case when launch_date = '' then null else (launch_date::date - date '1970-01-01')::bigint * 86400000 end as launch_ms, upper(m.name) as search_name, case when m.country in ('XX') then 'OT' when m.country = 'HK' then 'CN' when m.country in ('GB', 'EU', 'FR', 'DE') then 'EU' when m.country in ('US', 'CN', 'RU', 'JP', 'IN', 'KR') then m.country else 'OT' end as bloc from m", _META)
def decode(spark: SparkSession, d: str) -> DataFrame:
    return sources.decode(_enriched(spark, d)).select("id", "country", "launch_date", "launch_ms", "search_name", "bloc")


@query("exchange_records", "select id as NORAD_CAT_ID, name as OBJECT_NAME, strftime(make_timestamp(epoch_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') as EPOCH, mean_motion as MEAN_MOTION, ecc as ECCENTRICITY from e", _READ)
def exchange_records(spark: SparkSession, d: str) -> DataFrame:
    return sources.sgp4_record(files.read_elements(spark, _elements_file(spark, d))).select("NORAD_CAT_ID", "OBJECT_NAME", "EPOCH", "MEAN_MOTION", "ECCENTRICITY")


@query("catalogue_by_id", "select id, name from cat where id = 37")
def catalogue_by_id(spark: SparkSession, d: str) -> DataFrame:
    return sources.by_id(catalog(spark, d), 37).select("id", "name")


_CHAIN = ["snapshot", "live", "live", "warm-cache", "live", "error", "snapshot"]


@query("source_chain", "select * from (values " + ", ".join(f"({i}, '{m}')" for i, m in enumerate(_CHAIN)) + ") as t(step, mode)")
def source_chain(spark: SparkSession, d: str) -> DataFrame:
    """Offline; live; live again within its time though the source fails; a copy after that; live; production without a copy; a snapshot."""
    rows, now, up = elements(spark, d).select("id"), [0.0], [True]

    def live() -> DataFrame:
        if not up[0]:
            raise files.SourceError("network", "down")
        return rows

    def store(**how) -> sources.CatalogStore:
        return sources.CatalogStore(spark, live, lambda: rows, f"{scratch(spark)}/copy", clock=lambda: now[0], **how)

    def mode(of: sources.CatalogStore) -> str:
        try:
            return of.get().select("source_mode").first()[0]
        except files.SourceError:
            return "error"

    one, found = store(), [mode(store(offline=True))]
    for at, works in ((0.0, True), (60.0, False), (9000.0, False), (9100.0, True)):
        now[0], up[0] = at, works
        found.append(mode(one))
    up[0] = False
    return spark.createDataFrame(list(enumerate([*found, mode(store(production=True)), mode(store())])), "step int, mode string")


@query(
    "store_failing_write",
    f"select 1 as step, 'live' as mode, null::varchar as note, count(*) as n, sum(id)::bigint as total from cat union all select 2, 'warm-cache', '{sources.NOTES['warm-cache']}', count(*), sum(id)::bigint from cat "
    "union all select 3, 'live', null, count(*), sum(id)::bigint from cat union all select 4, 'live', null, count(*), sum(id + 1)::bigint from cat union all select 5, 'live', null, count(*), sum(id)::bigint from cat",
)
def store_failing_write(spark: SparkSession, d: str) -> DataFrame:
    """A live source that breaks off while it is written: the last good copy is served, a new store finds it, and a frame that was
    handed out before a later refresh can still be read after it."""
    rows, now, path = elements(spark, d).select("id"), [0.0], f"{scratch(spark)}/copy"
    broken = rows.select(F.when(F.col("id") > rows.agg(F.min("id")).first()[0], F.raise_error(F.lit("cut off"))).otherwise(F.col("id")).cast("long").alias("id"))
    source = [rows]

    def get() -> DataFrame:
        return sources.CatalogStore(spark, lambda: source[0], lambda: rows.limit(0), path, production=True, clock=lambda: now[0]).get()

    found = [get()]
    now[0], source[0] = 9000.0, broken
    found.append(get())
    now[0] = 60.0  # within the copy's time
    found.append(get())
    now[0], source[0] = 20_000.0, rows.select((F.col("id") + 1).alias("id"))
    found += [get(), found[0]]
    each = [f.groupBy(F.lit(i).alias("step"), F.col("source_mode").alias("mode"), F.col("source_note").alias("note")).agg(F.count("*").alias("n"), F.sum("id").alias("total")) for i, f in enumerate(found, 1)]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).unionByName(each[4])


@query(
    "refresh_log",
    "select number, count(*)::double as rows, count(*) filter (id % 3 = 0)::double as general_hits, count(*) filter (country = 'XX')::double as unknown_country, (select count(*) from m) as current_rows, "
    "'' as refused from m, (values (1), (2)) as t(number) group by number union all select 3, null, null, null, null, (select count(*) || ' rows after ' || (select count(*) from m) from m where id % 5 = 0)",
    _META,
)
def refresh_log(spark: SparkSession, d: str) -> DataFrame:
    """Two refreshes of the enriched catalogue, and between them one that the gate refuses as a fifth of the rows has come."""
    kept = store.VersionedStore(spark, scratch(spark))
    rows, registry, general = files.read_elements(spark, _elements_file(spark, d), 10), files.optional_registry(spark, _registry_file(spark, d)), _general(spark, d)
    gate, refused = store.coverage_gate(least_rows=10, unknown_share=1.0), ""
    sources.refresh(kept, rows, registry, general, gate)
    try:
        sources.refresh(kept, rows.filter("id % 5 = 0"), registry, general, gate)
    except store.Refused as e:
        refused = str(e)
    sources.refresh(kept, rows, registry, general, gate)
    figure = lambda k: F.col("figures")[k].alias(k)
    current = kept.read().agg(F.count("*").alias("current_rows"))
    log = kept.log().select(F.col("number").cast("int").alias("number"), figure("rows"), figure("general_hits"), figure("unknown_country")).crossJoin(F.broadcast(current)).withColumn("refused", F.lit(""))  # one row
    none = spark.createDataFrame([(3, None, None, None, None, refused)], "number int, rows double, general_hits double, unknown_country double, current_rows long, refused string")
    return log.unionByName(none)


@query("insight_sections")
def insight_sections(spark: SparkSession, d: str) -> DataFrame:
    """What the overview and a lens show of their insights."""
    rows = catalog(spark, d)
    overview = insights.shown(insights.scope_insights(rows, NOW_MS), "overview")
    return overview.unionByName(insights.shown(insights.lens_insights(rows, Lens(missions=("nav",)), NOW_MS), "lens")).select("id", "value", "section", "place")


ORACLES["insight_sections"] = (
    "select id, value, case when pos <= 3 then 'Worth knowing' else 'More facts' end as section, case when pos <= 3 then pos else pos - 3 end as place "
    f"from (select *, row_number() over (order by ord) as pos from ({ORACLES['scope_insights']})) where pos <= 7 "
    f"union all select id, value, 'Key numbers', pos from (select *, row_number() over (order by ord) as pos from ({ORACLES['lens_insights']})) where pos <= 5"
)
