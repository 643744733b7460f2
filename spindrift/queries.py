"""The catalogue's queries over the generated tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.orbit import altitude_bin
from .functions import format as fmt
from .functions import frames
from .operators import bitmaps, card, cells, compare, insights, motion, scopes, search, stats, view
from .plans.fixture import NOW_MS, ORACLE_CATALOG, catalog, orbits
from .plans.lens import PRESETS, Lens
from .session import scratch
from .streaming import ticks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_BIN = "least(71, greatest(0, floor((log10(greatest(mean_alt_km::double, 150)) - log10(150e0)) / (log10(45000e0) - log10(150e0)) * 72)))::int"
#: Lenses by field, with the SQL of the same condition.
LENSES = {
    "constellations": (Lens(constellations=("starlink", "gps")), "constellation in ('starlink', 'gps')"),
    "countries": (Lens(countries=("KR", "JP")), "country in ('KR', 'JP')"),
    "operators": (Lens(operators=("BUILDING",)), "operator = 'BUILDING'"),
    "blocs": (Lens(blocs=("EU", "CN")), "bloc in ('EU', 'CN')"),
    "missions": (Lens(missions=("nav", "human")), "mission in ('nav', 'human')"),
    "regimes": (Lens(regimes=("GEO", "HEO")), "regime in ('GEO', 'HEO')"),
    "sectors": (Lens(sectors=("civil", "unknown")), "sector in ('civil', 'unknown')"),
    "altitude": (Lens(altitude=(500, 1200)), "mean_alt_km::double between 500 and 1200"),
    "recency": (Lens(launched_within_days=365), f"launch_ms >= {NOW_MS} - 365 * 86400000::bigint"),
    "ids": (Lens(ids=(1, 7, 12, 53, 500)), "id in (1, 7, 12, 53, 500)"),
}
FLAGSHIP = Lens(regimes=("LEO",), altitude=(500, 1200), launched_within_days=365)
_FLAGSHIP = " and ".join(("regime = 'LEO'", LENSES["altitude"][1], LENSES["recency"][1]))
_SCOPE = "select * from cat where " + _FLAGSHIP


def query(name: str, sql: str | None = None, cte: str = "") -> Callable[[Query], Query]:
    """Register a query; `sql` selects from `cat` (the catalogue) and the tables of `cte`."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"with recursive {ORACLE_CATALOG}{', ' + cte if cte else ''} {sql}"
        return f

    return add


for _name, (_lens, _where) in LENSES.items():
    query(f"lens_{_name}", f"select id, name from cat where {_where}")(lambda spark, d, lens=_lens: catalog(spark, d).filter(lens.to_column(NOW_MS)).select("id", "name"))


@query("lens_conjunction", f"select id, operator, mean_alt_km::double as alt from cat where {_FLAGSHIP}")
def lens_conjunction(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).filter(FLAGSHIP.to_column(NOW_MS)).select("id", "operator", F.col("mean_alt_km").cast("double").alias("alt"))


@query("lens_mask_count", f"select count(*) filter (where {_FLAGSHIP}) as n, count(*) as total from cat")
def lens_mask_count(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).agg(F.count_if(FLAGSHIP.to_column(NOW_MS)).alias("n"), F.count("*").alias("total"))


@query("top_operators", f"select row_number() over (order by count(*) desc, min(id)) as rank, operator, count(*) as n from cat where {_FLAGSHIP} group by operator qualify rank <= 5")
def top_operators(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the five operators with the most LEO satellites at 500 to 1,200 km launched in the last year."""
    top = stats.top_entries(catalog(spark, d).filter(FLAGSHIP.to_column(NOW_MS)), "operator", 5)
    ordered = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("by"), "first_id", "key", "n"))).alias("rows"))  # five rows
    return ordered.select(F.posexplode("rows").alias("at", "r")).select((F.col("at") + 1).alias("rank"), F.col("r.key").alias("operator"), F.col("r.n").alias("n"))


_DIMS = ["mission", "bloc", "regime", "sector", "constellation", "operator", "country"]


@query(
    "stats_grouping_sets",
    " union all ".join(f"select '{c}' as dimension, {c} as key, count(*) as n, min(id) as first_id from s where {c} is not null group by {c}" for c in _DIMS)
    + " union all select 'alt_bin', alt_bin::varchar, count(*), min(id) from s group by alt_bin union all select 'total', null, count(*), min(id) from s",
    f"s as (select *, {_BIN} as alt_bin from cat where regime = 'LEO')",
)
def stats_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return stats.dimension_counts(catalog(spark, d).filter(Lens(regimes=("LEO",)).to_column(NOW_MS)))


@query("stats_dense_bins", "select b.b as alt_bin, count(h.alt_bin) as n from b left join h on h.alt_bin = b.b group by b.b", f"b as (select unnest(range(72))::int as b), h as (select {_BIN} as alt_bin from cat)")
def stats_dense_bins(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(catalog(spark, d))


@query("stats_dense_vocab", "select v.regime as key, v.ord, count(cat.id) as n from v left join cat on cat.regime = v.regime and cat.country = 'KR' group by all", "v as (select * from (values ('LEO', 0), ('MEO', 1), ('GEO', 2), ('HEO', 3)) as t(regime, ord))")
def stats_dense_vocab(spark: SparkSession, d: str) -> DataFrame:
    scope = catalog(spark, d).filter(Lens(countries=("KR",)).to_column(NOW_MS))
    return stats.dense_counts(stats.dimension_counts(scope)).filter("dimension = 'regime'").select("key", "ord", "n")


@query("stats_recency", f"select count(*) as total, count(*) filter (where launch_ms >= {NOW_MS} - 365 * 86400000::bigint) as last_365, count(*) filter (where launch_ms >= {NOW_MS} - 30 * 86400000::bigint) as last_30 from cat")
def stats_recency(spark: SparkSession, d: str) -> DataFrame:
    return stats.recency(catalog(spark, d), NOW_MS)


@query("stats_upper_median", "select max(a) as median_alt_km from r where k = n // 2", f"r as (select mean_alt_km::double as a, row_number() over (order by mean_alt_km) - 1 as k, count(*) over () as n from ({_SCOPE}))")
def stats_upper_median(spark: SparkSession, d: str) -> DataFrame:
    return stats.upper_median(catalog(spark, d).filter(FLAGSHIP.to_column(NOW_MS)))


@query("frame_distance", "select greatest(3.8, least(30.0, a * 2.05))::double as distance from r where k = floor(n * 0.9)", f"r as (select 1 + apogee_km::double / 6371 as a, row_number() over (order by apogee_km) - 1 as k, count(*) over () as n from ({_SCOPE}))")
def frame_distance(spark: SparkSession, d: str) -> DataFrame:
    return stats.framing_distance(catalog(spark, d).filter(FLAGSHIP.to_column(NOW_MS)))


_PRESET_SQL = {
    "starlink": "constellation = 'starlink'", "gnss": "mission = 'nav'", "stations": "mission = 'human'", "eo": "mission = 'eo'", "military": "mission = 'military'",
    "korea": "country = 'KR'", "china": "bloc = 'CN'", "europe": "bloc = 'EU'", "geo": "regime = 'GEO'", "kuiper": "constellation = 'kuiper'",
    "chinese-megaconstellations": "constellation in ('qianfan', 'guowang')", "new": LENSES["recency"][1],
}


_PRESET_COUNTS = " union all ".join(f"select '{p.id}' as preset, count(*) as n from cat where {_PRESET_SQL[p.id]}" for p in PRESETS)


@query("preset_counts", _PRESET_COUNTS)
def preset_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.preset_counts(catalog(spark, d), NOW_MS)


@query("preset_counts_bitmap", _PRESET_COUNTS)
def preset_counts_bitmap(spark: SparkSession, d: str) -> DataFrame:
    """The same from a bitmap index: the catalogue is read once, to build it."""
    index = bitmaps.build(catalog(spark, d), scratch(spark))
    return index.counts({p.id: (p.lens,) for p in PRESETS}, NOW_MS).withColumnRenamed("name", "preset")


@query("shell_neighbours", "select a.id, sum(v.c)::bigint as neighbours from cat a join v on abs(v.alt - a.mean_alt_km::double) <= 25 group by a.id", "v as (select mean_alt_km::double as alt, count(*) as c from cat group by 1)")
def shell_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return stats.shell_neighbours(orbits(spark, d))


@query(
    "shell_percentile",
    "select n.id, n.neighbours, (select count(*) filter (where b.c < n.neighbours) / count(*)::double from b) as percentile, n.neighbours >= (select max(c) from b) as busiest from n",
    "b as (select floor(mean_alt_km::double / 50) as x, count(*) as c from cat group by 1), n as (select p.id, count(*) as neighbours from cat p join cat o on abs(o.mean_alt_km::double - p.mean_alt_km::double) <= 25 group by p.id)",
)
def shell_percentile(spark: SparkSession, d: str) -> DataFrame:
    return stats.shell_percentile(orbits(spark, d))


_MODES = (
    "h as (select least(180, greatest(0, floor(inclination + 0.5)))::int as d, count(*) as c from cat where regime = 'LEO' group by 1), "
    "l as (select list({'d': d, 'c': c} order by c desc, d) as free from h), "
    "m(rank, inc, count, free) as (select 0, null::int, null::bigint, free from l union all "
    "select rank + 1, free[1].d, list_sum(list_transform(list_filter(free, lambda x: abs(x.d - free[1].d) <= 1), lambda x: x.c))::bigint, list_filter(free, lambda x: abs(x.d - free[1].d) > 1) from m where rank < 3 and len(free) > 0)"
)


@query("inclination_modes", "select rank, inc, count from m where rank > 0", _MODES)
def inclination_modes(spark: SparkSession, d: str) -> DataFrame:
    return stats.inclination_modes(catalog(spark, d).filter("regime = 'LEO'"))


@query(
    "densest_band",
    "select 150 * pow(300, b / 72e0) as lo, 150 * pow(300, (b + 2) / 72e0) as hi, p as count from (select b, n + lead(n) over (order by b) as p from h) where p > 0 order by p desc, b limit 1",
    f"b as (select unnest(range(72)) as b), h as (select b.b, count(c.x) as n from b left join (select {_BIN} as x from cat) c on c.x = b.b group by 1)",
)
def densest_band(spark: SparkSession, d: str) -> DataFrame:
    return stats.densest_band(catalog(spark, d))


@query("share_rows", "select key, n, greatest(0, count(*) over () - 4) as rest from (select operator as key, count(*) as n, min(id) as i from cat where country = 'FR' group by 1) order by n desc, i limit 4")
def share_rows(spark: SparkSession, d: str) -> DataFrame:
    counts = catalog(spark, d).filter("country = 'FR'").groupBy(F.col("operator").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("ord"))
    return stats.share_rows(counts)


@query("intersect_scope", "select id from cat where country in ('US', 'CN') and mission = 'nav'")
def intersect_scope(spark: SparkSession, d: str) -> DataFrame:
    cat = catalog(spark, d)
    return stats.scoped(cat, Lens(missions=("nav",)), NOW_MS, cat.filter(F.col("country").isin("US", "CN"))).select("id")


_OVERLAP = "select count(*) filter (where bloc = 'EU' and regime <> 'LEO') as only_a, count(*) filter (where bloc <> 'EU' and regime = 'LEO') as only_b, count(*) filter (where bloc = 'EU' and regime = 'LEO') as both from cat"


@query("lens_overlap", _OVERLAP)
def lens_overlap(spark: SparkSession, d: str) -> DataFrame:
    return stats.overlap(catalog(spark, d), Lens(blocs=("EU",)), Lens(regimes=("LEO",)), NOW_MS)


@query("lens_overlap_bitmap", _OVERLAP)
def lens_overlap_bitmap(spark: SparkSession, d: str) -> DataFrame:
    return bitmaps.build(catalog(spark, d, rules=False), scratch(spark)).overlap(Lens(blocs=("EU",)), Lens(regimes=("LEO",)), NOW_MS)


@query("style_codes", "select id, case when bloc = 'US' then 4 when bloc = 'CN' then 5 else 1 end as style from cat")
def style_codes(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("id", compare.style_code(NOW_MS, Lens(blocs=("US",)), Lens(blocs=("CN",))).alias("style"))


_CAPPED = [Lens(constellations=("starlink",), countries=("LU",)), Lens(countries=("FI",), regimes=("GEO",)), Lens(countries=("IT",), missions=("human",)), Lens(regimes=("LEO",)), Lens(countries=("ES",), regimes=("MEO",))]
_CAPPED_SQL = ["constellation = 'starlink' and country = 'LU'", "country = 'FI' and regime = 'GEO'", "country = 'IT' and mission = 'human'", "regime = 'LEO'", "country = 'ES' and regime = 'MEO'"]


@query(
    "orbit_cap",
    'select id, g as "group" from m where k <= greatest(1, 321 - before)',
    "g as (" + " union all ".join(f"select {i} as g, id from cat where {w}" for i, w in enumerate(_CAPPED_SQL)) + "), n as (select g, count(*) as n from g group by g having count(*) <= 320), "
    # Each group lists as many as are left up to 321, and one at least.
    "l as (select g, n, row_number() over (order by g) as step from n), t(step, g, before, listed) as (select 0::bigint, -1, 0::bigint, 0::bigint union all select l.step, l.g, t.listed, t.listed + least(l.n, greatest(1, 321 - t.listed)) from t join l on l.step = t.step + 1), "
    "m as (select g.id, g.g, t.before, row_number() over (partition by g.g order by g.id) as k from g join t on t.g = g.g)",
)
def orbit_cap(spark: SparkSession, d: str) -> DataFrame:
    return stats.orbit_rows(catalog(spark, d), _CAPPED, NOW_MS).select("id", "group")


def _side(name: str, where: str, other: str) -> str:
    n = lambda w, extra="": f"(select count(*) from cat where {w}{extra})"
    new = " and " + LENSES["recency"][1]
    return (
        f"select '{name}' as side, {n(where)} as total, {n(where)} / (select count(*) from cat)::double as share, null::bigint as in_view, "
        f"(select max(a) from (select mean_alt_km::double as a, row_number() over (order by mean_alt_km) - 1 as k, count(*) over () as n from cat where {where}) where k = n // 2) as median_alt_km, "
        f"(select string_agg(distinct regime, ',' order by regime) from cat where {where}) as regimes, {n(where, new)} as last_365, "
        f"(select least(180, greatest(0, floor(inclination + 0.5)))::int as x from cat where {where} group by 1 order by count(*) desc, x limit 1) as main_inc, "
        f"(select operator from cat where {where} group by 1 order by count(*) desc, min(id) limit 1) as top_operator, "
        f"{n(where)} > {n(other)} as wins_total, {n(where, new)} > {n(other, new)} as wins_new"
    )


@query("compare_table", _side("a", "bloc = 'US'", "bloc = 'CN'") + " union all " + _side("b", "bloc = 'CN'", "bloc = 'US'"))
def compare_table(spark: SparkSession, d: str) -> DataFrame:
    return compare.compare_table(catalog(spark, d, rules=False), Lens(blocs=("US",)), Lens(blocs=("CN",)), NOW_MS)  # no fact of it needs a name


def _facts_sql(name: str, where: str) -> str:
    n = "(select count(*) from cat where {0})"
    return (
        f"select '{name}' as scope, {n.format(where)} as total, {n.format(where + ' and ' + LENSES['recency'][1])} as last_365, "
        f"coalesce((select max(a) from (select mean_alt_km::double as a, row_number() over (order by mean_alt_km) - 1 as k, count(*) over () as n from cat where {where}) where k = n // 2), 0) as median_alt_km, "
        f"(select operator from cat where {where} group by 1 order by count(*) desc, min(id) limit 1) as top_operator, "
        f"(select constellation from cat where {where} and constellation is not null group by 1 order by count(*) desc, min(id) limit 1) as top_constellation"
    )


@query("scope_facts", " union all ".join(_facts_sql(name, where) for name, (_, where) in LENSES.items()))
def scope_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of ten scopes that overlap, in the scans of one."""
    found = scopes.facts(catalog(spark, d), {name: lens.to_column(NOW_MS) for name, (lens, _) in LENSES.items()}, NOW_MS)
    return found.select("scope", "total", "last_365", "median_alt_km", F.col("top_operator.key").alias("top_operator"), F.col("top_constellation.key").alias("top_constellation"))


@query("orbit_derive", f"select id, mean_alt_km::double as alt, apogee_km::double as apogee, regime, {_BIN} as alt_bin from cat")
def orbit_derive(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("id", F.col("mean_alt_km").cast("double").alias("alt"), F.col("apogee_km").cast("double").alias("apogee"), "regime", altitude_bin(F.col("mean_alt_km").cast("double")).alias("alt_bin"))


@query("name_rules", "select id, name, constellation, mission, sector, bloc from cat")
def name_rules(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("id", "name", "constellation", "mission", "sector", "bloc")


def _entry_rows() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({text(k)}, {text(i)}, [{', '.join(text(t) for t in terms)}], {at})" for at, (k, i, _, _, terms) in enumerate(search.fixed_entries()))


_KEYS = " union all ".join(f"select '{k}' as kind, {k} as key, id from cat where {k} is not null" for k in search.FIELDS)
_ENTRIES = (
    f"k as (select kind, key, count(*) as n, min(id) as first from ({_KEYS}) group by kind, key), f as (select * from (values {_entry_rows()}) as t(kind, key, terms, place)), "
    "e as (select f.kind, f.key, f.terms, coalesce(k.n, 0) as n, case when f.kind in ('constellation', 'country') then k.first else f.place end as pos "
    "from f left join k on k.kind = f.kind and k.key = f.key where f.kind not in ('constellation', 'country') or k.n is not null "
    "union all select kind, key, [lower(key)], n, first from k where kind = 'operator'), "
    "t as (select kind, key, n, pos, list_max(list_transform(terms, lambda t: case when t = 'star' then 2.0 when starts_with(t, 'star') then 1.6 "
    "when len(list_filter(regexp_split_to_array(t, '[\\s·()/,-]+'), lambda w: starts_with(w, 'star'))) > 0 then 1.3 when contains(t, 'star') then 0.9 else 0.0 end))::double as best from e), "
    "g as (select kind, key, nullif(n, 0) as count, best * case kind when 'preset' then 1.15 when 'constellation' then 1.2 else 1.05 end + log10(1 + n) * 0.08 as score, "
    "list_position(['preset', 'constellation', 'operator', 'country', 'bloc', 'mission', 'regime'], kind) as kk, pos from t where best > 0 order by score desc, kk, pos limit 12)"
)


@query("search_groups", "select kind, key, count, score::double as score from g", _ENTRIES)
def search_groups(spark: SparkSession, d: str) -> DataFrame:
    return search.search_groups(catalog(spark, d), "Star").select("kind", "key", "count", "score")


_NAMED = (
    "q as (select id, name, case when name = 'COSMOS 2' then 2.2 when starts_with(name, 'COSMOS 2') then 1.6 - least(0.5, length(name) / 200e0) when contains(name, 'COSMOS 2') then 1.0 else 0.0 end::double as score from cat), "
    "w as (select * from q where score > 0 order by score desc, length(name), id limit 8)"
)


@query("search_satellites", "select id, name, score from w", _NAMED)
def search_satellites(spark: SparkSession, d: str) -> DataFrame:
    return search.search_satellites(catalog(spark, d), "cosmos 2")


_SHARE = "floor(100 * {0} / n + 0.5)::int"


@query(
    "scope_insights",
    "select * from (select 1 as ord, 'leo-share' as id, (" + _SHARE.format("leo") + ")::varchar || '%' as value, 'of satellites in total fly in low Earth orbit (< 2,000 km)' as label, '{\"regimes\": [\"LEO\"]}' as lens from x where leo > 0 "
    "union all select 2, 'top-constellation', (" + _SHARE.format("c") + ")::varchar || '%', 'belong to ' || l || ' (' || format('{:,}', c) || ')', '{\"constellations\": [\"' || k || '\"]}' from x, tc where " + _SHARE.format("c") + " >= 5 "
    "union all select 3, 'densest-band', format('{:,}', (case when lo < 1000 then floor(lo / 10 + 0.5) * 10 when lo < 10000 then floor(lo / 100 + 0.5) * 100 else floor(lo / 500 + 0.5) * 500 end)::bigint) || '–' || format('{:,}', (case when hi < 1000 then floor(hi / 10 + 0.5) * 10 when hi < 10000 then floor(hi / 100 + 0.5) * 100 else floor(hi / 500 + 0.5) * 500 end)::bigint) || ' km', 'most congested altitude band: ' || format('{:,}', p) || ' satellites', '{\"altitude\": [' || floor(lo)::bigint || ', ' || ceil(hi)::bigint || ']}' from db where p >= 10 "
    "union all select 4, 'korea', format('{:,}', kr), 'South Korean satellites in total', '{\"countries\": [\"KR\"]}' from x where kr > 0 "
    "union all select 5, 'new', (" + _SHARE.format("y") + ")::varchar || '%', 'launched in the last 12 months (' || format('{:,}', y) || ')', '{\"launchedWithinDays\": 365}' from x where y >= 10 "
    "union all select 6, 'new-30', '+' || format('{:,}', m), 'new satellites in total launched in the last 30 days', '{\"launchedWithinDays\": 30}' from x where m > 0 "
    "union all select 7, 'geo', format('{:,}', geo), 'geostationary satellites parked on the GEO belt', '{\"regimes\": [\"GEO\"]}' from x where geo >= 5)",
    f"x as (select count(*) as n, count(*) filter (where regime = 'LEO') as leo, count(*) filter (where regime = 'GEO') as geo, count(*) filter (where bloc = 'KR') as kr, count(*) filter (where launch_ms >= {NOW_MS} - 365 * 86400000::bigint) as y, count(*) filter (where launch_ms >= {NOW_MS} - 30 * 86400000::bigint) as m from cat), "
    "tc as (select constellation as k, count(*) as c, case constellation when 'oneweb' then 'OneWeb' when 'starlink' then 'Starlink' when 'stations' then 'Space station modules' when 'gps' then 'GPS' when 'glonass' then 'GLONASS' when 'spire' then 'Spire Lemur' when 'yaogan' then 'Yaogan' else 'Qianfan (Thousand Sails)' end as l from cat where constellation is not null group by 1 order by c desc, min(id) limit 1), "
    f"b as (select unnest(range(72)) as b), h as (select b.b, count(c.x) as n from b left join (select {_BIN} as x from cat) c on c.x = b.b group by 1), "
    "db as (select 150 * pow(300, b / 72e0) as lo, 150 * pow(300, (b + 2) / 72e0) as hi, p from (select b, n + lead(n) over (order by b) as p from h) where p > 0 order by p desc, b limit 1)",
)
def scope_insights(spark: SparkSession, d: str) -> DataFrame:
    return insights.scope_insights(catalog(spark, d), NOW_MS)


#: Synthetic positions: a circle of each row's own, the same SQL on both engines.
_POSITIONS = "select id, cos(id * 0.37e0) * r * cos(inclination / 57.29577951308232e0) as x, sin(inclination / 57.29577951308232e0) * r as y, -sin(id * 0.37e0) * r * cos(inclination / 57.29577951308232e0) as z from (select id, inclination, 1 + mean_alt_km::double / 6371e0 as r from cat)"
_CAMERA = view.Camera.looking_at_centre(4.0, 3.0, 5.0, 1.6)


def _positions(spark: SparkSession, d: str) -> DataFrame:
    rows = orbits(spark, d).select("id", "inclination", (1 + F.col("mean_alt_km").cast("double") / 6371.0).alias("r"))
    a, b = F.col("id") * 0.37, F.col("inclination") / 57.29577951308232
    return rows.select("id", (F.cos(a) * F.col("r") * F.cos(b)).alias("x"), (F.sin(b) * F.col("r")).alias("y"), (-F.sin(a) * F.col("r") * F.cos(b)).alias("z"))


def _clip_sql(row: int) -> str:
    m = _CAMERA.matrix[row]
    return f"(({m[0]!r})::double * x + ({m[1]!r})::double * y + ({m[2]!r})::double * z + ({m[3]!r})::double)"


_C = f"{_CAMERA.x!r}::double", f"{_CAMERA.y!r}::double", f"{_CAMERA.z!r}::double"
_SEEN = (
    f"p as ({_POSITIONS}), c as (select *, {_clip_sql(0)} as cx, {_clip_sql(1)} as cy, {_clip_sql(3)} as cw, x - {_C[0]} as dx, y - {_C[1]} as dy, z - {_C[2]} as dz from p), "
    f"o as (select *, dx * dx + dy * dy + dz * dz as qa, 2 * ({_C[0]} * dx + {_C[1]} * dy + {_C[2]} * dz) as qb from c), "
    f"q as (select *, qb * qb - 4 * qa * ({_CAMERA.x**2 + _CAMERA.y**2 + _CAMERA.z**2 - 1!r})::double as disc from o), "
    "s as (select *, disc > 0 and (-qb - sqrt(greatest(disc, 0e0))) / (2 * qa) > 0 and (-qb - sqrt(greatest(disc, 0e0))) / (2 * qa) < 1 as hid from q)"
)


_IN_VIEW = "select id from s where cw > 0 and abs(cx / cw) <= 1 and abs(cy / cw) <= 1 and not hid"


@query("in_view", _IN_VIEW, _SEEN)
def in_view(spark: SparkSession, d: str) -> DataFrame:
    return view.in_view(_positions(spark, d), _CAMERA).select("id")


_PICK = "select id, score from (select id, d2 + case when id % 3 = 0 then 120 when id % 3 = 1 then -40 else 0 end as score from (select id, ((cx / cw + 1) * 0.5 * 1600 - 800) ** 2 + ((1 - cy / cw) * 0.5 * 1000 - 400) ** 2 as d2 from s where cw > 0 and not hid) where d2 <= 24 ** 2) order by score, id limit 1"


def _styled(spark: SparkSession, d: str) -> DataFrame:
    style = F.when(F.col("id") % 3 == 0, compare.GHOST).when(F.col("id") % 3 == 1, compare.FOCUS).otherwise(compare.BASE)
    return _positions(spark, d).withColumn("style", style)


@query("pick", _PICK, _SEEN)
def pick(spark: SparkSession, d: str) -> DataFrame:
    return view.pick(_styled(spark, d), _CAMERA, 800, 400, 1600, 1000, view.TOUCH_RADIUS).select("id", "score")


_BOTH = _side("a", "bloc = 'US'", "bloc = 'CN'") + " union all " + _side("b", "bloc = 'CN'", "bloc = 'US'")


@query("compare_in_view", f"select * replace ((select count(*) from v where v.bloc = case side when 'a' then 'US' else 'CN' end) as in_view) from ({_BOTH})", f"{_SEEN}, v as (select cat.bloc from ({_IN_VIEW}) join cat using (id))")
def compare_in_view(spark: SparkSession, d: str) -> DataFrame:
    """The comparison with the number of each side's satellites in view."""
    seen = view.in_view(_positions(spark, d), _CAMERA)
    return compare.compare_table(catalog(spark, d, rules=False), Lens(blocs=("US",)), Lens(blocs=("CN",)), NOW_MS, in_view=seen)


@query("in_view_cells", _IN_VIEW, _SEEN)
def in_view_cells(spark: SparkSession, d: str) -> DataFrame:
    """The same from positions that are stored by cells: of those that the camera can't see, no file is opened."""
    return cells.build(_positions(spark, d), scratch(spark), per_cell=500).in_view(_CAMERA).select("id")


@query("pick_cells", _PICK, _SEEN)
def pick_cells(spark: SparkSession, d: str) -> DataFrame:
    found = cells.build(_styled(spark, d), scratch(spark), per_cell=500)
    return found.pick(_CAMERA, 800, 400, 1600, 1000, view.TOUCH_RADIUS).select("id", "score")


@query("label_anchors", "select id, (cx / cw * 0.5 + 0.5) * 1600 as sx, (0.5 - cy / cw * 0.5) * 1000 as sy, abs(cx / cw) < 1.05 and abs(cy / cw) < 1.05 and not hid as visible from s", _SEEN)
def label_anchors(spark: SparkSession, d: str) -> DataFrame:
    return view.anchors(_positions(spark, d), _CAMERA, 1600, 1000)


@query("interpolate", "select id, x + (y - x) * 0.25 as x, y + (z - y) * 0.25 as y, z + (x - z) * 0.25 as z from p", f"p as ({_POSITIONS})")
def interpolate(spark: SparkSession, d: str) -> DataFrame:
    a = _positions(spark, d)
    return view.interpolate(a, a.select("id", F.col("y").alias("x"), F.col("z").alias("y"), F.col("x").alias("z")), 0, 1000, 250)


_GMST = "(-6.2e-6 * t * t * t + 0.093104 * t * t + (876600e0 * 3600 + 8640184.812866e0) * t + 67310.54841e0) * (pi() / 180) / 240e0"


@query(
    "frames_roundtrip",
    "select id, 90 - inclination as lat, case when l > 180 then l - 360 else l end as lon, 2e0 as r, round(2 * cos(a) * cos(b + s), 5) as x, round(2 * sin(a), 5) as y, round(-2 * cos(a) * sin(b + s), 5) as z "
    f"from (select *, radians(90 - inclination) as a, radians(l) as b, {_GMST} as s from (select id, inclination, (id * 7.3e0) % 360 as l, ({NOW_MS} / 86400000e0 + 2440587.5e0 - 2451545e0) / 36525e0 as t from cat))",
)
def frames_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The scene's point of a latitude and longitude, and these again from the point."""
    ms = F.lit(float(NOW_MS))
    rows = catalog(spark, d).select("id", F.struct((90 - F.col("inclination")).alias("lat"), ((F.col("id") * 7.3) % 360).alias("lon")).alias("g"))
    x, y, z = frames.scene_from_lat_lon(F.col("g.lat"), F.col("g.lon"), F.lit(2.0), ms)
    lat, lon, r = frames.lat_lon_from_scene(F.col("x"), F.col("y"), F.col("z"), ms)
    out = rows.select("id", x.alias("x"), y.alias("y"), z.alias("z")).select("id", "x", "y", "z", lat.alias("lat"), lon.alias("lon"), r.alias("r"))
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("lat", "lon", "r")], *[F.round(c, 5).alias(c) for c in ("x", "y", "z")])


@query("sun_and_sidereal_time", f"select event_id, round({_GMST} % (2 * pi()), 8) as gmst from (select event_id, ((epoch_us(ts) // 1000) / 86400000e0 + 2440587.5e0 - 2451545e0) / 36525e0 as t from events)")
def sun_and_sidereal_time(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select("event_id", F.round(frames.gmst(F.unix_millis(F.col("ts").cast("timestamp")).cast("double")), 8).alias("gmst"))


def _orbits(spark: SparkSession, d: str) -> DataFrame:
    degrees = lambda k: (F.col("id") * k) % 360.0
    return orbits(spark, d).select("id", "mean_motion", "eccentricity", "inclination", degrees(3.1).alias("raan"), degrees(5.7).alias("arg_pericenter"), degrees(11.3).alias("mean_anomaly"), F.lit(1e-5).alias("bstar"), F.lit(NOW_MS).alias("epoch_ms"))


@query("sgp4_positions")
def sgp4_positions(spark: SparkSession, d: str) -> DataFrame:
    return motion.positions(_orbits(spark, d), NOW_MS + 3_600_000.0)


@query("sgp4_states")
def sgp4_states(spark: SparkSession, d: str) -> DataFrame:
    return motion.state_at(_orbits(spark, d), NOW_MS + 3_600_000.0)


@query("tick_stream")
def tick_stream(spark: SparkSession, d: str) -> DataFrame:
    """The stream's positions at two ticks of each day of the events, half a minute apart: one at a snapshot, one between two."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    first = spark.read.parquet(f"{d}/events.parquet").groupBy(F.floor(ms / 86_400_000).alias("day")).agg(F.min(ms).alias("ms"))
    days = first.crossJoin(F.broadcast(first.agg(F.min("ms").alias("begin"), F.min("day").alias("first"))))  # one row
    each = days.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), (F.col("day") - F.col("first")).alias("day"), (NOW_MS + F.col("ms") - F.col("begin")).alias("ms"))
    table = each.select((2 * F.col("day") + F.col("k")).alias("tick"), (F.col("ms") + 30_000 * F.col("k")).alias("ms"), F.lit(60.0).alias("warp"), F.lit(0).alias("clock_epoch"), F.lit(False).alias("paused"))
    return ticks.replay(spark, table, _orbits(spark, d), scratch(spark))


@query("deep_space_ephemeris")
def deep_space_ephemeris(spark: SparkSession, d: str) -> DataFrame:
    """Satellites under the pull of Sun and Moon, a month and a day before the elements' epoch and after it."""
    days = [-30, -1, 1, 30]
    return motion.ephemeris(motion.deep_space(_orbits(spark, d)), [NOW_MS + x * 86_400_000.0 for x in days])


@query("orbit_path")
def orbit_path(spark: SparkSession, d: str) -> DataFrame:
    return motion.orbit_path(_orbits(spark, d), NOW_MS)


@query("ground_track")
def ground_track(spark: SparkSession, d: str) -> DataFrame:
    return motion.ground_track(_orbits(spark, d), NOW_MS)


@query("event_windows", "select date_trunc('hour', ts) as start, event_type, count(*) as n, sum(value) as total from events group by all")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return ticks.windowed_events(spark.read.parquet(f"{d}/events.parquet")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("display_formats", "select c_custkey as id, format('{:,}', floor(c_acctbal + 0.5)::bigint) as n, case when c_acctbal < 1000 then floor(c_acctbal / 10 + 0.5) * 10 else floor(c_acctbal / 100 + 0.5) * 100 end as alt, case when c_nationkey > 90 then 'retrograde' when c_nationkey < 1 then 'equatorial' else 'prograde' end as kind from customer")
def display_formats(spark: SparkSession, d: str) -> DataFrame:
    bal = F.col("c_acctbal")
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), fmt.fmt_int(bal).alias("n"), fmt.round_altitude(bal).cast("double").alias("alt"), fmt.inclination_kind(F.col("c_nationkey")).alias("kind"))


@query("dictionary_encode", "select v as value, row_number() over (order by first) - 1 as code from (select operator as v, min(id) as first from cat group by 1)")
def dictionary_encode(spark: SparkSession, d: str) -> DataFrame:
    return stats.first_seen_codes(catalog(spark, d), "operator")


@query("satellite_card")
def satellite_card(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog(spark, d).join(_orbits(spark, d).select("id", "raan", "arg_pericenter", "mean_anomaly", "bstar", "epoch_ms"), "id")
    return card.satellite_card(rows, 37, NOW_MS + 60_000.0, NOW_MS)
