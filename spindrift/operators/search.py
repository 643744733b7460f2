"""Ranked search over groups (presets, constellations, operators, countries, blocs, missions, regimes) and satellites."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import country_name
from ..functions.text import norm, norm_value
from ..plans import vocab
from ..plans.lens import PRESETS, Lens, preset_by_id

KINDS = ["preset", "constellation", "operator", "country", "bloc", "mission", "regime"]
#: Weight of a kind of entry.
BOOST = {"preset": 1.15, "constellation": 1.2}
OTHER_BOOST = 1.05
#: The lens field that an entry of a kind sets.
FIELDS = {"constellation": "constellations", "operator": "operators", "country": "countries", "bloc": "blocs", "mission": "missions", "regime": "regimes"}
_ENTRY = "kind string, key string, title string, subtitle string, terms array<string>"


def fixed_entries() -> list[tuple]:
    """Entries of the fixed vocabularies: (kind, key, title, subtitle, normalized terms); which of them count, the catalogue says."""
    flag = lambda c: "".join(chr(0x1F1A5 + ord(x)) for x in c) if re.fullmatch("[A-Z]{2}", c) else "🌐"
    raw = [("preset", p.id, p.label, p.hint, []) for p in PRESETS]
    raw += [("constellation", i, label, f"{operator} · {text}", [i, operator]) for i, label, operator, text in vocab.CONSTELLATIONS]
    raw += [("country", c, f"{flag(c)} {name}", "Country of registry", [name, c]) for c, name, _ in vocab.COUNTRIES if c != "XX"]
    raw += [("bloc", i, label, "Owner region", []) for i, label, _ in vocab.BLOCS if i != "OT"]
    raw += [("mission", i, label, "Mission", [short]) for i, label, short in vocab.MISSIONS]
    raw += [("regime", i, f"{i} · {label}", text, [i, label]) for i, label, text in vocab.REGIMES]
    return [(k, i, t, s, [norm_value(x) for x in (t, *more, *vocab.ALIASES.get(f"{k}:{i}", []))]) for k, i, t, s, more in raw]


def entries(catalog: DataFrame) -> DataFrame:
    """kind, key, title, subtitle, terms, count and ord (kind, then first seen or fixed order) of all entries."""
    spark = catalog.sparkSession
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in FIELDS])
    # All groupings in one pass; the keys of a kind are few beside the rows.
    seen = catalog.select("id", F.inline(keys)).filter("key is not null").groupBy("kind", "key").agg(F.count("*").alias("count"), F.min("id").alias("first"))
    fixed = spark.createDataFrame([(*e, i) for i, e in enumerate(fixed_entries())], _ENTRY + ", place int")  # under two hundred rows
    joined = F.broadcast(fixed).join(seen, ["kind", "key"], "full")
    known = joined.filter("title is not null").filter("kind not in ('constellation', 'country') or count is not null")
    ord_of = F.when(F.col("kind").isin("constellation", "country"), F.col("first")).otherwise(F.col("place"))
    rank = lambda c: F.array_position(F.array(*[F.lit(k) for k in KINDS]), c)
    known = known.select("kind", "key", "title", "subtitle", "terms", F.coalesce("count", F.lit(0)).alias("count"), F.struct(rank(F.col("kind")).alias("kind"), ord_of.cast("long").alias("at")).alias("ord"))
    new = joined.filter("title is null").filter("kind = 'constellation' or (kind = 'operator' and key not in ('Unknown operator', 'Unidentified')) or (kind = 'country' and key <> 'XX')")
    title = F.when(F.col("kind") == "country", F.concat(F.lit("🌐 "), country_name(F.col("key")))).otherwise(F.col("key"))
    subtitle = F.when(F.col("kind") == "operator", "Operator").when(F.col("kind") == "country", "Country of registry").otherwise("Constellation")
    new = new.select("kind", "key", title.alias("title"), subtitle.alias("subtitle"), F.array(norm(title), norm(F.col("key"))).alias("terms"), "count", F.struct(rank(F.col("kind")).alias("kind"), F.col("first").cast("long").alias("at")).alias("ord"))
    return known.unionByName(new)


def term_score(term: Column, q: str) -> Column:
    words = F.split(term, r"[\s·()/,-]+")
    inside = F.when(term.contains(q), 0.9).otherwise(0.0) if len(q) >= 3 else F.lit(0.0)
    return F.when(term == q, 2.0).when(term.startswith(q), 1.6).when(F.exists(words, lambda w: w.startswith(F.lit(q))), 1.3).otherwise(inside)


def search_groups(catalog: DataFrame, raw: str, limit: int = 12) -> DataFrame:
    """kind, key, title, subtitle, count (null: 0), score and ord of the best groups."""
    return rank_entries(entries(catalog), raw, limit)


def rank_entries(listed: DataFrame, raw: str, limit: int = 12) -> DataFrame:
    """The best groups of a table of entries."""
    q = norm_value(raw)
    rows = listed.withColumn("best", F.array_max(F.transform("terms", lambda t: term_score(t, q))) if q else F.lit(0.0)).filter("best > 0")
    boost = F.when(F.col("kind") == "preset", BOOST["preset"]).when(F.col("kind") == "constellation", BOOST["constellation"]).otherwise(OTHER_BOOST)
    scored = rows.select("kind", "key", "title", "subtitle", F.nullif("count", F.lit(0)).alias("count"), (F.col("best") * boost + F.log10(1 + F.col("count")) * 0.08).alias("score"), "ord")
    return scored.orderBy(F.desc("score"), "ord").limit(limit)


def search_satellites(catalog: DataFrame, raw: str, limit: int = 8) -> DataFrame:
    """id, name, score of the best satellites; by nickname, number, international designator, then name.

    Nicknames are looked up in the normal form of both sides. Ties: shorter names, then smaller ids.
    """
    upper, q = raw.strip().upper(), norm_value(raw)
    if not q:
        return catalog.select("id", "name", F.lit(0.0).alias("score")).limit(0)
    name = F.upper("name")
    nickname = {norm_value(k): v for k, v in vocab.NICKNAMES.items()}.get(q)
    score = F.when(F.col("id") == nickname, 3.2) if nickname is not None else F.when(F.lit(False), 0.0)
    score = score.when(F.col("id") == int(upper), 3.0) if re.fullmatch(r"[0-9]{1,6}", upper) else score
    score = score.when(F.col("cospar") == upper, 2.5) if "cospar" in catalog.columns else score
    score = score.when(name == upper, 2.2).when(name.startswith(upper), 1.6 - F.least(F.lit(0.5), F.length(name) / 200.0))
    score = score.when(name.contains(upper), 1.0) if len(upper) >= 3 else score
    found = catalog.select("id", "name", F.coalesce(score, F.lit(0.0)).alias("score")).filter("score > 0")
    return found.orderBy(F.desc("score"), F.length("name"), "id").limit(limit)


def search(catalog: DataFrame, raw: str, limit: int = 12) -> DataFrame:
    """kind, key, title, count, score and rank (from 1): groups and satellites by score, groups first on ties."""
    return merge(search_groups(catalog, raw, limit), search_satellites(catalog, raw), limit)


def merge(groups: DataFrame, satellites: DataFrame, limit: int = 12) -> DataFrame:
    """Groups and satellites in one ranking."""
    groups = groups.select("kind", "key", "title", "count", "score", F.struct(F.lit(0).alias("source"), F.col("ord.kind").cast("long").alias("a"), F.col("ord.at").alias("b")).alias("tie"))
    found = satellites.select(F.lit("satellite").alias("kind"), F.col("id").cast("string").alias("key"), F.col("name").alias("title"), F.lit(None).cast("long").alias("count"), "score", F.struct(F.lit(1).alias("source"), F.length("name").cast("long").alias("a"), F.col("id").cast("long").alias("b")).alias("tie"))
    merged = groups.unionByName(found).orderBy(F.desc("score"), "tie").limit(limit)
    rows = merged.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), "tie", "kind", "key", "title", "count", "score"))).alias("r"))  # `limit` rows
    return rows.select(F.posexplode("r").alias("at", "x")).select((F.col("at") + 1).alias("rank"), "x.kind", "x.key", "x.title", "x.count", "x.score")


def suggestions(comparing: bool = False) -> list[tuple[str, str]]:
    """(kind, key) shown for an empty query. Fixed values."""
    presets = [("preset", p) for p in ("starlink", "gnss", "stations", "korea", "china", "new")]
    return presets if comparing else presets + [("satellite", s) for s in ("25544", "48274", "20580")]


def result_lens(kind: str, key: str) -> Lens:
    """The lens that choosing a result applies; a satellite's is the one of its id."""
    if kind == "satellite":
        return Lens(ids=(int(key),))
    return preset_by_id(key).lens if kind == "preset" else Lens(**{FIELDS[kind]: (key,)})

