"""Number-first insights: rows (ord, id, value, label, lens), each given only where its fact is worth telling."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import country_name, lookup
from ..functions.format import fmt_int, fmt_km, round_altitude, share
from ..plans import vocab
from ..plans.lens import Lens
from . import scopes


def _facts(catalog: DataFrame, now_ms: int, scope: Column | None = None) -> DataFrame:
    """One row with all numbers that insights are made of, and `all`, the number of rows in and out of the scope."""
    if scope is None:
        return scopes.facts(catalog, {"scope": F.lit(True)}, now_ms).withColumn("all", F.col("total"))
    found = scopes.facts(catalog, {"scope": scope, "all": F.lit(True)}, now_ms, counted=("all",))
    one = found.agg(*[F.max_by(F.struct(*found.columns), F.col("scope") == name).alias(name) for name in ("scope", "all")])  # of two rows
    return one.select("scope.*", F.col("all.total").alias("all"))


def _percent(c: Column) -> Column:
    return F.concat(c.cast("string"), F.lit("%"))


def _json(lens: Lens, **columns: Column) -> Column:
    """JSON of a lens with fields taken from columns."""
    names = {"launched_within_days": "launchedWithinDays"}
    parts = [F.lit(json.dumps({k: v})[1:-1]) for k, v in lens.to_json().items() if k not in columns]
    parts += [F.concat(F.lit(f'"{names.get(k, k)}": '), c) for k, c in columns.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def _listed(c: Column) -> Column:
    return F.concat(F.lit('["'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"]'))


def _rows(facts: DataFrame, found: list[tuple[str, Column, Column, Column, Column | None]]) -> DataFrame:
    none = F.lit(None).cast("string")
    each = [F.when(when, F.struct(F.lit(i + 1).alias("ord"), F.lit(name).alias("id"), value.alias("value"), label.alias("label"), (none if lens is None else lens).alias("lens"))) for i, (name, when, value, label, lens) in enumerate(found)]
    return facts.select(F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")).select("x.*")


def scope_insights(scope: DataFrame, now_ms: int, in_view: bool = False) -> DataFrame:
    """Insights of what is in scope: all, or what is in view. None for fewer than three rows."""
    where = "in view" if in_view else "in total"
    total = F.col("total")
    top, band = F.col("top_constellation"), F.col("band")
    named = F.coalesce(lookup({c[0]: c[1] for c in vocab.CONSTELLATIONS}, top["key"]), top["key"])
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    edge = lambda c, f: f(c).cast("string")
    facts = _facts(scope, now_ms).filter("total >= 3")
    return _rows(facts, [
        ("leo-share", F.col("leo") > 0, _percent(share(F.col("leo"), total)), F.lit(f"of satellites {where} fly in low Earth orbit (< 2,000 km)"), _json(Lens(regimes=("LEO",)))),
        ("top-constellation", share(top["n"], total) >= 5, _percent(share(top["n"], total)), text("belong to ", named, " (", fmt_int(top["n"]), ")"), _json(Lens(), constellations=_listed(top["key"]))),
        ("densest-band", band["count"] >= 10, text(fmt_int(round_altitude(band["lo"])), "–", fmt_km(round_altitude(band["hi"]))), text("most congested altitude band: ", fmt_int(band["count"]), " satellites"), _json(Lens(), altitude=text("[", edge(band["lo"], F.floor), ", ", edge(band["hi"], F.ceil), "]"))),
        ("korea", F.col("kr") > 0, fmt_int(F.col("kr")), F.lit(f"South Korean satellites {where}"), _json(Lens(countries=("KR",)))),
        ("new", F.col("last_365") >= 10, _percent(share(F.col("last_365"), total)), text("launched in the last 12 months (", fmt_int(F.col("last_365")), ")"), _json(Lens(launched_within_days=365))),
        ("new-30", F.col("last_30") > 0, text("+", fmt_int(F.col("last_30"))), F.lit(f"new satellites {where} launched in the last 30 days"), _json(Lens(launched_within_days=30))),
        ("geo", F.col("geo") >= 5, fmt_int(F.col("geo")), F.lit("geostationary satellites " + ("visible on the GEO belt" if in_view else "parked on the GEO belt")), _json(Lens(regimes=("GEO",)))),
    ])


def lens_insights(catalog: DataFrame, lens: Lens, now_ms: int) -> DataFrame:
    """Insights of the rows of a lens beside all rows. None for an empty lens result."""
    facts = _facts(catalog, now_ms, lens.to_column(now_ms)).filter("total > 0")
    n = F.col("total")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    part = share(n, F.col("all"))
    strong = F.filter("modes", lambda m: m["count"] / n >= 0.04)
    joined = lambda f: F.array_join(F.transform(strong, f), " · ")
    operator, country = F.col("top_operator"), F.col("top_country")
    no = lambda *names: F.lit(not any(getattr(lens, x) for x in names))
    return _rows(facts, [
        ("share", F.lit(True), F.when(part == 0, "<1%").otherwise(_percent(part)), text("of all ", fmt_int(F.col("all")), " active satellites"), None),
        ("median-alt", n >= 3, fmt_km(round_altitude(F.col("median_alt_km"))), F.lit("median altitude"), None),
        ("shells", (n >= 20) & (F.size(strong) > 0), joined(lambda m: F.concat(m["inc"].cast("string"), F.lit("°"))), text("main orbital inclinations (", joined(lambda m: fmt_int(m["count"])), ")"), None),
        ("growth", (F.col("last_365") > 0) & no("launched_within_days"), text("+", fmt_int(F.col("last_365"))), text("launched in the last 12 months (", _percent(share(F.col("last_365"), n)), ")"), _json(lens, launched_within_days=F.lit("365"))),
        ("top-operator", (n >= 5) & no("operators", "constellations"), _percent(share(operator["n"], n)), text("operated by ", operator["key"]), _json(lens, operators=_listed(operator["key"]))),
        ("top-country", (n >= 5) & no("countries", "blocs") & (share(country["n"], n) < 100), _percent(share(country["n"], n)), text("registered to ", country_name(country["key"])), _json(lens, countries=_listed(country["key"]))),
    ])


#: Titles of the sections that insights are shown in, and how many each shows; a section takes up where the one before ended.
SECTIONS = {"overview": [("Worth knowing", 3), ("More facts", 4)], "view": [("Worth knowing", 3), ("Also in this view", 4)], "lens": [("Key numbers", 5)]}


def shown(found: DataFrame, where: str) -> DataFrame:
    """The insights that an overview, a view or a lens shows: their columns, the section and the place in it (from 1).

    Insights are at most seven; they stand in their order, whatever is missing.
    """
    ends, first = [], 0
    for title, most in SECTIONS[where]:
        ends.append((title, first, first + most))
        first += most
    at = F.col("at")
    section = F.coalesce(*[F.when((at > low) & (at <= high), F.struct(F.lit(title).alias("section"), (at - low).alias("place"))) for title, low, high in ends])
    placed = found.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ord"))).withColumn("s", section)
    return placed.filter("s is not null").select(*found.columns, "s.section", "s.place")


def bloc_label(i: int) -> str:
    return vocab.BLOCS[i][1]
