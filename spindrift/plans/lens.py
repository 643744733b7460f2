"""The lens: one declarative query over the catalogue. OR within a field, AND across fields; it compiles to a Column."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.format import fmt_int_value
from . import vocab

DAY_MS = 86_400_000
_LISTS = ("constellations", "countries", "operators", "blocs", "missions", "regimes", "sectors", "ids")
#: Column of the catalogue for each list field.
_COLUMNS = {"constellations": "constellation", "countries": "country", "operators": "operator", "blocs": "bloc", "missions": "mission", "regimes": "regime", "sectors": "sector", "ids": "id"}


def _utf16(x) -> bytes:
    """Sort key of the order by UTF-16 units, in which numbers stand as text too."""
    return str(x).encode("utf-16-be", "surrogatepass")


@dataclass(frozen=True)
class Lens:
    """Unset fields are None. Lists may be given as lists; `normalized` turns them into sorted tuples."""

    constellations: tuple | None = None
    countries: tuple | None = None
    operators: tuple | None = None
    blocs: tuple | None = None
    missions: tuple | None = None
    regimes: tuple | None = None
    sectors: tuple | None = None
    altitude: tuple | None = None
    launched_within_days: float | None = None
    ids: tuple | None = None

    def is_empty(self) -> bool:
        """No field is set. A recency of 0 days is set, though it filters nothing; an empty list is not."""
        values = [(f.name, getattr(self, f.name)) for f in fields(self)]
        return all(v is None or (name in _LISTS and not v) for name, v in values)

    def normalized(self) -> Lens:
        lists = {n: tuple(sorted(set(v), key=_utf16)) if (v := getattr(self, n)) else None for n in _LISTS}
        return replace(self, **lists, altitude=tuple(self.altitude) if self.altitude is not None else None)

    def same_as(self, other: Lens) -> bool:
        return self.normalized() == other.normalized()

    def refined(self, **changes) -> Lens:
        """Fields given replace those here; one given as None is removed."""
        return replace(self, **changes).normalized()

    def to_column(self, now_ms: int) -> Column:
        """The predicate; true or false for every row, as nulls never match."""
        tests = [F.col(_COLUMNS[n]).isin(*v) for n in _LISTS if (v := getattr(self, n))]
        if self.altitude is not None:
            # Altitudes are stored as 32-bit floats and compared as 64-bit ones.
            tests.append(F.col("mean_alt_km").cast("double").between(float(self.altitude[0]), float(self.altitude[1])))
        if self.launched_within_days:
            tests.append(F.col("launch_ms") >= int(now_ms - self.launched_within_days * DAY_MS))
        return F.coalesce(reduce(and_, tests), F.lit(False)) if tests else F.lit(True)

    def label(self) -> str:
        if self.is_empty():
            return "All active satellites"
        named = lambda table: {row[0]: row for row in table}
        labels, countries, blocs, missions = named(vocab.CONSTELLATIONS), named(vocab.COUNTRIES), named(vocab.BLOCS), named(vocab.MISSIONS)
        some = lambda xs: f"{xs[0]}, {xs[1]} +{len(xs) - 2}" if len(xs) > 2 else " + ".join(xs)
        parts = []
        if self.ids:
            parts.append(f"#{self.ids[0]}" if len(self.ids) == 1 else f"{len(self.ids)} satellites")
        for values, name in (
            (self.constellations, lambda c: labels[c][1] if c in labels else c),
            (self.operators, str),
            (self.countries, lambda c: countries[c][1] if c in countries else c),
            (self.blocs, lambda b: blocs[b][1]),
            (self.missions, lambda m: missions[m][2]),
            (self.regimes, str),
            (self.sectors, lambda s: s[:1].upper() + s[1:]),
        ):
            if values:
                parts.append(some([name(v) for v in values]))
        if self.altitude is not None:
            parts.append(f"{fmt_int_value(self.altitude[0])} km – {fmt_int_value(self.altitude[1])} km")
        if self.launched_within_days:
            parts.append("Launched in last 12 months" if self.launched_within_days >= 365 else f"Launched in last {self.launched_within_days:g} days")
        return " · ".join(parts)

    def to_json(self) -> dict:
        """Set fields only, under their public names."""
        names = {"launched_within_days": "launchedWithinDays"}
        return {names.get(f.name, f.name): list(v) if isinstance(v, tuple) else v for f in fields(self) if (v := getattr(self, f.name)) is not None}


@dataclass(frozen=True)
class Preset:
    id: str
    label: str
    hint: str
    lens: Lens
    distance: float


#: Fixed values, in display order.
PRESETS = [
    Preset("starlink", "Starlink", "SpaceX broadband mega-constellation", Lens(constellations=("starlink",)), 4.2),
    Preset("gnss", "GPS & GNSS", "GPS, Galileo, BeiDou, GLONASS, QZSS, NavIC", Lens(missions=("nav",)), 12),
    Preset("stations", "Space stations", "ISS, Tiangong and crew vehicles", Lens(missions=("human",)), 3.2),
    Preset("eo", "Earth observation", "Imaging, radar and weather satellites", Lens(missions=("eo",)), 4.2),
    Preset("military", "Military", "Reconnaissance, early warning, military comms", Lens(missions=("military",)), 9),
    Preset("korea", "South Korea", "Satellites registered to the Republic of Korea", Lens(countries=("KR",)), 9),
    Preset("china", "China", "All Chinese-operated satellites", Lens(blocs=("CN",)), 9),
    Preset("europe", "Europe", "ESA, EU and European operators incl. UK", Lens(blocs=("EU",)), 9),
    Preset("geo", "GEO belt", "The geostationary ring at 35,786 km", Lens(regimes=("GEO",)), 14),
    Preset("kuiper", "Amazon Leo", "Amazon's Project Kuiper broadband constellation", Lens(constellations=("kuiper",)), 4.2),
    Preset("chinese-megaconstellations", "Qianfan & Guowang", "China's two broadband mega-constellations", Lens(constellations=("qianfan", "guowang")), 4.4),
    Preset("new", "Launched last 12 mo", "Satellites launched in the last 12 months", Lens(launched_within_days=365), 6),
]


def preset_by_id(preset: str) -> Preset | None:
    return next((p for p in PRESETS if p.id == preset), None)


def preset_for_lens(lens: Lens) -> Preset | None:
    return next((p for p in PRESETS if p.lens.same_as(lens)), None)
