"""Styles of rows under a lens, and the two-sided comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lens import Lens
from . import scopes

#: Style codes; from FOCUS on a row is in focus.
HIDDEN, GHOST, BASE, FOCUS, SIDE_A, SIDE_B = 0, 1, 2, 3, 4, 5


def style_code(now_ms: int, lens: Lens | None = None, compare: Lens | None = None, preview: Lens | None = None, only: bool = False) -> Column:
    """A preview stands for the lens and turns comparison and `only` off; in a comparison the first side wins."""
    if preview is not None and not preview.is_empty():
        lens, compare, only = preview, None, False
    focus = lens is not None and not lens.is_empty()
    rest = HIDDEN if only else GHOST
    if compare is not None:
        first = lens.to_column(now_ms) if focus else F.lit(False)
        return F.when(first, SIDE_A).when(compare.to_column(now_ms), SIDE_B).otherwise(rest)
    return F.when(lens.to_column(now_ms), FOCUS).otherwise(rest) if focus else F.lit(BASE)


def focused_count(styled: DataFrame, style: str = "style") -> DataFrame:
    return styled.agg(F.count_if(F.col(style) >= FOCUS).alias("n"))


def compare_table(catalog: DataFrame, a: Lens, b: Lens, now_ms: int, in_view: DataFrame | None = None) -> DataFrame:
    """A row per side: total, share, in_view, median_alt_km, regimes, last_365, main_inc, top_operator, and who wins."""
    sides = {"a": a.to_column(now_ms), "b": b.to_column(now_ms), "all": F.lit(True)}
    found = scopes.facts(catalog, sides, now_ms, counted=("all",), in_view=in_view, modes=1)
    # Three rows: brought together in one, so that no side is computed again for the other.
    one = found.agg(*[F.max_by(F.struct(*found.columns), F.col("scope") == side).alias(side) for side in sides])
    both = one.select(F.col("all.total").alias("all"), F.inline(F.array("a", "b"))).withColumnRenamed("scope", "side")
    both = both.withColumns({"main_inc": F.get(F.col("modes"), F.lit(0))["inc"], "top_operator": F.col("top_operator.key")})
    most_of = lambda f, c: F.max(c).over(Window.partitionBy("all")) if f == "most" else F.min(c).over(Window.partitionBy("all"))
    both = both.withColumns({f"{f}_{k}": most_of(f, c) for k, c in (("total", "total"), ("new", "last_365")) for f in ("most", "least")})
    share = F.when(F.col("all") > 0, F.col("total") / F.col("all")).otherwise(0.0)
    wins = lambda c, k: (F.col(c) == F.col(f"most_{k}")) & (F.col(f"most_{k}") > F.col(f"least_{k}"))
    return both.select("side", "total", share.alias("share"), "in_view", "median_alt_km", "regimes", "last_365", "main_inc", "top_operator", wins("total", "total").alias("wins_total"), wins("last_365", "new").alias("wins_new"))
