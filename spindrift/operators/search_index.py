"""A stored index for searches: built once from a catalogue, then a search reads a few postings in place of all names.

Names are stored twice. In `names` by size (length in upper case) and then spelling: a prefix is a range of each size, and as a
shorter name scores higher, sizes are read from the least up until there are enough hits: none of the rest can score as much. In `grams` each
name stands once per three letters in it, by letters, length and id: a search within names reads the list of its rarest letters, the
shortest names first. Both are written in order, with small row groups, so that a filter on them skips most of a file.
`lengths` (a row per size or length) and `counts` (a row per three letters) plan a search; `entries` are the groups with their counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_value
from ..plans import vocab
from . import search

GRAM = 3
#: Bytes of a row group: what a search that meets one row of it has to read.
ROW_GROUP = 1 << 20
#: Names of the shortest lengths that a search looks at first; each further step takes four times as many.
FIRST_STEP, GROWTH = 4_096, 4
#: Scores of a nickname, a number, a designator, a whole name, a beginning (less its length), a part.
NICKNAME, NUMBER, DESIGNATOR, WHOLE, BEGINNING, PART = 3.2, 3.0, 2.5, 2.2, 1.6, 1.0
_HIT = "id long, name string, score double"


def build(catalog: DataFrame, folder: str) -> SearchIndex:
    """Write the index of `catalog` (id, name, the fields of the groups, cospar if it is there) to a new `folder`.

    Rows without an id or a name can be found by nothing and are left out.
    """
    spark = catalog.sparkSession
    cospar = F.col("cospar") if "cospar" in catalog.columns else F.lit(None).cast("string")
    rows = catalog.filter("id is not null and name is not null").select(F.col("id").cast("long").alias("id"), "name", F.upper("name").alias("upper"), F.length("name").alias("length"), F.length(F.upper("name")).alias("size"), cospar.alias("cospar"))

    def put(df: DataFrame, name: str, *order: str) -> None:
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/{name}")

    put(rows, "names", "size", "upper", "id")
    put(rows, "ids", "id")
    if "cospar" in catalog.columns:
        put(rows.filter("cospar is not null"), "cospars", "cospar")
    starts = F.sequence(F.lit(1), F.length("upper") - (GRAM - 1))
    grams = rows.filter(F.length("upper") >= GRAM).withColumn("gram", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("upper", i, F.lit(GRAM))))))
    put(grams.select("gram", "length", "id", "name", "upper"), "grams", "gram", "length", "id")
    stored = spark.read.parquet(f"{folder}/grams")
    put(stored.groupBy("gram").agg(F.count("*").alias("n")), "counts", "gram")
    # A handful of lengths: one file.
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("length")) for c in ("size", "length")])).alias("l")
    rows.select(both).groupBy("l.of", "l.length").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{folder}/lengths")
    search.entries(catalog).write.parquet(f"{folder}/entries")
    return SearchIndex(spark, folder)


class SearchIndex:
    """Searches in the index that `build` has written to `folder`; the same results as of `search`, without reading the catalogue."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # As many rows as there are lengths of names.
        found = self._table("lengths").collect()
        self.lengths = {of: sorted((r["length"], r["n"]) for r in found if r["of"] == of) for of in ("size", "length")}

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _steps(self, of: str) -> list[tuple[int, int]]:
        """Ranges of sizes or lengths, the shortest first, each with a growing number of names."""
        out, first, seen, size = [], None, 0, FIRST_STEP
        for length, n in self.lengths[of]:
            first = length if first is None else first
            seen += n
            if seen >= size:
                out.append((first, length))
                first, seen, size = None, 0, size * GROWTH
        return [*out, (first, self.lengths[of][-1][0])] if first is not None else out

    def _shortest(self, rows: DataFrame, limit: int, of: str) -> list:
        """The `limit` rows with the least (size or length, length, id), read step by step: no longer name comes before a shorter."""
        found: list = []
        for low, high in self._steps(of):
            some = rows.filter(F.col(of).between(low, high)).orderBy(of, "length", "id").limit(limit - len(found))
            found += some.select("id", "name", of).collect()
            if len(found) >= limit:
                break
        return found

    def rarest(self, text: str) -> str | None:
        """Of the letters in a row of `text`, those that the fewest names have; None if no name has some of them."""
        mine = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
        counts = {r["gram"]: r["n"] for r in self._table("counts").filter(F.col("gram").isin(mine)).collect()}
        return None if len(counts) < len(mine) else min(mine, key=lambda g: (counts[g], g))

    def parts(self, text: str) -> DataFrame | None:
        """The postings of the names with `text` (of GRAM letters or more, upper case) in them."""
        gram = self.rarest(text)
        return None if gram is None else self._table("grams").filter((F.col("gram") == gram) & F.col("upper").contains(text))

    def satellites(self, raw: str, limit: int = 8) -> DataFrame:
        """id, name, score as of `search_satellites`; an id that stands twice is found once. At most twice `limit` rows come to the
        driver from a list."""
        upper, q = raw.strip().upper(), norm_value(raw)
        hits: dict[int, tuple[str, float]] = {}

        def take(rows: list, score) -> None:
            for r in rows:
                if r["id"] not in hits:
                    hits[r["id"]] = (r["name"], score(r))

        if q and self.lengths["size"]:
            # From the highest score down; whoever is found keeps the first.
            nickname = {norm_value(k): v for k, v in vocab.NICKNAMES.items()}.get(q)
            for score, id in ((NICKNAME, nickname), (NUMBER, int(upper) if re.fullmatch(r"[0-9]{1,6}", upper) else None)):
                if id is not None:
                    take(self._table("ids").filter(F.col("id") == id).select("id", "name").limit(limit).collect(), lambda r, s=score: s)
            if self.has("cospars"):
                take(self._table("cospars").filter(F.col("cospar") == upper).orderBy(F.length("name"), "id").select("id", "name").limit(limit).collect(), lambda r: DESIGNATOR)
            names = self._table("names")
            take(names.filter(F.col("upper") == upper).orderBy("length", "id").select("id", "name").limit(limit).collect(), lambda r: WHOLE)
            take(self._shortest(names.filter(F.col("upper").startswith(upper)), limit + len(hits), "size"), lambda r: BEGINNING - min(0.5, r["size"] / 200.0))
            # A part scores less than any beginning: it is looked for only where there is room.
            if len(hits) < limit and len(upper) >= GRAM and (rows := self.parts(upper)) is not None:
                take(self._shortest(rows, limit + len(hits), "length"), lambda r: PART)
        best = sorted(((i, n, s) for i, (n, s) in hits.items()), key=lambda h: (-h[2], len(h[1]), h[0]))[:limit]
        return self.spark.createDataFrame(best, _HIT)

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def groups(self, raw: str, limit: int = 12) -> DataFrame:
        return search.rank_entries(self._table("entries"), raw, limit)

    def search(self, raw: str, limit: int = 12) -> DataFrame:
        """rank, kind, key, title, count and score as of `search.search`."""
        return search.merge(self.groups(raw, limit), self.satellites(raw), limit)
