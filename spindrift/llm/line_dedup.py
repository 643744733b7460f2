"""Line dedup by a deletion-neighbourhood join: of lines that are equal or one edit apart, the earliest stays.

Lines are compared in a normal form (lower case, single blanks). Two of them are one edit (a character put in, left out or
changed) apart if one variant of both is equal: the line without its i-th character, or the line parted before it. Each
variant is a hashed key, and those equal keys are joined. As a line has as many variants as characters, only the part of
it that can differ is varied: a line is cut in four, each part is left out in turn, and the rest is a key; where no other
line has a key, no line differs in that part alone. This is done twice, so that a part is a sixteenth of its line, and
more often for lines of which a sixteenth is still long.

The texts are split once: hashes and keys of all lines make a stored table that holds no text, and the few lines that
share a key are read again. All steps are aggregations by hashed keys with partial sums before the shuffle, so a line
which a third of all documents hold costs no task more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stash

#: Lines whose normal form has fewer characters always stay, if nothing else is asked for. Parts that are longer than the
#: second number are cut again.
SHORTEST, LONGEST_PART = 20, 25_000
#: Keys that a broadcast takes at most (8 bytes each); with more, the same join shuffles.
BROADCAST_KEYS = 500_000
_PLACES = 10**10


def normal_form(text: Column) -> Column:
    """Lines in lower case with single blanks; of a whole text at once, but for blanks at the ends of its lines."""
    # Most texts have no blanks to join, and a search for them costs less than a pattern.
    odd = F.contains(text, F.lit("  "))
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains(text, F.lit(c))
    return F.lower(F.when(odd, F.regexp_replace(text, r"[ \t\r\x0B\x0C]+", " ")).otherwise(text))


def _lines(docs: DataFrame, text: str, shortest: int) -> DataFrame:
    """Lines to judge: doc_id, line (its number), norm, n (its length), h and c (hashes), and at (the order of places; no id
    comes last)."""
    # What is generated is a column: neither the form nor its length is computed again by filters and projections above.
    forms = F.transform(F.split(normal_form(F.col(f"`{text}`")), "\n", -1), lambda x: F.struct(F.trim(x).alias("norm"), F.length(F.trim(x)).alias("n")))
    each = docs.select("doc_id", F.posexplode(forms).alias("line", "l")).filter(F.col("l.n") >= shortest)
    place = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)")) * F.lit(_PLACES).cast("decimal(11,0)") + F.col("line").cast("decimal(10,0)")
    norm = F.col("l.norm")
    return each.select("doc_id", "line", norm.alias("norm"), F.col("l.n").alias("n"), F.xxhash64(norm).alias("h"), F.crc32(norm).alias("c"), place.cast("decimal(32,0)").alias("at"))


def _keyed(lines: DataFrame) -> DataFrame:
    """`lines` with keys, the hashes of a line without each of its parts as `_parts` cuts it, from hashes of its quarters.

    A line whose length is one of two comes twice, the second time with main = false.
    """
    norm, n, base = F.col("norm"), F.col("n"), F.col("base")
    bases = F.when((n % 8 == 0) & (n > 0), F.array(n, n - 8)).otherwise(F.array(n - n % 8))
    w = F.floor(base / 4).cast("int")
    left = lambda k: F.xxhash64(F.substring(norm, k * w + 1, w))
    right = lambda k: F.xxhash64(F.substring(norm, n - k * w + 1, w))
    rests = ([right(3), right(2), right(1)], [left(0), right(2), right(1)], [left(0), left(1), right(1)], [left(0), left(1), left(2)])
    keys = F.array(*[F.xxhash64(base, F.lit(i), *rest) for i, rest in enumerate(rests)])
    return lines.select("*", F.posexplode(bases).alias("nth", "base")).select(*[c for c in lines.columns if c not in ("norm", "n")], (F.col("nth") == 0).alias("main"), keys.alias("keys"))


def _parts(rows: DataFrame) -> DataFrame:
    """Each text (columns key, h, at, norm, n) without each of its parts: key is that of the rest, norm the part.

    Lengths are rounded down to eights; a text whose length is one counts with the eight below too, as the text that has
    one character less does. So both texts of a pair are cut at the same places.
    """
    n, w, part = F.col("n"), F.col("cut.w"), F.col("cut.part")
    of = lambda base: F.transform(F.when(base > 0, F.array(*[F.lit(i) for i in range(4)])).otherwise(F.array(F.lit(0))), lambda i: F.struct(base.alias("base"), i.alias("part"), F.floor(base / 4).cast("int").alias("w")))
    cuts = F.when((n % 8 == 0) & (n > 0), F.concat(of(n), of(n - 8))).otherwise(of(n - n % 8))
    cut = rows.withColumn("cut", F.explode(cuts))
    before, after = part * w, F.when(F.col("cut.base") > 0, (3 - part) * w).otherwise(0)
    rest = F.xxhash64("key", "cut.base", "cut.part", F.substring("norm", F.lit(1), before), F.substring("norm", n - after + 1, after))
    size = n - before - after
    return cut.select(rest.alias("key"), "h", "at", F.substring("norm", before + 1, size).alias("norm"), size.alias("n"))


def _shared(parts: DataFrame) -> DataFrame:
    """Keys that different lines have."""
    return parts.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("key")


def _earliest(rows: DataFrame) -> DataFrame:
    """One row per key and line, at its earliest place."""
    return rows.groupBy("key", "h").agg(F.min("at").alias("at"), F.min("norm").alias("norm"), F.min("n").alias("n"))


def near_lines(lines: DataFrame) -> DataFrame:
    """Hashes h of the lines (columns h, at, norm and n; distinct) that are one edit from another one with an earlier place."""
    parts = _parts(lines.select(F.lit(0).cast("long").alias("key"), "h", "at", "norm", "n"))
    first = stash(_earliest(parts.join(_shared(parts), "key")))
    rows, long = first.filter(F.col("n") <= LONGEST_PART), first
    while (long.agg(F.max("n")).first()[0] or 0) > LONGEST_PART:
        # Both parts of a pair go the same way, as a part of just that length goes both ways.
        cut = _parts(long.filter(F.col("n") >= LONGEST_PART))
        long = stash(_earliest(cut.join(_shared(cut), "key")))
        rows = rows.unionByName(long.filter(F.col("n") <= LONGEST_PART))
    again = _parts(rows)
    second = stash(_earliest(again.join(_shared(again), "key")))
    n = F.col("n")
    left = lambda i: F.substring("norm", F.lit(1), i)
    without = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64("key", left(i), F.substring("norm", i + 2, n)))
    parted = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64("key", left(i), F.substring("norm", i + 1, n)))
    variants = second.withColumn("variant", F.explode(F.array_distinct(F.when(n > 0, F.concat(without, parted)).otherwise(parted))))
    found = variants.groupBy("variant").agg(F.min(F.struct("at", "h", "key", "norm")).alias("first"), F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("variant", "first")
    pairs = variants.join(found, "variant").filter("at > first.at and h <> first.h and key = first.key")
    return pairs.filter(F.levenshtein("norm", "first.norm", 1) >= 0).select("h").distinct()


def _candidates(docs: DataFrame, text: str, shortest: int, keyed: DataFrame, distinct: DataFrame) -> DataFrame:
    """The lines that share a key with another line, each once, at its earliest place; with their text."""
    rows = keyed.select("h", F.explode("keys").alias("key"))
    keys = _checked(stash(_shared(rows)))
    places = stash(distinct.join(rows.join(keys, "key").select("h").distinct(), "h").select("h", F.col("first").alias("at"), "doc_id"))
    # A hash stands for an id, as ids may be null; the join by places leaves no other document's lines.
    ids = _checked(stash(places.select(F.xxhash64("doc_id").alias("id")).distinct()))
    own = docs.join(ids, F.xxhash64("doc_id") == F.col("id"), "left_semi")
    return stash(_lines(own, text, shortest).join(places.select("h", "at"), ["h", "at"]).select("h", "at", "norm", "n").dropDuplicates(["h"]))


def _checked(keys: DataFrame) -> DataFrame:
    """Stored keys, to be broadcast if they are few enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def removed_lines(docs: DataFrame, text: str = "text", near: bool = True, shortest: int = SHORTEST) -> DataFrame:
    """doc_id and lines (numbers, from 0) that an earlier equal or near line makes superfluous; only documents with some.

    Earlier: by doc_id (none: last), then line number. A line goes if any earlier one is within the bound, whether that
    one stays or not. Rows that share a doc_id count as one document: at the same number, equal lines are one line.
    Lines of any length are judged, those of fewer than `shortest` characters aside.
    """
    docs, text = docs.select("doc_id", F.col(f"`{text}`").alias("text")), "text"
    lines = _lines(docs, text, shortest)
    keyed = stash(_keyed(lines) if near else lines.drop("norm", "n"))
    table = keyed.filter("main") if near else keyed
    distinct = table.groupBy("h", "c").agg(F.min("at").alias("first"), F.min_by("doc_id", "at").alias("doc_id"), F.count("*").alias("times"))
    if near:
        distinct = stash(distinct)
        distinct = distinct.join(near_lines(_candidates(docs, text, shortest, keyed, distinct)).withColumn("near", F.lit(True)), "h", "left")
    else:
        distinct = distinct.withColumn("near", F.lit(None).cast("boolean"))
    known = stash(distinct.filter("times > 1 or near").select("h", "c", "first", "near"))
    # A line may have a third of all places: an equi-join of two exchanges, which adaptive execution splits.
    gone = table.select("doc_id", "line", "h", "c", "at").join(known, ["h", "c"]).filter("near or at > first")
    return gone.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, text: str = "text", near: bool = True, count: str | None = None, shortest: int = SHORTEST) -> DataFrame:
    """`docs` without superfluous lines in `text`; all other lines stay as they are, in order. No row goes.

    count: name of a column for the number of lines that went; it replaces one of that name. shortest: lines whose normal
    form has fewer characters, blank ones too, always stay. Null texts stay null, and a text that loses all lines is empty.
    A document may be one very long line. Repeated rows lose the same lines each; a null doc_id comes last. Other columns,
    whatever their names, stay as they are. An empty table gives an empty one.
    """
    own, gone_lines, kept_lines = fresh(docs, "id", "gone", "kept")
    gone = removed_lines(docs, text, near, shortest).select(F.col("doc_id").alias(own), F.col("lines").alias(gone_lines))
    out = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(own)), "left")
    lines = F.split(f"`{text}`", "\n", -1)
    # Rows that share an id may differ: from each go only lines that it has and that are long enough.
    kept = F.filter(lines, lambda x, i: ~(F.array_contains(gone_lines, i) & (F.length(F.trim(normal_form(x))) >= shortest)))
    out = out.withColumn(kept_lines, F.when(F.col(gone_lines).isNotNull(), kept))
    removed = F.coalesce(F.size(lines) - F.size(kept_lines), F.lit(0)).cast("long")
    new = F.when(F.col(kept_lines).isNotNull(), F.array_join(kept_lines, "\n")).otherwise(F.col(f"`{text}`"))
    return out.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != count], *([removed.alias(count)] if count else []))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), count="n_removed")


ORACLE_SQL = r"""
with s as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
e as (select doc_id, unnest(lines) as raw, generate_subscripts(lines, 1) as line from s),
l as (select *, trim(lower(regexp_replace(raw, '[ \t\r\x0B\x0C]+', ' ', 'g')), ' ') as norm from e),
d as (select norm, min((doc_id, line)) as first from l where length(norm) >= 20 group by norm),
n as (
  select distinct a.norm from d a join d b
  on abs(length(a.norm) - length(b.norm)) <= 1 and a.norm <> b.norm and b.first < a.first and levenshtein(a.norm, b.norm) <= 1),
j as (
  select l.doc_id, l.line, l.raw, length(l.norm) >= 20 and ((l.doc_id, l.line) > d.first or n.norm is not null) as gone
  from l left join d on d.norm = l.norm left join n on n.norm = l.norm)
select doc_id, case when count(*) filter (where gone) = count(*) then '' else string_agg(raw, chr(10) order by line) filter (where not coalesce(gone, false)) end as text,
  count(*) filter (where gone) as n_removed
from j group by doc_id
union all select doc_id, null, 0 from documents where text is null
"""
