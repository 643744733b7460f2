"""Document fingerprints by SimHash, and all pairs of them within a Hamming radius by permuted block tables.

A document's terms are its pairs of neighbouring words (its one word where it has no pair), weighted by how often they
occur. The hash of each term votes on 64 bits; a bit is set if more than half of the weight votes for it. Votes are summed
two bits to a 64-bit integer, 32 bits apart, by plain sums in an aggregation that meets a document's terms in one task.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, shuffle_width, stash

BITS, HALF = 64, 32
_LANES = (1 << HALF) + 1
#: Sorts before every id; stands for a null one.
_LAST = -(2**63)


def terms(text: Column) -> Column:
    """Hashes of a text's terms, repeated ones as often as they occur; empty for a text without words. A-Z count as a-z."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    pairs = F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(hashes) < 2, hashes).otherwise(pairs)


def votes(term: Column) -> list[Column]:
    """Aggregates: lane i sums the votes for bit i (low half) and bit i + HALF (high half), the last counts the terms."""
    return [F.sum(F.shiftright(term, i).bitwiseAND(F.lit(_LANES))).alias(f"lane{i}") for i in range(HALF)] + [F.count(term).alias("weight")]


def fingerprint() -> Column:
    """64 bits from the columns of `votes`; no bit is set without terms."""
    out = F.lit(0).cast("long")
    for i in range(HALF):
        lane = F.col(f"lane{i}")
        low, high = lane.bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftrightunsigned(lane, HALF)
        for votes_for, bit in ((low, i), (high, i + HALF)):
            out = out.bitwiseOR(F.when(votes_for * 2 > F.col("weight"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return out


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def as_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _ordered(docs: DataFrame, text: str) -> tuple[DataFrame, dict[int, int]]:
    """Rows (bucket, ord, tie, doc_id, text, extra) and the next bucket of each.

    Buckets are ranges of ids. At the end of each, an extra row repeats the first row of the next, so that every row's
    next one lies in its own bucket.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).withColumn("ord", F.coalesce("doc_id", F.lit(_LAST))).withColumn("tie", F.xxhash64("text"))
    width = 4 * shuffle_width(spark)
    cuts = rows.agg(F.percentile_approx("ord", [i / width for i in range(1, width)], 20 * width)).first()[0] or []
    rows = rows.withColumn("bucket", -bucket_of(F.col("ord"), sorted(set(cuts))))  # the largest ids come first
    heads = [tuple(r) for r in rows.groupBy("bucket").agg(F.max(F.struct("ord", "tie")).alias("h")).select("bucket", "h.ord", "h.tie").orderBy("bucket").collect()]  # a row per bucket
    following = {b[0]: heads[(i + 1) % len(heads)] for i, b in enumerate(heads)}
    links = spark.createDataFrame([(b, *h) for b, h in following.items()], "into int, bucket int, ord long, tie long")
    extra = rows.join(F.broadcast(links), ["bucket", "ord", "tie"]).dropDuplicates(["into"])  # links: a row per bucket
    columns = ["bucket", "ord", "tie", "doc_id", "text"]
    extra = extra.select(F.col("into").alias("bucket"), *columns[1:], F.lit(True).alias("extra"))
    return rows.select(*columns, F.lit(False).alias("extra")).unionByName(extra), {b: h[0] for b, h in following.items()}


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many of the next document's text
    (all, if it has fewer), in descending order of doc_id; the first follows the last. A null text is empty. A null
    doc_id comes last. Rows with one doc_id follow each other by the hash of their text; repeated rows are rows of their
    own. The only row of a table is its own next. Other columns are left out.
    """
    rows, following = _ordered(docs, text)
    if not following:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_chars"), *[F.lit("").alias(x) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[F.lit(0.0).alias(x) for x in ("near_edited", "near_next")]).limit(0)
    order = Window.partitionBy("bucket").orderBy("extra", F.desc("ord"), F.desc("tie"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut))
    texts = (
        rows.withColumns({"place": F.row_number().over(order), "next": F.lead("text").over(order)}).filter("not extra")
        .select("bucket", "place", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    )
    by = ["bucket", "place", "doc_id", "n_chars", "edited_sha256"]
    both = texts.withColumn("edited_sha256", F.sha2("edited", 256)).select(*by, F.posexplode(F.array("text", "edited")).alias("which", "t"))
    voted = both.select(*by, "which", F.explode_outer(terms(F.col("t"))).alias("term")).groupBy(*by, "which").agg(*votes(F.col("term")))
    single = voted.select(*by, "which", fingerprint().alias("fp"))
    pairs = stash(single.groupBy(*by).agg(*[F.max(F.when(F.col("which") == k, F.col("fp"))).alias(c) for k, c in enumerate(("fp", "edited_fp"))]))
    heads = {r["bucket"]: r["fp"] for r in pairs.filter("place = 1").select("bucket", "fp").collect()}  # a row per bucket
    after = F.create_map(*[F.lit(x) for b, c in following.items() for x in (b, heads[c])])
    nearby = Window.partitionBy("bucket").orderBy("place")
    return pairs.withColumn("next_fp", F.coalesce(F.lead("fp").over(nearby), after[F.col("bucket")])).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def near_pairs(prints: DataFrame, fp: str = "fp", radius: int = 3) -> DataFrame:
    """All pairs (a < b, distance) of distinct fingerprints (64-bit integers) at most `radius` bits apart, and no others.

    The bits are cut in radius + 2 blocks. Two fingerprints within the radius agree on two blocks at least, so a table for
    every two blocks, keyed by their bits, has each pair; it is taken from the first table that has it.
    """
    distinct = prints.select(F.col(fp).alias("a")).filter("a is not null").distinct()
    blocks = radius + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    tables = [x | y for x, y in combinations(masks, 2)]
    signed = [t - (1 << BITS) if t >> (BITS - 1) else t for t in tables]
    keyed = distinct.select("a", F.posexplode(F.array(*[F.col("a").bitwiseAND(F.lit(t)) for t in signed])).alias("table", "key"))
    other = keyed.select(F.col("a").alias("b"), "table", "key")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    earliest = F.array_position(F.array(*[differ.bitwiseAND(F.lit(t)) == 0 for t in signed]), True) - 1
    return keyed.join(other, ["table", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & (earliest == F.col("table"))).select("a", "b", F.bit_count(differ).alias("distance"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
