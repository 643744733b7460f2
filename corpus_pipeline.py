"""The corpus pipeline: quality classifier, line dedup, near-dedup, PII surrogates, best-fit packing.

Each stage takes all that the one before kept. The classifier drops what it rejects; line dedup takes superfluous lines
out of the texts, and a document that has lost all that it had goes; near-dedup keeps one document of each group; PII
replaces entities in the texts; packing lays the rest out in sequences. Up to PII the columns are those of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import line_dedup, near_dedup, packing, pii, quality
from spindrift.llm.common import fresh, stash

#: Documents whose five-word shingles are this similar (in hundredths) are near copies.
NEAR_PERCENT = 80
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`docs` with n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


# Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables; an empty table gives an
# empty one. All but the last return the columns that they were given, whatever their names.


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of KEEP_FROM or more; the model learns from labelled ones of this input.

    Null and empty texts have a score like any other. Equal texts, so repeated rows too, go or stay together.
    """
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "score")
    return quality.score_documents(docs, forest, score=score).filter(F.col(score) >= quality.KEEP_FROM).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without superfluous lines. A document goes if it lost lines and has no word left.

    Null texts, and texts that were empty before, stay. Repeated rows lose the same lines each.
    """
    (removed,) = fresh(docs, "removed")
    out = line_dedup.dedup_lines(docs, count=removed)
    return _recounted(out.filter((F.col(removed) == 0) | F.col("text").rlike(r"\S")), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, once.

    Documents without words, and rows without an id, are near copies of nothing and stay; of rows that repeat an id, one stays.
    """
    (own,) = fresh(docs, "own")
    judged = near_dedup.link_documents(docs, percent=NEAR_PERCENT).filter("kept").select(F.col("doc_id").alias(own)).distinct()
    kept = docs.join(judged, docs["doc_id"].eqNullSafe(F.col(own)), "left_semi")
    if not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").head(1):
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets, by the key `spindrift.pii.key` (none: one is drawn).

    No row goes; null texts stay null; equal texts, so repeated rows too, stay equal.
    """
    return _recounted(pii.replace_pii(docs, spark.conf.get("spindrift.pii.key", None)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a sequence; a null or empty text is one piece of its end token.

    Long texts are cut into pieces; repeated rows have pieces each; columns beside doc_id and text are left out.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("pii", replace_private),
    ("packing", pack),
]

#: Scores of trees, tokens and keyed surrogates are beyond SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each stage's output is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stash(docs) if i < len(STAGES) - 1 else docs
    return docs
