"""Toxicity by multiple-instance learning: sentence scores combined by a noisy-or, trained from document labels alone.

A sentence has the score s(z), z = bias + the weights of its distinct telling terms (words and their beginnings); without
any it has the score 0, so that length alone makes no document toxic. A document is toxic unless it is clean for all else and
all its sentences are: score = 1 - (1 - leak) * product of (1 - sentence score). The leak takes up labels that no sentence
explains. As only the product has a label, the gradient finds out which sentences bear the blame; `locate` gives them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import held_out, stash

#: Labelled documents that a model is fitted on at most: those whose ids have the smallest hashes.
TRAIN_ROWS = 20_000
#: Terms of a model at most, the most telling ones; log-likelihood ratio and documents that a term needs.
TERMS, RATIO, SEEN = 5_000, 12.0, 3
STEPS, RATE, L2 = 600, 0.05, 0.1
#: Share of terms that each step of the first half leaves out, so that a term has to tell even where others beside it would.
LEFT_OUT = 0.5
#: From this score on a document, or a sentence, counts as toxic.
TOXIC_FROM = 0.3
#: Words whose terms a task remembers at most before it starts anew.
MEMO = 200_000
_SENTENCE = re.compile(r"(?:[^.!?\n]|[.!?](?![\s.!?]|\Z))+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")


def spans(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence: it ends at a line break, or at marks that a blank or the end follows."""
    return [m.span() for m in _SENTENCE.finditer(text or "")]


def terms_of(word: str) -> list[str]:
    """A word's terms: itself, and its beginnings of 3 to 9 letters."""
    return ["=" + word, *("^" + word[:k] for k in range(3, min(10, len(word))))]


@dataclass(frozen=True)
class Model:
    index: dict[str, int]
    weight: np.ndarray
    bias: float
    leak: float  # minus the logarithm of the probability that a document is clean for all but its sentences

    def reader(self):
        """A function from a text to its sentences' spans and scores, and the document's score."""
        memo: dict[str, tuple[int, ...]] = {}
        index, weight, bias, leak = self.index, self.weight.tolist(), self.bias, self.leak

        def known(word: str) -> tuple[int, ...]:
            if len(memo) > MEMO:
                memo.clear()
            out = memo[word] = tuple(index[t] for t in terms_of(word) if t in index)
            return out

        def read(text: str | None) -> tuple[list[tuple[int, int]], np.ndarray, float]:
            where, z = spans(text), []
            for a, b in where:
                found: set[int] = set()
                for w in set(_WORD.findall(text[a:b].lower())):
                    found.update(memo[w] if w in memo else known(w))
                z.append(bias + sum(weight[j] for j in found) if found else -np.inf)
            heat = np.logaddexp(0.0, np.array(z))
            return where, -np.expm1(-heat), float(-np.expm1(-(leak + heat.sum())))

        return read


def fit(index: dict[str, int], y: np.ndarray, document: np.ndarray, times: np.ndarray, bag: np.ndarray, term: np.ndarray, start: np.ndarray) -> Model:
    """Weights by gradient descent (Adam) on the noisy-or's likelihood, with terms left out at random (seeded).

    y: 0/1 per document. Instances are sentences of one document with the same terms, some: `document` and `times` (how many).
    bag, term: pairs of an instance and one of its terms. start: first weights. Without both labels the score is constant.
    """
    mean = (y.sum() + 0.5) / (len(y) + 1)
    if len(set(y.tolist())) < 2:
        return Model({}, np.zeros(0), -40.0, float(-np.log1p(-mean)))
    size = len(start)
    theta = np.concatenate([start, [-6.0, np.log(np.expm1(0.02))]])
    m, v = np.zeros(size + 2), np.zeros(size + 2)
    random = np.random.default_rng(1)
    for step in range(1, STEPS + 1):
        here = random.random(size) >= (LEFT_OUT if step <= STEPS // 2 else 0.0)
        w, bias, raw = theta[:size] * here, theta[size], theta[size + 1]
        z = bias + np.bincount(bag, w[term], len(times))
        heat = np.logaddexp(0.0, raw) + np.bincount(document, times * np.logaddexp(0.0, z), len(y))
        # Of a clean document the loss is its heat, of a toxic one -log(1 - exp(-heat)).
        pull = np.where(y > 0, -1.0 / np.expm1(np.clip(heat, 1e-9, 500.0)), 1.0)
        dz = pull[document] * times / (1.0 + np.exp(-z))
        grad = np.concatenate([np.bincount(term, dz[bag], size) * here + L2 * theta[:size], [dz.sum(), pull.sum() / (1.0 + np.exp(-raw))]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(index, theta[:size], float(theta[size]), float(np.logaddexp(0.0, theta[size + 1])))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and term, the documents with it: all, and toxic ones."""
    for batch in batches:
        every, toxic = Counter(), Counter()
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            found = {t for w in set(_WORD.findall((text.as_py() or "").lower())) for t in terms_of(w)}
            every.update(found)
            if label:
                toxic.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([toxic[t] for t in every], pa.int64())], ["term", "n", "hot"])


def telling_terms(sample: DataFrame, clean: int, toxic: int, terms: int = TERMS) -> list[tuple[str, float]]:
    """The terms that tell most for toxicity, with their log odds: at most `terms`, by log-likelihood ratio, then text."""
    a, b = F.col("hot").cast("double"), (F.col("n") - F.col("hot")).cast("double")
    all_a, all_b = F.lit(float(toxic)), F.lit(float(clean))
    share = (a + b) / (all_a + all_b)
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    ratio = 2 * (part(a, all_a * share) + part(b, all_b * share) + part(all_a - a, all_a * (1 - share)) + part(all_b - b, all_b * (1 - share)))
    odds = F.log((a + 0.5) / (all_a - a + 0.5)) - F.log((b + 0.5) / (all_b - b + 0.5))
    counts = sample.mapInArrow(_counted, "term string, n long, hot long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("hot").alias("hot"))
    best = counts.filter(F.col("n") >= SEEN).select("term", ratio.alias("ratio"), odds.alias("odds")).filter((F.col("ratio") >= RATIO) & (F.col("odds") > 0))
    return [(r["term"], r["odds"]) for r in best.orderBy(F.desc("ratio"), "term").limit(terms).collect()]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text") -> Model:
    """Fit on at most `rows` labelled documents that are not held out.

    A document with several labels counts as toxic if one says so, one with several rows once (the text with the smallest
    hash). Null texts are empty. Without labels, or for an empty table, the model's score is constant.
    """
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "doc_id")
    # At most `rows` rows: read twice, for the terms and for the sentences.
    one = stash(found.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("r")).select("r.text", (F.col("r.toxic") > 0).cast("int").alias("toxic"), "doc_id"))
    clean, toxic = one.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    terms = telling_terms(one, clean, toxic) if clean and toxic else []
    index = {t: j for j, (t, _) in enumerate(terms)}
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            out = []
            for text in batch.column(0):
                text = text.as_py() or ""
                bags = (tuple(sorted({index[t] for w in set(_WORD.findall(text[a:b].lower())) for t in terms_of(w) if t in index})) for a, b in spans(text))
                out.append(Counter(filter(None, bags)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([list(x) for x in out], pa.list_(pa.list_(pa.int32()))), pa.array([list(x.values()) for x in out], pa.list_(pa.int64()))], ["toxic", "doc_id", "bags", "times"])

    # What comes to the driver: at most `rows` documents, each as its distinct sets of at most `TERMS` numbers.
    got = one.mapInArrow(encode, "toxic int, doc_id long, bags array<array<int>>, times array<long>").orderBy("doc_id").toPandas()
    y = got["toxic"].to_numpy(dtype=np.float64)
    each = [(d, n, b) for d, (bs, ns) in enumerate(zip(got["bags"], got["times"])) for b, n in zip(bs, ns)]
    document, times = np.array([d for d, _, _ in each], np.int64), np.array([n for _, n, _ in each], np.float64)
    bag = np.repeat(np.arange(len(each)), [len(b) for _, _, b in each]) if each else np.zeros(0, np.int64)
    term = np.concatenate([np.asarray(b, np.int64) for _, _, b in each]) if each else np.zeros(0, np.int64)
    return fit(index, y, document, times, bag, term, np.clip(np.array([o for _, o in terms], np.float64), 0.0, 3.0))


OFFENCE = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("score", DoubleType())])


def score_documents(docs: DataFrame, model: Model, text: str = "text", score: str = "score", offences: str = "offences", at_least: float = TOXIC_FROM) -> DataFrame:
    """`docs` with the columns `score` (0 to 1; higher: more likely toxic) and `offences`, replacing any of those names.

    offences: array of (start, length, score), one per sentence of a score of `at_least` or more, in their order; start counts
    characters from 0. Null and empty texts have no sentence and the score of the leak alone. Texts of any length count
    whole; repeated rows each have a row; equal texts have equal scores. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c.lower() not in (score.lower(), offences.lower())]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.reader()
        for batch in batches:
            scores, found = [], []
            for value in batch.column(at):
                where, each, whole = read(value.as_py())
                scores.append(whole)
                found.append([{"start": where[k][0], "length": where[k][1] - where[k][0], "score": float(each[k])} for k in np.flatnonzero(each >= at_least)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(found, kind)], [*names, score, offences])

    out = docs.select(*[F.col(f"`{c}`") for c in names])
    return out.mapInArrow(judge, StructType([*out.schema.fields]).add(score, DoubleType()).add(offences, ArrayType(OFFENCE)))


def locate(docs: DataFrame, model: Model, at_least: float = TOXIC_FROM) -> DataFrame:
    """A row per offending sentence: doc_id, start, length, score and the sentence itself. Rows as in `score_documents`."""
    found = score_documents(docs.select("doc_id", "text"), model, at_least=at_least)
    return found.select("doc_id", "text", F.explode("offences").alias("o")).select("doc_id", "o.start", "o.length", "o.score", F.substring("text", F.col("o.start").cast("int") + 1, F.col("o.length").cast("int")).alias("sentence"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, with the number of its offending sentences and the place of the first of the worst."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    worst = F.reduce("offences", F.lit(None).cast(OFFENCE), lambda a, o: F.when(a.isNull() | (o["score"] > a["score"]), o).otherwise(a))
    return (
        score_documents(docs, model).withColumn("worst", worst)
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), F.size("offences").cast("long").alias("n_offending"), F.col("worst.start").alias("worst_start"), F.col("worst.length").alias("worst_length"))
    )
