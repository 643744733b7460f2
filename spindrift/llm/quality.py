"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics describe form (lengths, case, symbols, repetition), never the label, language, source or id. Training takes
a sample of labelled documents of a fixed size, bins every statistic at quantiles, and grows complete trees from
histograms of gradients. The trees are laid out in flat arrays; a batch of documents walks down all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import claim, held_out

#: Labelled documents that a model is fitted on at most: those whose ids have the smallest hashes.
TRAIN_ROWS = 20_000
ROUNDS, DEPTH, BINS, RATE, L2, LEAF_WEIGHT = 120, 4, 64, 0.1, 1.0, 2.0
#: From this score on a document is kept.
KEEP_FROM = 0.7
FEATURES = 18
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SPACE, _WIDE = b" \t\n\r\x0b\x0c", bytes(range(128, 256))
_STOPS, _BARS = b".,;:?!'\"()-", b"|<>{}[]#*%$&@=_~^\\/"


def statistics(text: str | None) -> list[float]:
    """The FEATURES numbers of one whole text; a null text is empty."""
    b = (text or "").encode("utf-8", "replace")
    n = len(b)
    count = lambda kind: n - len(b.translate(None, kind))
    upper, lower, digit, space, wide, stops, bars = map(count, (_UPPER, _LOWER, _DIGIT, _SPACE, _WIDE, _STOPS, _BARS))
    words = b.split()
    m = len(words)
    sizes = np.fromiter(map(len, words), np.float64, m)
    ends = bytes([w[-1] for w in words])
    distinct = len(set(words))
    triples = len(set(zip(words, words[1:], words[2:])))
    lines = [x for x in b.split(b"\n") if x.strip()]
    letters = upper + lower + wide
    odd_ends = m - len(ends.translate(None, _BARS + b"!"))
    per = lambda x, of: x / of if of else 0.0
    return [
        np.log1p(n), np.log1p(m), float(sizes.mean()) if m else 0.0, float(sizes.std()) if m else 0.0, float(sizes.max()) if m else 0.0,
        per(upper, letters), per(letters, n), per(digit, n), per(space, n), per(stops, n), per(bars, n), per(b.count(b"!"), m),
        per(distinct, m), per(triples, m - 2) if m > 2 else 1.0, per(odd_ends, m), per(len(set(lines)), len(lines)), per(n, len(lines)), np.log1p(len(lines)),
    ]


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: node k of a tree has the children 2k + 1 and 2k + 2; a row goes right if above the cut."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            margin += leaf[node - inner] if len(x) else 0.0
        return 1.0 / (1.0 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees for rows `x` and 0/1 labels `y`; without two kinds of label, the score is constant (0.5 without any)."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    if len(set(y.tolist())) < 2:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # bin <= b: value <= cut b
    features, thresholds, values = [], [], []
    margin = np.full(len(y), base)
    for _ in range(ROUNDS):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            at = node - first
            best = np.full(width, 1e-9)
            split = np.full(width, -1)
            for f, c in enumerate(cuts):
                cell, size = at * BINS + binned[:, f], width * BINS
                gl = np.bincount(cell, g, size).reshape(width, BINS).cumsum(1)
                hl = np.bincount(cell, h, size).reshape(width, BINS).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(hl < LEAF_WEIGHT) | (ht - hl < LEAF_WEIGHT)] = 0.0
                gain = gain[:, : len(c)]
                if not len(c):
                    continue
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for i in np.flatnonzero(top > best):
                    best[i], split[i] = top[i], k[i]
                    feature[first + i], cut[first + i] = f, c[k[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        value = -RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + L2)
        margin += value[at]
        features.append(feature)
        thresholds.append(cut)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base)


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("quality")
    for batch in batches:
        rows = [statistics(x.as_py()) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "quality"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text") -> Forest:
    """Fit on at most `rows` labelled documents that are not held out. 

    A document with several labels counts with the lowest, one with several rows once. Ties between ids go by the smaller
    one. Null texts are empty. Without labels, or for an empty table, the model's score is constant.
    """
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # At most `rows` rows of two numbers: small enough to broadcast, whatever the corpus.
    found = docs.select("doc_id", text).join(F.broadcast(sample), "doc_id").select("doc_id", text, "quality")
    # Of rows that repeat an id, the one whose text has the smallest hash: at most `rows` rows come out.
    one = found.groupBy("doc_id").agg(F.min_by(F.struct(F.col(f"`{text}`").alias("text"), "quality"), F.xxhash64(text)).alias("r")).select("r.text", "r.quality")
    got = one.mapInArrow(_statistics_of, "x array<double>, quality double").toPandas()
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, FEATURES)
    order = np.lexsort((got["quality"].to_numpy(), *x.T)) if len(got) else slice(0)  # rows come in no fixed order
    return fit(x[order], got["quality"].to_numpy(dtype=np.float64)[order])


def score_documents(docs: DataFrame, forest: Forest, text: str = "text", score: str = "score") -> DataFrame:
    """`docs` with a column `score` (0 to 1; higher: better), replacing one of that name.

    Null and empty texts get a score too, and texts of any length count whole. Equal texts have equal scores. Rows come out
    as often as they went in; an empty table gives an empty one.
    """
    names = [c for c in docs.columns if c.lower() != score.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    at = names.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        forest = shared.value
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(at)], dtype=np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x))], [*names, score])

    out = docs.select(*[F.col(f"`{c}`") for c in names])
    return out.mapInArrow(judge, StructType([*out.schema.fields]).add(score, DoubleType()))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # The text is needed in the map only; what comes out of it is narrow.
    return (
        score_documents(docs, forest).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
        .withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))
    )
