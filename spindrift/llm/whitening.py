"""Embedding whitening: Spark MLlib's RowMatrix over exactly centred rows, a local eigendecomposition, a broadcast matrix.

An entry c counts as the whole number y = floor(SCALE * c), so that sums and centring are exact: with the sum S = q * n + r of a
dimension, y - S/n is (y - q) - r/n, a whole number less a fraction. `computeGramianMatrix` of the centred rows over n is the
covariance; its unit eigenvectors over the roots of their eigenvalues whiten a row, batch by batch in `mapInPandas`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructType

from .common import fresh

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Whole numbers are held within plus and minus this, so that a double has each of them exactly.
LARGEST = 2**52
#: An eigenvalue under this share of their sum is no component: there is nothing to scale.
LEAST_SHARE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n rows; q and r: whole parts and remainders of the sums over n; columns of `matrix` whiten; eigenvalues fall."""

    n: int
    q: np.ndarray
    r: np.ndarray
    matrix: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (y - self.q) - self.r / self.n

    def deviation(self, y: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * y - S)^2, exactly, of any size."""
        part = (y - self.q).astype(np.int64)
        if self.n * (float(np.abs(part).max(initial=0)) + 1) * np.sqrt(max(y.shape[1], 1)) < 2**31:  # squares and their sum stay within 63 bits
            return ((self.n * part - self.r) ** 2).sum(axis=1).tolist()
        return [sum((self.n * a - b) ** 2 for a, b in zip(row, self.r.tolist())) for row in part.tolist()]


def whole_numbers(vectors: DataFrame, vector: str, out: str, scale: int = SCALE) -> DataFrame:
    """`vectors` with the column `out`, array<long>: floor(scale * c) of each entry, held within LARGEST.

    Rows whose vector is null or holds a null, a NaN or an infinity go. Of vectors of several lengths those of the commonest
    stay (ties: the greater length).
    """
    v = F.col(f"`{vector}`")
    sound = vectors.filter(v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))))
    lengths = sound.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    sound = sound.filter(F.size(v) == (lengths[0]["d"] if lengths else 0))
    held = lambda c: F.least(F.greatest(F.lit(float(scale)) * c.cast("double"), F.lit(float(-LARGEST))), F.lit(float(LARGEST)))
    return sound.withColumn(out, F.transform(v, lambda c: F.floor(held(c))))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per task: how many vectors, and their exact sums (whole numbers of any size) as text."""
    n, total = 0, None
    for batch in batches:
        y = np.stack(batch["y"].to_numpy()) if len(batch) else np.zeros((0, 0), np.int64)
        if len(y):
            # Halves of 26 bits: sums of a batch stay within 63 bits.
            part = [(int(a) << 26) + int(b) for a, b in zip((y >> 26).sum(axis=0), (y & (2**26 - 1)).sum(axis=0))]
            n, total = n + len(y), part if total is None else [a + b for a, b in zip(total, part)]
    if n:
        yield pd.DataFrame({"n": [n], "sums": [[str(x) for x in total]]})


def fit(whole: DataFrame, y: str, components: int = COMPONENTS) -> Whitening:
    """From the column `y` (array<long>, all of one length): exact sums, the covariance of centred rows, its eigenvectors.

    To the driver come one row per dimension and the covariance. Without rows, or without variance, there are no components.
    """
    rows = whole.select(F.col(f"`{y}`").alias("y"))
    parts = rows.mapInPandas(_sums, "n long, sums array<string>").select("n", F.posexplode("sums").alias("i", "s"))
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    n, sums = (int(got[0]["n"]), [int(g["s"]) for g in got]) if got else (0, [])
    q, r = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    if not sums:
        return Whitening(n, q, r, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    whole_part, fraction = F.array(*[F.lit(x).cast("long") for x in q.tolist()]), F.array(*[F.lit(x) for x in (r / n).tolist()])
    centred = F.transform("y", lambda v, i: (v - F.get(whole_part, i)).cast("double") - F.get(fraction, i))
    frame = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("v")), "v")
    covariance = RowMatrix(frame, n, len(sums)).computeGramianMatrix().toArray() / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    kept = int((values[:components] > LEAST_SHARE * trace).sum()) if trace > 0 else 0
    return Whitening(n, q, r, vectors[:, :kept] / np.sqrt(values[:kept]), values[:kept], trace)


def whiten(whole: DataFrame, y: str, model: Whitening, whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """`whole` with `whitened` (array<double>, an entry per component) and `deviation` (decimal: sum of (n * y - S)^2)."""
    shared = whole.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        model = shared.value
        for batch in batches:
            if len(batch):
                m = np.stack(batch[y].to_numpy())
                exact = [d if d < 10**38 else None for d in model.deviation(m)]
                batch = batch.assign(**{whitened: list(model.centred(m) @ model.matrix), deviation: [None if d is None else Decimal(d) for d in exact]})
                yield batch

    return whole.mapInPandas(apply, StructType([*whole.schema.fields]).add(whitened, ArrayType(DoubleType())).add(deviation, DecimalType(38, 0)))


def identity_error(whole: DataFrame, y: str, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity; 0 without components.

    A task adds up its rows' products; per pair of components one row is left.
    """
    shared = whole.sparkSession.sparkContext.broadcast(model)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, total = shared.value, 0.0
        for batch in batches:
            if len(batch):
                w = model.centred(np.stack(batch["y"].to_numpy())) @ model.matrix
                total = total + w.T @ w
        if not np.isscalar(total):
            yield pd.DataFrame({"g": [total.ravel()]})

    k = len(model.eigenvalues)
    sums = whole.select(F.col(f"`{y}`").alias("y")).mapInPandas(products, "g array<double>").select(F.posexplode("g").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g"))
    same = (F.col("i") % (k + 1) == 0).cast("double") if k else F.lit(0.0)
    return float(sums.agg(F.coalesce(F.max(F.abs(F.col("g") / max(model.n, 1) - same)), F.lit(0.0))).first()[0])


def whiten_embeddings(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening, float]:
    """The rows of `vectors` that take part (see `whole_numbers`) with `whitened` and `deviation`, the model, and its error.

    Every row that takes part is fitted on. Repeated rows count as often as they are there and have a row each; ids may be null
    or repeat; other columns pass through, but any named whitened or deviation are replaced. Entries beyond LARGEST / SCALE
    count as that; a deviation of over 38 digits is null. Components without variance are left out: an empty table, equal
    rows, or vectors without entries have none.
    """
    names = [c for c in vectors.columns if c.lower() not in ("whitened", "deviation")]
    (y,) = fresh(vectors.select(*[F.col(f"`{c}`") for c in names]), "y")
    whole = whole_numbers(vectors.select(*[F.col(f"`{c}`") for c in names]), vector, y)
    model = fit(whole, y, components)
    error = identity_error(whole, y, model)
    return whiten(whole, y, model).drop(y), model, error


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found, model, error = whiten_embeddings(vectors)
    share = F.lit((model.eigenvalues / model.trace).tolist() if len(model.eigenvalues) else [0.0])
    # The offset of the contract's numbers adds the same to a row and to the mean, so it changes none of these.
    return found.select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("i") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )
