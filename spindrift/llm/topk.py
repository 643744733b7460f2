"""Exact top-k search by inner product with two cover trees.

The top of the row tree is dealt out: rows go to the nearest of a number of centres (spread over a bounded sample by taking
the farthest next), and every block's radius is taken over all its rows. A query is first scored in the block of its own
nearest centre; then it goes only to blocks whose bound reaches the k-th score that it has. A task has rows of one block
and queries for it, and builds a cover tree over both: a node covers its points within a radius, and its children cover
them within half of it. From the pairs of nodes, the one with the highest bound on any score between them is opened first;
a pair whose bound is under the worst k-th score in its group of queries is left out with all below it. The k best of each
task meet in a window per query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stash

SCALE, TOP = 1024, 10
#: Components of the rows and of the queries of a task at most (on average), points of a leaf.
ROW_VALUES, QUERY_VALUES, LEAF = 1 << 22, 1 << 19, 48
#: Vectors that centres are chosen from, and centres at most. They decide where rows go, never which rows are searched.
SAMPLE, CENTERS = 4096, 1024


@dataclass
class Node:
    """Points first .. last - 1 of its tree's order; all lie within `radius` of the centre."""

    center: np.ndarray
    radius: float
    first: int
    last: int
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray) -> tuple[Node, np.ndarray]:
    """The root and the order of the points in the tree."""
    order = np.arange(len(points))

    def build(first: int, last: int, center: np.ndarray) -> Node:
        own = order[first:last]
        far = np.sqrt(((points[own] - center) ** 2).sum(1))
        node = Node(center, float(far.max(initial=0.0)), first, last)
        if last - first <= LEAF or node.radius == 0.0:
            return node
        # Centres of the children: points farther than half the radius from those before, the farthest first. Where
        # distances hardly differ, half the radius takes nearly every point; then there are as many as leaves are needed.
        near, child = np.full(len(own), np.inf), np.zeros(len(own), dtype=np.int64)
        centers: list[np.ndarray] = []
        at = int(far.argmin())
        while not centers or (near[at] > node.radius / 2 and len(centers) < max(2, 2 * len(own) // LEAF)):
            centers.append(points[own[at]])
            away = np.sqrt(((points[own] - centers[-1]) ** 2).sum(1))
            closer = away < near
            near[closer], child[closer] = away[closer], len(centers) - 1
            at = int(near.argmax())
        by_child = np.argsort(child, kind="stable")
        order[first:last] = own[by_child]
        ends = first + np.cumsum(np.bincount(child, minlength=len(centers)))
        node.children = [build(a, b, c) for a, b, c in zip([first, *ends[:-1]], ends, centers) if b > a]
        return node

    # A stack as deep as the radius can be halved between two points is needed; floats allow about a thousand halvings.
    return build(0, len(points), points.mean(0)), order


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int = TOP, floors: np.ndarray | None = None, most: int | None = None, counts: dict | None = None) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of the k best rows of each query, ties to the smaller id. Components are integers.

    floors: for each query, a score under which no row is wanted. most: scores that are farther from 0 count as it. counts: gets the number of pairs that were scored.
    """
    if not len(queries) or not len(rows):
        return []
    high = float(np.abs(queries.astype(np.float64)).max()) * float(np.abs(rows.astype(np.float64)).max()) * queries.shape[1]
    exact = np.float64 if high < 2**52 else object  # whole numbers that floats hold exactly, or Python's
    q_root, q_order = cover_tree(queries.astype(np.float64))
    r_root, r_order = cover_tree(rows.astype(np.float64))
    q, r, q_ids, r_ids = queries[q_order].astype(exact), rows[r_order].astype(exact), query_ids[q_order], row_ids[r_order]
    plain = q.astype(np.float64)
    sizes = np.sqrt((plain**2).sum(1))
    best: list[list[tuple[int, int]]] = [[] for _ in q]  # heaps of (score, -row id)
    worst = np.full(len(q), -np.inf) if floors is None else floors[q_order].astype(np.float64)

    def bounds(a: Node, nodes: list[Node], swap: bool) -> list[tuple[float, Node, Node]]:
        c, radius = np.array([n.center for n in nodes]), np.array([n.radius for n in nodes])
        high = c @ a.center + a.radius * np.sqrt((c**2).sum(1)) + radius * np.sqrt((a.center**2).sum()) + radius * a.radius
        high += 1e-9 * (1.0 + np.abs(high))  # rounding never lowers a bound
        return [(h, n, a) if swap else (h, a, n) for h, n in zip(high.tolist(), nodes)]

    heap: list[tuple[float, int, Node, Node]] = []
    count = scored = 0
    for h, a, b in bounds(q_root, [r_root], False):
        heap.append((-h, count, a, b))
    while heap:
        high, _, a, b = heapq.heappop(heap)
        if -high < worst[a.first : a.last].min():
            continue
        if not a.children and not b.children:
            # Each query's own bound, before any of its scores.
            high = plain[a.first : a.last] @ b.center + sizes[a.first : a.last] * b.radius
            asks = a.first + np.flatnonzero(high + 1e-9 * (1.0 + np.abs(high)) >= worst[a.first : a.last])
            scored += len(asks) * (b.last - b.first)
            scores = q[asks] @ r[b.first : b.last].T
            if exact is object and most is not None:
                scores = np.minimum(np.maximum(scores, -most), most)
            # Queries that have fewer than k rows so far have no worst score but their floor.
            for at in np.flatnonzero(scores.max(axis=1) >= worst[asks]) if len(asks) else ():
                i, line = int(asks[at]), scores[at]
                for j in np.flatnonzero(line >= worst[i]):
                    if r_ids[b.first + j] == q_ids[i]:
                        continue
                    entry = (int(line[j]), -int(r_ids[b.first + j]))
                    if len(best[i]) < k:
                        heapq.heappush(best[i], entry)
                    elif entry > best[i][0]:
                        heapq.heapreplace(best[i], entry)
                if len(best[i]) == k:
                    worst[i] = max(worst[i], best[i][0][0])
            continue
        open_rows = bool(b.children) and (not a.children or b.radius >= a.radius)
        for h, x, y in bounds(a, b.children, False) if open_rows else bounds(b, a.children, True):
            if h >= worst[x.first : x.last].min():
                count += 1
                heapq.heappush(heap, (-h, count, x, y))
    if counts is not None:
        counts["scored"] = counts.get("scored", 0) + scored
    return [(int(i), -j, s) for i, found in zip(q_ids, best) for s, j in found]


def quantized(vector: Column) -> Column:
    """floor(SCALE * x) of each component; null where the vector or a component is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long")))


def spread_centers(points: np.ndarray, most: int) -> np.ndarray:
    """At most `most` of the points, each the farthest from those before."""
    if not len(points):
        return points
    found, near = [0], ((points - points[0]) ** 2).sum(1)
    while len(found) < most and near.max() > 0:
        found.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[found[-1]]) ** 2).sum(1))
    return points[found]


def _values(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _dealt(rows: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """`rows` (id, v, dim, is_query) with block, the nearest centre among those of their dimension, and how far it is."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)  # at most CENTERS vectors of each dimension

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for batch in batches:
            dim = batch.column(2).to_numpy()
            block, far = np.zeros(len(dim), np.int32), np.zeros(len(dim))
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = _values(batch.column(1).take(pa.array(at)), len(at)).astype(np.float64)
                c = centers.get(int(d), np.zeros((1, int(d))))
                block[at] = ((c**2).sum(1) - 2 * (x @ c.T)).argmin(1)
                far[at] = np.sqrt(((x - c[block[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block), pa.array(far)], [*batch.schema.names, "block", "far"])

    return rows.mapInArrow(deal, "id long, v array<long>, dim int, is_query boolean, block int, far double")


def _reaching(asked: DataFrame, centers: dict[int, np.ndarray], radii: dict[int, np.ndarray]) -> DataFrame:
    """Of queries (id, v, dim, block, floor), a row for each block but their own whose bound reaches their floor."""
    shared = asked.sparkSession.sparkContext.broadcast((centers, radii))  # at most CENTERS vectors of each dimension

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, radii = shared.value
        for batch in batches:
            dim, own, floor = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            at, to = [], []
            for d in np.unique(dim):
                i = np.flatnonzero(dim == d)
                x = _values(batch.column(1).take(pa.array(i)), len(i)).astype(np.float64)
                c = centers.get(int(d), np.zeros((1, int(d))))
                high = x @ c.T + np.sqrt((x**2).sum(1))[:, None] * radii[int(d)]
                row, block = np.nonzero((high + 1e-9 * (1.0 + np.abs(high)) >= floor[i][:, None]) & (radii[int(d)] >= 0) & (np.arange(len(c)) != own[i][:, None]))
                at.append(i[row])
                to.append(block)
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            for k in range(0, len(at), 4096):  # a query may go to many blocks
                part = batch.take(pa.array(at[k : k + 4096]))
                blocks = pa.array(np.concatenate(to)[k : k + 4096].astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), blocks, part.column(4)], ["id", "v", "dim", "block", "floor"])

    return asked.select("id", "v", "dim", "block", "floor").mapInArrow(reach, "id long, v array<long>, dim int, block int, floor double")


def _task(table: pa.Table, k: int) -> pa.Table:
    queries = table.column("is_query").to_numpy()
    own, given = table.filter(pa.array(queries)), table.filter(pa.array(~queries))
    found = []
    if len(own) and len(given):
        found = search(_values(own.column("v"), len(own)), own.column("id").to_numpy(), _values(given.column("v"), len(given)), given.column("id").to_numpy(), k, own.column("floor").to_numpy(), 2**63 - 1)
    a, b, s = zip(*found) if found else ((), (), ())
    return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.int64())})


def _scored(asked: DataFrame, rows: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The best of each task; queries (id, v, dim, block, floor) meet all rows of their block.

    sizes: dim, block and parts, the number of tasks that the rows of a block are dealt to.
    """
    groups = asked.groupBy("dim", "block").agg(F.ceil(F.count("*") * F.first("dim") / QUERY_VALUES).cast("int").alias("groups"))
    plan = F.broadcast(sizes.join(groups, ["dim", "block"]))  # a row per block
    numbers = lambda to: F.explode(F.sequence(F.lit(0), F.col(to) - 1))
    part = lambda by: F.pmod(F.xxhash64("id"), F.col(by)).cast("int")
    q = asked.join(plan, ["dim", "block"]).select("id", "v", "dim", "block", "floor", F.lit(True).alias("is_query"), numbers("parts").alias("part"), part("groups").alias("group"))
    r = rows.join(plan, ["dim", "block"]).select("id", "v", "dim", "block", F.lit(0.0).alias("floor"), F.lit(False).alias("is_query"), part("parts").alias("part"), numbers("groups").alias("group"))
    tasks = q.unionByName(r).groupBy("dim", "block", "part", "group")
    return tasks.applyInArrow(lambda table: _task(table, k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, vector: str = "embedding", k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row where `is_query` holds, against all others.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null or empty vector or
    a null id. A query is scored against rows of its own length only. Rows with the query's id are left out; a query id
    that repeats counts once, by its smallest vector; candidates that repeat count each. Components and scores beyond
    64 bits count as the nearest number of 64 bits (of a score, the least is -(2**63 - 1)). An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").alias("id"), quantized(F.col(vector)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter("id is not null and size(v) > 0")
    rows = rows.select("id", "v", F.size("v").alias("dim"), "is_query")
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").select("dim", "v").limit(SAMPLE).collect()
    n, values = rows.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    wanted = min(CENTERS, max(shuffle_width(spark), -(-values // ROW_VALUES)))
    centers = {d: spread_centers(np.array([r["v"] for r in sample if r["dim"] == d], dtype=np.float64), wanted) for d in {r["dim"] for r in sample}}
    dealt = stash(_dealt(rows, centers))
    sizes = dealt.groupBy("dim", "block").agg(F.max("far").alias("radius"), F.ceil(F.count("*") * F.first("dim") / ROW_VALUES).cast("int").alias("parts"))
    radii: dict[int, np.ndarray] = {}
    for r in (sizes := stash(sizes)).collect():  # a row per block
        known = radii.setdefault(r["dim"], np.full(len(centers.get(r["dim"], [0])), -1.0))
        known[r["block"]] = r["radius"]
    asked = dealt.filter("is_query").groupBy("id").agg(F.min(F.struct("v", "dim", "block")).alias("q")).select("id", "q.v", "q.dim", "q.block", F.lit(float("-inf")).alias("floor"))
    sizes = sizes.select("dim", "block", "parts")
    home = stash(_scored(asked, dealt, sizes, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    reached = ranked(home).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("reached"))
    again = asked.drop("floor").join(reached, "id", "left").select("id", "v", "dim", "block", F.coalesce("reached", F.lit(float("-inf"))).alias("floor"))
    away = _scored(stash(_reaching(again, centers, radii)), dealt, sizes, k)
    return ranked(home.unionByName(away)).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint as score
  from v q join v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
