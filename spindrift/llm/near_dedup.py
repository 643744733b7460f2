"""Near-duplicate documents by a chosen-path set similarity join on minwise tokens.

Every distinct shingle set is represented by one document and a sketch of K minwise tokens. In each of a number of
independent trees, sets branch by a selected token of their sketch. Nodes of up to LEAF sets are compared exhaustively;
larger ones branch again, by as many selected tokens as leave a pair at the threshold one common child on average, so that
pairs at the threshold keep meeting at every depth while others part. The number of trees follows from the target recall.

A node's comparison on sketches (a byte of each token) splits it into bundles: what its candidate pairs join. The full sets
of a bundle meet in one task, where every pair is counted exactly and the links that join its sets are given out: one less
than sets, however many pairs there are. Bundles that share sets, as those of a group do in every tree, are one bundle while
that fits a task, so that a set goes to one task and not to one for each tree.

Of nodes that are large at the first level, one in some is dealt to blocks and linked within these, which joins most
of a large group of near copies. Then only nodes with sets of several components branch on, and only pairs of different
components count. A node in which few sets lie outside the largest component, or which stays large at the last depth, is
dealt to tasks of these sets against all of its sets: no pair of a node is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, stash
from .components import components

SHINGLE = 5
#: A link takes 100 * intersection >= percent * union; this is op4's percent.
PERCENT = 85
K, LEAF, MAX_DEPTH = 128, 2500, 12
#: The least probability that a pair at the threshold meets in a node at the last depth, where most pairs meet before.
RECALL = 0.99998
#: Levels after which large nodes, one in the second number, are linked within blocks; items of the sets of a task.
FIRST_DEPTH, FIRST_NODES, TASK_ITEMS = 1, 4, 4_000_000
#: Keys of nodes, or ids of sets or documents to be picked, that a broadcast takes at most (8 or 16 bytes each); with more, the join shuffles.
BROADCAST_KEYS = 1_000_000
_rng = np.random.default_rng(20260)
_A = _rng.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**64, K, dtype=np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)


def _candidate(percent: int) -> float:
    """Pairs are candidates from this number of equal minwise tokens on: 4 standard deviations below the threshold."""
    return percent / 100 * K - 4 * (percent / 100 * (1 - percent / 100) * K) ** 0.5


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_words = _WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles: SHINGLE words each, or all words where there are fewer."""
    # Lowering bytes changes A-Z alone, and splitting them takes exactly \x20 and \x09-\x0D as white space.
    words = (text or "").encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) == 0:
        return h
    size = min(SHINGLE, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = out * _M + h[k : len(h) - size + 1 + k]
    return np.unique(_mix(out))


def sketch(s: np.ndarray) -> np.ndarray:
    """K minwise tokens of a set, 32 bits each."""
    least = np.full(K, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(least, (s[at : at + 2048, None] * _A + _B).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("near_dedup", _words)
    for batch in batches:
        n, h1, h2, sketches = [], [], [], []
        for x in batch.column(1):
            s = shingle_set(x.as_py())
            n.append(len(s))
            h1.append(int(_mix(s ^ _M).sum().view(np.int64)))
            h2.append(int(_mix(s * _M).sum().view(np.int64)))
            sketches.append(sketch(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sketches, pa.list_(pa.int32()))], ["doc_id", "n", "h1", "h2", "sketch"])


def trees_for(recall: float, percent: int) -> int:
    """Trees in which a pair at the threshold shares a node at the last depth at least once with the probability `recall`.

    The pair's common nodes are a branching process: a node has one token, or two with the probability 1 / threshold - 1,
    and each is common with the probability of the threshold.
    """
    s = percent / 100
    two, meet = 1 / s - 1, s
    for _ in range(MAX_DEPTH - 1):
        meet = (1 - two) * s * meet + two * (1 - (1 - s * meet) ** 2)
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - meet))))


def _coordinates(node: Column, percent: int) -> Column:
    """The tokens that a node selects: one, and with the probability that makes 1 / threshold on average, another."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(K))
    more = F.pmod(F.xxhash64(node, F.lit(2)), F.lit(10_000)) < int(10_000 * (100 / percent - 1))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(3)), F.lit(K - 1)), F.lit(K))
    return F.when(more, F.array(first, second)).otherwise(F.array(first))


def _children(node: Column, percent: int) -> Column:
    return F.transform(_coordinates(node, percent), lambda c: F.xxhash64(node, c, F.get("sketch", c.cast("int"))))


def _marked(reps: DataFrame) -> DataFrame:
    """Sets with a byte of each token, which comparisons take: equal tokens have equal bytes, and few others have."""
    return reps.withColumn("marks", F.transform("sketch", lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("tinyint")))


def _roots(reps: DataFrame, trees: int, *carried: str) -> DataFrame:
    """Rows (key, id, label) of the nodes at the first depth, and columns of the sets; each set is its own component."""
    roots = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, F.get("sketch", F.pmod(F.xxhash64(t, F.lit(0)), F.lit(K)).cast("int"))))
    return reps.select("id", *carried, F.explode(roots).alias("key"), F.col("id").alias("label"))


def _few(keys: DataFrame) -> tuple[DataFrame, bool]:
    """Stored keys, and whether they are few enough to be broadcast: then what they pick out is not shuffled to be picked."""
    few = keys.count() <= BROADCAST_KEYS
    return F.broadcast(keys) if few else keys, few


def _of(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """`reps` without sets that no row has, where those of the rows are few: so a join with the rows shuffles no others."""
    ids, few = _few(stash(rows.select("id").distinct()))
    return reps.join(ids, "id") if few else reps


def _level(rows: DataFrame, *carried: str, own: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The rows of nodes to compare, and those of larger nodes; nodes of one component are left out. `rows` is computed often.

    carried: columns of the sets that rows keep where they are picked without a shuffle. own: each set is its own component.
    """
    ends = [] if own else [F.min("label").alias("low"), F.max("label").alias("high")]
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("members"), *ends)
    sizes = stash(sizes.filter("size > 1" if own else "size > 1 and low < high").select("key", "size", "members"))
    # One of the nodes with the same members will do.
    keep, few = _few(stash(sizes.filter(F.col("size") <= LEAF).groupBy("size", "members").agg(F.min("key").alias("key")).select("key")))
    small = rows.join(keep, "key").select("key", "id", "label", *carried[: few * len(carried)])
    small = small if few else stash(small)  # else every reading of it would shuffle the rows
    above, few = _few(sizes.filter(F.col("size") > LEAF).select("key", "size"))
    large = rows.join(above, "key").select("key", "id", "label", "size", *carried[: few * len(carried)])
    return small, large if above.head(1) else None


def _shares(large: DataFrame) -> DataFrame:
    """key, major (the largest component), blocks and minors (blocks of the other sets) of nodes with several components."""
    by = large.groupBy("key", "label").agg(F.count("*").alias("c"))
    nodes = by.groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("top")).filter("size > top.c")
    return nodes.select("key", F.col("top.label").alias("major"), F.ceil(F.col("size") / (LEAF // 2)).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("top.c")) / (LEAF // 2)).cast("int").alias("minors"))


def _branched(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The rows of the children of nodes."""
    return stash(rows.join(_of(rows, reps.select("id", "sketch")), "id").select("id", "label", F.explode(_children(F.col("key"), percent)).alias("key")))


def _first_nodes(reps: DataFrame, percent: int, recall: float, depths: int, *carried: str) -> tuple[list[DataFrame], DataFrame | None]:
    """Rows (key, id, label) of the nodes to compare in the first levels, and those of larger nodes at the last of them.

    carried: columns of the sets that the rows of the first level keep, if they are picked without a shuffle.
    """
    small = []
    for depth in range(depths):
        found, large = _level(_branched(large, reps, percent)) if depth else _level(_roots(reps, trees_for(recall, percent), *carried), *carried, own=True)
        small.append(found)
        if large is None:
            break
    return small, large


def _mixed_nodes(large: DataFrame, reps: DataFrame, percent: int) -> tuple[list[DataFrame], DataFrame]:
    """Of large nodes with several components, which branch on: rows to compare, and those of nodes to be dealt to tasks."""
    small, dealt = [], []
    for depth in range(FIRST_DEPTH, MAX_DEPTH + 1):
        mixed = stash(large.join(_shares(large), "key").withColumn("deal", (F.col("minors") == 1) | (F.lit(depth) == MAX_DEPTH)))
        dealt.append(mixed.filter("deal"))
        if not mixed.filter("not deal").head(1):
            break
        found, large = _level(_branched(mixed.filter("not deal"), reps, percent))
        small.append(found)
        if large is None:
            break
        large = stash(large.drop("size"))
    return small, reduce(DataFrame.unionByName, dealt)


def _nodes(reps: DataFrame, percent: int = PERCENT) -> tuple[list[DataFrame], DataFrame | None]:
    """All nodes down to the last depth, as `_first_nodes` gives them."""
    return _first_nodes(reps, percent, RECALL, MAX_DEPTH)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task key (first column) of sorted batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        joined = pa.Table.from_batches(rest)
        keys = joined.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for a, b in zip(starts[:-1], starts[1:]):
            yield joined.slice(a, b - a)
        rest = joined.slice(starts[-1]).to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


def _bundles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each task, the sets that candidate pairs of different components join: bundle (a hash of the members), first (the
    smallest id), id and n."""
    claim("near_dedup", _words)
    least = _candidate(percent)
    for table in _groups(batches):
        ids, at = np.unique(table.column("id").to_numpy(), return_index=True)
        n, label = table.column("n").to_numpy()[at], table.column("label").to_numpy()[at]
        tokens = table.column("marks").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), K)[at]
        todo = np.ones(len(ids), dtype=bool)
        bundles, firsts, members, sizes = [], [], [], []
        while todo.any():
            own, new = [], [int(todo.argmax())]
            todo[new] = False
            while new:
                own.append(k := new.pop())
                rest = np.flatnonzero(todo & (label != label[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])))
                near = rest[(tokens[rest] == tokens[k]).sum(axis=1) >= least]
                todo[near] = False
                new.extend(near.tolist())
            if len(own) > 1:
                own.sort()  # so are their ids
                found = ids[own]
                firsts.append(np.full(len(found), found[0]))
                members.append(found)
                sizes.append(n[own])
                bundles.append(np.full(len(found), np.uint64(xxhash.xxh3_64_intdigest(found.tobytes()))).view(np.int64))
        if members:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (bundles, firsts, members, sizes)], ["bundle", "first", "id", "n"])


def _blocks(dealt: DataFrame) -> DataFrame:
    """Nodes (with the columns of `_shares`) dealt to tasks (block of sets outside the largest component, block of all)."""
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    tasks = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    every = tasks("minors", lambda i: F.xxhash64("key", i, block("blocks")))
    minor = tasks("blocks", lambda j: F.xxhash64("key", block("minors"), j))
    own = F.when(F.col("label") != F.col("major"), F.array_union(every, minor)).otherwise(every)
    return dealt.select(F.explode(own).alias("task"), "id", "label")


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("near_dedup", _words)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], ["id", "items"])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """The numbers of items that each two of the sets (sorted, distinct items) have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    items = np.concatenate(sets)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    first = np.r_[True, items[1:] != items[:-1]]
    column = np.cumsum(first) - 1
    often = np.bincount(column) > 1  # what only one set has is common to no pair
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        has = np.zeros((len(sets), width), dtype=np.float32)
        has[owner[a:b], column[a:b] - start] = 1.0
        out += has @ has.T  # at most `width`, which these floats hold exactly
    return out


def _link_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For each task, links that join those of its sets which links join, and no other."""
    claim("near_dedup", _words)
    for table in _groups(batches):
        ids = table.column("id").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("items")]
        n = np.array([len(x) for x in sets], dtype=np.float64)
        common = _shared(sets)
        linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        todo, u, v = np.ones(len(ids), dtype=bool), [], []
        for first in np.argsort(ids):  # a class is a star around its smallest id
            if not todo[first]:
                continue
            new = [int(first)]
            todo[first] = False
            while new:
                near = np.flatnonzero(todo & linked[new.pop()])
                todo[near] = False
                u += ids[near].tolist()
                v += [int(ids[first])] * len(near)
                new.extend(near.tolist())
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _merged(bundles: DataFrame) -> DataFrame:
    """Bundles that share sets as one, if that is no more than a task takes; else as they are. Columns bundle, id and n."""
    joined = bundles.join(components(bundles.select(F.col("id").alias("u"), F.col("first").alias("v"))), "id", "left")
    joined = stash(joined.select("bundle", "id", "n", F.coalesce("component", "id").alias("all")))
    sums = joined.select("all", "id", "n").distinct().groupBy("all").agg(F.count("*").alias("sets"), F.sum("n").alias("items"))
    over, few = _few(stash(sums.filter((F.col("sets") > LEAF) | (F.col("items") > TASK_ITEMS)).select("all", F.lit(True).alias("over"))))
    return stash(joined.join(over, "all", "left").select(F.when(F.col("over"), F.col("bundle")).otherwise(F.xxhash64("all")).alias("bundle"), "id", "n").distinct())


def _links(tasks: list[DataFrame], reps: DataFrame, docs: DataFrame, text: str, percent: int, repeated: bool) -> DataFrame:
    """Links (u, v) that join whatever links of the tasks (columns task, id, label; maybe n and marks) join; between components alone.

    repeated: several rows of `docs` have one id.
    """
    told = lambda rows: rows if "marks" in rows.columns else rows.join(_marked(_of(rows, reps)), "id")
    dealt = reduce(DataFrame.unionByName, [told(rows).select("task", "id", "n", "marks", "label") for rows in tasks])
    bundles = _merged(stash(dealt.repartition("task").sortWithinPartitions("task").mapInArrow(lambda batches: _bundles(batches, percent), "bundle long, first long, id long, n long").distinct()))
    # A bundle whose sets are too much for a task is dealt to tasks for each two blocks of it.
    weights = bundles.groupBy("bundle").agg(F.ceil(F.sum("n") * 2 / TASK_ITEMS).cast("int").alias("blocks"))
    of = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, of).alias("i"), F.greatest(k, of).alias("j")))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    rows = bundles.join(weights, "bundle").select("id", "bundle", F.explode(F.when(F.col("blocks") > 2, pairs).otherwise(whole)).alias("t"))
    rows, _ = _few(stash(rows.select("id", F.xxhash64("bundle", "t.i", "t.j").alias("task"))))
    ids, _ = _few(stash(bundles.select(F.col("id").alias("doc_id")).distinct()))
    sets = docs.select("doc_id", text).join(ids, "doc_id").mapInArrow(_set_rows, "id long, items binary")
    sets = stash(sets.dropDuplicates(["id", "items"]) if repeated else sets)
    met = rows.join(sets, "id").select("task", "id", "items").repartition("task").sortWithinPartitions("task")
    return stash(met.mapInArrow(lambda batches: _link_rows(batches, percent), "u long, v long"))


def link_documents(docs: DataFrame, text: str = "text", percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs`; other columns are left out.

    percent: the least similarity of linked sets, in hundredths. recall: see `trees_for`. Sketches let pairs pass from 4
    standard deviations below the threshold on, so a link at the threshold is no candidate with a probability of 0.00003.
    Texts of any length count whole; repeated rows come out as often as they went in; an empty table gives an empty one.
    Null texts and texts without words have an empty set and are linked with nothing. Rows that share a doc_id
    but not a text are linked through either. A row with a null doc_id is never linked: its component_id is null, and it is kept.
    """
    rows = stash(docs.select("doc_id", text).mapInArrow(_sketch_rows, "doc_id long, n long, h1 long, h2 long, sketch array<int>"))
    real = rows.filter("n > 0 and doc_id is not null")
    reps = stash(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")))
    repeated = bool(rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").head(1))
    small, large = _first_nodes(_marked(reps), percent, recall, FIRST_DEPTH, "n", "marks")
    tasks = [level.withColumnRenamed("key", "task") for level in small]
    if large is not None:
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / (LEAF // 2)))
        tasks.append(large.filter(F.pmod("key", F.lit(FIRST_NODES)) == 0).withColumn("task", F.xxhash64("key", block)).drop("key", "size"))
        large = stash(large.select("key", "id", "label", "size"))
    links = _links(tasks, reps, docs, text, percent, repeated)
    linked = components(links)
    if large is not None:
        large = stash(large.join(linked, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label")))
        small, dealt = _mixed_nodes(large, reps, percent)
        tasks = [_blocks(dealt), *(level.select(F.col("key").alias("task"), "id", "label") for level in small)]
        links = links.unionByName(_links(tasks, reps, docs, text, percent, repeated))
        linked = components(links)
    classes = reps.join(linked, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component_id"))
    found = rows.join(classes, ["h1", "h2"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=PERCENT)


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents),
s as (
  select doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [words]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4])) end) as item
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.item = b.item and a.doc_id <> b.doc_id group by 1, 2),
l as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 85 * (x.n + y.n - c)),
r as (select u as doc_id, u as seen from (select distinct u from l) union select r.doc_id, l.v from r join l on l.u = r.seen),
m as (select doc_id, min(seen) as low from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) as component_id,
  d.doc_id <= coalesce(m.low, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""
