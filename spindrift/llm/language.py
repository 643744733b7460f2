"""Language identification by word-first backoff.

A word that the model knows votes with its log frequency in each language. A word that it doesn't know votes with its
character n-grams, the longest length of which any is known; shorter ones are asked only where no longer one is. All
counts come from every row that may be learned from, and every word and n-gram that was counted counts.

The most frequent words are broadcast, and a pass over the texts adds up their votes. What is left of a text, its rarer
words, meets the table of all terms in joins on distinct words. Up to a bound the n-grams are broadcast to that join too;
beyond it they shuffle. How much is broadcast changes no result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, stash

LONGEST = 4
SMOOTH = 0.5
UNDETERMINED = "und"
#: Words that are broadcast, and log frequencies of them (words times languages), at most.
HEAD_WORDS, HEAD_VALUES = 500_000, 2_000_000
#: Log frequencies of n-grams (n-grams times languages) up to which the n-grams are broadcast.
GRAM_VALUES = 4_000_000
#: Entries of a worker's table of partial counts, and of its table of tokens seen.
FLUSH = 400_000
#: Longer tokens are not remembered by a worker.
TOKEN_CHARS = 40
_LETTERS = re.compile(r"[^\W\d_]+").findall
_any_letter = re.compile(r"[^\W\d_]").search


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (lang, word)."""
    raw: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        found: dict[str, Counter] = {}
        for lang, tokens in raw.items():
            words = found.setdefault(lang, Counter())
            for token, n in tokens.items():
                for word in _LETTERS(token):
                    words[word] += n
        rows = [(lang, w, n) for lang, words in found.items() for w, n in words.items()]
        raw.clear()
        langs, words, counts = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw.setdefault(lang, Counter()).update((x.as_py() or "").lower().split())
        if sum(map(len, raw.values())) >= FLUSH:
            yield flush()
    yield flush()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (lang, size, term) of the n-grams of counted words."""
    counts: dict[tuple[str, int], Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, size, g, n) for (lang, size), own in counts.items() for g, n in own.items()]
        counts.clear()
        lang, size, term, n = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(term, pa.string()), pa.array(n, pa.int64())], ["lang", "size", "term", "n"])

    for batch in batches:
        for lang, word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for size in range(1, min(LONGEST, len(word)) + 1):
                own = counts.setdefault((lang, size), Counter())
                for i in range(len(word) - size + 1):
                    own[word[i : i + size]] += n
        if sum(map(len, counts.values())) >= FLUSH:
            yield flush()
    yield flush()


def _word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, size, term and n (how often) of the n-grams of words."""
    rows: list[tuple[str, int, str, int]] = []

    def flush() -> pa.RecordBatch:
        word, size, term, n = zip(*rows) if rows else ((), (), (), ())
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(size, pa.int32()), pa.array(term, pa.string()), pa.array(n, pa.int64())], ["word", "size", "term", "n"])

    for batch in batches:
        for x in batch.column(0):
            word = x.as_py()
            for size in range(1, LONGEST + 1):
                grams = Counter(word[i : i + size] for i in range(len(word) - size + 1))
                for g, n in grams.items():
                    rows.append((word, size, g, n))
                    # A batch holds the word once per row.
                    if len(rows) >= 50_000 or len(word) * len(rows) >= 50_000_000:
                        yield flush()
    yield flush()


@dataclass
class Backoff:
    """Languages in the order of all votes, their log shares, frequent words with the rows of their votes, and all terms.

    terms: size (0: a word, else the length of an n-gram), term, votes (array of log frequencies). few_grams: whether its
    n-grams may be broadcast.
    """

    langs: list[str]
    prior: np.ndarray
    head: dict[str, int]
    votes: np.ndarray
    terms: DataFrame | None
    few_grams: bool


def train(docs: DataFrame, text: str = "text", head_words: int = HEAD_WORDS, gram_values: int = GRAM_VALUES) -> Backoff:
    """Counts over all rows of `docs` with a lang that are not held out; a null text adds nothing, a repeated row counts
    each time. Without such rows the model has no language. head_words: how many words are broadcast at most. gram_values: see GRAM_VALUES."""
    learn = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", text)
    words = stash(learn.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    grams = words.select("lang", "word", "n").mapInArrow(_count_grams, "lang string, size int, term string, n long")
    grams = stash(grams.groupBy("size", "term", "lang").agg(F.sum("n").alias("n")))
    every = words.select("lang", F.lit(0).alias("size"), F.col("word").alias("term"), "n").unionByName(grams)
    totals = every.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()  # five rows per language
    terms = stash(every.groupBy("size", "term").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")))
    distinct = {r["size"]: r["c"] for r in terms.groupBy("size").agg(F.count("*").alias("c")).collect()}  # five rows
    langs = sorted({r["lang"] for r in totals})
    if not langs:
        return Backoff([], np.zeros(0), {}, np.zeros((0, 0)), None, False)
    count = {(r["size"], r["lang"]): r["n"] for r in totals}
    under = lambda size, lang: float(count.get((size, lang), 0) + SMOOTH * distinct[size])
    votes = lambda size: F.array(*[F.log((F.coalesce(F.col("by")[lang], F.lit(0)) + SMOOTH) / under(size, lang)) for lang in langs])
    by_size = F.when(F.lit(False), votes(0))
    for size in distinct:
        by_size = by_size.when(F.col("size") == size, votes(size))
    top = terms.filter("size = 0").orderBy(F.desc("n"), "term").limit(min(head_words, HEAD_VALUES // len(langs))).select("term", votes(0).alias("votes")).toArrow()
    few_grams = sum(c for size, c in distinct.items() if size) * len(langs) <= gram_values
    share = np.array([count[0, x] for x in langs], dtype=np.float64)
    frequent = dict(zip(top.column("term").to_pylist(), range(len(top))))
    table = top.column("votes").combine_chunks().flatten().to_numpy().reshape(-1, len(langs))
    return Backoff(langs, np.log(share / share.sum()), frequent, table, terms.select("size", "term", by_size.alias("votes")), few_grams)


class _Tokens(dict):
    """Numbers of tokens (what has no white space in it): rows of `table`, the votes of their frequent words.

    A token that is one frequent word has that word's row. Others get a row of their own, after those, and may have a rest.
    """

    def __init__(self, head: dict[str, int], votes: np.ndarray):
        super().__init__()
        self.head, self.size = head, len(votes)
        self.table = np.concatenate([votes, np.zeros((1 << 16, votes.shape[1]))])
        self.rest: list[list[str]] = []

    def __missing__(self, token: str) -> int:
        words = _LETTERS(token)
        known = [i for w in words if (i := self.head.get(w)) is not None]
        if len(words) == len(known) == 1:
            at = known[0]
        else:
            at = self.size + len(self.rest)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = self.table[known].sum(0) if known else 0.0
            self.rest.append([w for w in words if w not in self.head] if len(known) < len(words) else [])
        self[token] = at
        return at

    def trimmed(self, longest: int) -> None:
        """Forgets all if there are too many, or if one is too long to keep."""
        if len(self) >= FLUSH or longest > TOKEN_CHARS:
            self.clear()
            self.rest = []


def _frequent(docs: DataFrame, model: Backoff, text: str) -> DataFrame:
    """Of every row: uid, doc_id, letters (whether it has any), the sum of the votes of frequent words, and the rest of its
    words with how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast((model.head, model.votes))  # bounded by HEAD_WORDS and HEAD_VALUES

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(*shared.value)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            letters, sums, rest = [], [], []
            for x in batch.column(1):
                own = (x.as_py() or "").lower()
                parts = own.split()
                at = np.fromiter(map(tokens.__getitem__, parts), np.int64, len(parts))
                rare = Counter(w for i in at[at >= tokens.size].tolist() for w in tokens.rest[i - tokens.size])
                letters.append(_any_letter(own) is not None)
                sums.append(tokens.table[at].sum(0))
                rest.append([{"word": w, "n": n} for w, n in rare.items()])
                tokens.trimmed(max(map(len, parts), default=0))
            ids = pa.array(range(uid, uid + len(sums)), pa.int64())
            uid += len(sums)
            yield pa.RecordBatch.from_arrays([ids, batch.column(0), pa.array(letters, pa.bool_()), pa.array(sums, pa.list_(pa.float64())), pa.array(rest, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))], ["uid", "doc_id", "letters", "votes", "rest"])

    return docs.select("doc_id", text).mapInArrow(add_up, "uid long, doc_id long, letters boolean, votes array<double>, rest array<struct<word:string,n:long>>")


def _rare_votes(rest: DataFrame, terms: DataFrame, size: int, few_grams: bool) -> DataFrame:
    """uid, n and the votes v0, v1, ... of words (uid, word, n): a known word's own, else the mean of its longest known
    n-grams'; words of which no character is known are left out."""
    each = [F.col("votes")[i].alias(f"v{i}") for i in range(size)]
    known = rest.join(terms.filter("size = 0").select(F.col("term").alias("word"), "votes"), "word", "left")
    new = stash(known.filter("votes is null").select("uid", "word", "n"))
    grams = new.select("word").distinct().mapInArrow(_word_grams, "word string, size int, term string, n long")
    own = terms.filter("size > 0")
    met = grams.join(F.broadcast(own) if few_grams else own, ["size", "term"]).groupBy("word", "size").agg(F.sum("n").alias("n"), *[F.sum(F.col("votes")[i] * F.col("n")).alias(f"v{i}") for i in range(size)])
    longest = met.groupBy("word").agg(F.max(F.struct("size", "n", *[f"v{i}" for i in range(size)])).alias("m"))
    means = longest.select("word", *[(F.col(f"m.v{i}") / F.col("m.n")).alias(f"v{i}") for i in range(size)])
    return known.filter("votes is not null").select("uid", "n", *each).unionByName(new.join(means, "word").select("uid", "n", *[f"v{i}" for i in range(size)]))


def identify(docs: DataFrame, model: Backoff, text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row; other columns are left out.

    A text that is null or has no letter is UNDETERMINED with score 0. Letters of which the model knows none get the most
    common language, with its share; ties go to the first language by name. Texts and words of any length count whole.
    Repeated rows come out as often as they went in; an empty table gives an empty one.
    """
    if not model.langs:
        return docs.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    size = len(model.langs)
    rows = stash(_frequent(docs, model, text))
    sums = _rare_votes(rows.select("uid", F.inline("rest")), model.terms, size, model.few_grams).groupBy("uid").agg(*[F.sum(F.col(f"v{i}") * F.col("n")).alias(f"v{i}") for i in range(size)])
    total = F.array(*[F.col("votes")[i] + F.coalesce(f"v{i}", F.lit(0.0)) + float(model.prior[i]) for i in range(size)])
    out = rows.drop("rest").join(sums, "uid", "left").select("doc_id", "letters", total.alias("total")).withColumn("most", F.array_max("total"))
    best = F.get(F.array(*[F.lit(x) for x in model.langs]), F.array_position("total", F.col("most")).cast("int") - 1)
    share = 1 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    return out.select("doc_id", F.when(F.col("letters"), best).otherwise(UNDETERMINED).alias("lang_pred"), F.when(F.col("letters"), share).otherwise(0.0).alias("score"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
