"""Best-fit packing of token sequences, planned on the histogram of lengths.

The plan places counts of lengths, not documents: for each length from the longest down, its count goes to the open
sequences with the least room that it fits, group by group, and what is left opens new ones. A slot of the plan is a range of ranks
within a length and where they go. Documents then take the slot of their rank. The plan depends on at most `capacity`
counts, so its size does not grow with the corpus. Ranks are counted within (length, salt), where the salts of a length
follow each other, so that a length which a third of the documents share is spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import shuffle_width, stash

CAPACITY = 4096
#: The id that ends each document.
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit over {length: count}. Rows (length, first rank, sequence, offset, per sequence), sorted by length and rank.

    From its first rank on, `per sequence` documents of a slot follow each other from `offset` on in each of its sequences.
    """
    open_by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # room -> (first sequence, how many)
    rooms, sequences, slots = 0, 0, []  # bit r of rooms: some sequence has room r
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left and (fit := rooms >> length):
            room = length + (fit & -fit).bit_length() - 1
            first, n = open_by_room[room].pop()
            used = min(n, left)
            if used < n:
                open_by_room[room].append((first + used, n - used))
            if not open_by_room[room]:
                rooms &= ~(1 << room)
            slots.append((length, rank, first, capacity - room, 1))
            rank, left = rank + used, left - used
            open_by_room[room - length].append((first, used))
            if room > length:
                rooms |= 1 << (room - length)
        fits = capacity // length
        for used, each in ((left // fits, fits), (1, left % fits)):
            if used and each:
                slots.append((length, rank, sequences, 0, each))
                room = capacity - each * length
                open_by_room[room].append((sequences, used))
                if room:
                    rooms |= 1 << room
                rank, sequences = rank + used * each, sequences + used
    return np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """A row per piece: each document's ids and then END_ID, cut every `capacity` tokens. A null text has END_ID alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, end = codec(tokenizer), np.uint32(END_ID).astype("<u4").tobytes()
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                packed = c.encode(x.as_py()) + end
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    ids.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", text).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (columns of PIECES, lengths 1 to `capacity`, a stored table) with sequence_id and offset.

    Ties, so pieces of one length, are ranked by salt, id and piece; repeated rows get a place each. No row is left out.
    """
    spark = pieces.sparkSession
    salts = 4 * shuffle_width(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counted = stash(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    first = counted.select("length", "salt", F.coalesce(before, F.lit(0)).alias("first"))
    slots = plan_slots({r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("in_salt", F.row_number().over(order) - 1).join(first, ["length", "salt"])
    shared = spark.sparkContext.broadcast(slots)  # at most a slot for each pair of lengths, whatever the number of rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        keys = slots[:, 0] << 48 | slots[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            slot = slots[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            nth, within = np.divmod(rank - slot[:, 1], slot[:, 4])
            columns = [*batch.columns[:5], pa.array(slot[:, 2] + nth), pa.array(slot[:, 3] + within * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("in_salt")).cast("long").alias("rank"))
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize whole documents, cut those of over `capacity` tokens, and pack the pieces into sequences.

    Extra columns of `docs` are left out. An empty table gives an empty result.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return pack(stash(tokenize_pieces(docs, path, capacity)), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
