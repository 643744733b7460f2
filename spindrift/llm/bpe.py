"""BPE encoding and decoding with a given vocabulary.

Encoder: at each place of a piece it takes the longest token that an Aho-Corasick automaton found there, and goes back
to a shorter one where two neighbours can't both have come out of the merges. Whether they can is a property of the pair
alone, decided by undoing their last merges (and kept in a table), so the result is the one of the merge rules. A place
that led nowhere is marked and not tried again: the time is linear in the piece. Pieces that came before are looked up.

Decoder: the bytes of all tokens lie in one buffer; a table of offsets says where each begins, and a whole batch of ids
is gathered from it at once.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import claim

#: Entries of a worker's tables of pieces and of pairs.
CACHE_ENTRIES = 1_200_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: Letters and white space of texts in ASCII and extended Latin, where classes without properties give the same pieces faster.
_PLAIN, _BLANK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "\\t-\\r "
_beyond_plain = re.compile("[^\\x00-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]").search


def reading(spec: dict) -> tuple[str, str, Callable[[str], str]]:
    """For the two supported forms of a tokenizer file: the pattern of pieces, the one for plain texts, the normalizer."""
    white = lambda pattern: pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    split = spec["pre_tokenizer"]
    if split["type"] == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"] and not spec["normalizer"]:
        plain = rf" ?[{_PLAIN}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^{_BLANK}{_PLAIN}0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
        return white(public_tokenizers.PATTERN), plain, str
    steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    first = split.get("pretokenizers", [{}])[0]
    if steps == ["NFC", "Replace", "Lowercase"] and first.get("behavior") == "Removed" and first.get("invert"):
        # White space only parts pieces here, so that replacing it by blanks changes nothing. Letters are lowered one by
        # one: a sigma that ends a word is an ordinary one.
        plain = rf"[{_PLAIN}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^{_BLANK}{_PLAIN}0-9]+"
        return white(first["pattern"]["Regex"]), plain, lambda text: unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
    raise ValueError("unsupported tokenizer file")


class Vocabulary:
    """Tokens and merges of a tokenizer file of the type `BPE` on bytes; `suffix` ends the last token of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pattern, self.plain_pattern, self.normal = reading(spec)
        self.ids: dict[str, int] = model["vocab"]
        self.letters = byte_letters()
        self.byte = {c: b for b, c in enumerate(self.letters)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int]] = {}  # the parts of a token, by its first rule
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(pairs):
            pair, token = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.rank.setdefault(pair, rank)
            self.merged.setdefault(pair, token)
            self.made.setdefault(token, pair)
        #: The rank at which a token comes to be; letters are there from the start.
        self.born = {t: self.rank[p] for t, p in self.made.items()}
        self.text = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}

    def token_bytes(self, i: int) -> bytes:
        if self.text[i] in self.added:
            return self.text[i].encode()
        return bytes(self.byte[c] for c in self.text[i])


class Encoder:
    """Exact merges of one vocabulary. A piece is given as symbols, one character for each byte (see `symbols`)."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.table: dict[tuple[int, int], bool] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        self.length: dict[int, int] = {}
        for text, i in sorted(vocabulary.ids.items(), key=lambda x: vocabulary.born.get(x[1], -1)):
            symbols, parts = self.symbols(text), vocabulary.made.get(i)
            # A token that no merge makes, or whose parts merge otherwise first, never comes out.
            if len(symbols) == 1 if parts is None else all(p in self.length for p in parts) and self.apart(*parts, vocabulary.born[i]):
                self.length[i] = len(symbols)
                self.machine.add_word(symbols, i)
        self.machine.make_automaton()
        self.shorter: dict[int, int] = {}  # the longest token that a token begins with
        for i in self.length:
            symbols = self.symbols(vocabulary.text[i])
            self.shorter[i] = next((j for k in range(len(symbols) - 1, 0, -1) if (j := self.machine.get(symbols[:k], None)) is not None), None)

    def symbols(self, text: str) -> str:
        """The letters of a token's text; the one before the suffix that ends a word is moved to a plane of its own."""
        end = self.v.suffix
        if end and text.endswith(end) and len(text) > len(end):
            return self.ended(text[: -len(end)])
        return text

    def ended(self, letters: str) -> str:
        return letters[:-1] + chr(0xE000 + ord(letters[-1])) if self.v.suffix else letters

    def apart(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether no merge before `limit` crosses the border of two tokens, as their last merges are undone one by one.

        Of two tokens the one born later is undone first; of equals the right one, as merges of a rule go from left to right.
        """
        rank, made, born = self.v.rank, self.v.made, self.v.born
        while True:
            if rank.get((left, right), limit) < limit:
                return False
            a, b = born.get(left, -1), born.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, made[left][1]
            else:
                limit, right = b + 1, made[right][0]

    def compatible(self, left: int, right: int) -> bool:
        known = self.table.get((left, right))
        if known is None:
            if len(self.table) >= CACHE_ENTRIES:
                self.table.clear()
            known = self.table[left, right] = self.apart(left, right)
        return known

    def piece(self, symbols: str) -> list[int]:
        whole = self.machine.get(symbols, None)
        if whole is not None:
            return [whole]
        n, length = len(symbols), self.length
        longest: list[int | None] = [None] * (n + 1)  # the longest token from each place on: matches come by their end
        for end, token in self.machine.iter(symbols):
            longest[end + 1 - length[token]] = token
        out: list[int] = []
        dead = bytearray(n + 1)  # places from which there is no way on
        at, token = 0, longest[0]
        while at < n:
            while token is not None and (dead[at + length[token]] or out and not self.compatible(out[-1], token)):
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at += length[token]
                token = longest[at]
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
            else:
                raise ValueError(f"the vocabulary has no token for a part of {symbols!r}")
        return out


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Packed(dict):
    """Piece -> its ids as little-endian 32-bit integers. When half the entries are new, those older go unless used since."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = pack_ids(self.encode(piece))
            if len(piece) > 64:
                return packed
        if len(self) >= CACHE_ENTRIES // 2:
            self.old = dict(self)
            self.clear()
        self[piece] = packed
        return packed


class TextCodec:
    """Whole texts to packed ids and back, as the tokenizer file says: added tokens, normalizer, split, merges."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.encoder = Encoder(self.v)
        self.added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.v.added, key=len, reverse=True)) + ")") if self.v.added else None
        self.pieces, self.plain_pieces = regex.compile(self.v.pattern).findall, re.compile(self.v.plain_pattern).findall
        self.packed = _Packed(self._piece)
        lengths = np.zeros(max(self.v.text) + 1, dtype=np.int64)
        tokens = {i: self.v.token_bytes(i) for i in self.v.text}
        for i, b in tokens.items():
            lengths[i] = len(b)
        self.lengths = lengths
        self.offsets = np.cumsum(lengths) - lengths
        self.buffer = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), dtype=np.uint8)

    def _piece(self, piece: str) -> list[int]:
        letters = self.v.letters  # those of ASCII letters are the letters
        written = piece if piece.isascii() and piece.isalpha() else "".join([letters[b] for b in piece.encode()])
        return self.encoder.piece(self.encoder.ended(written))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers; a null text is empty."""
        if not text:
            return b""
        if self.added is None or not any(x in text for x in self.v.added):
            return self._plain(text)
        parts = self.added.split(text)
        return b"".join(pack_ids([self.v.added[x]]) if i % 2 else self._plain(x) for i, x in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        text = self.v.normal(text)
        pieces = self.pieces if _beyond_plain(text) else self.plain_pieces
        return b"".join(map(self.packed.__getitem__, pieces(text)))

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, dtype="<u4")
        n = self.lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total, dtype=np.int64) + np.repeat(self.offsets[ids] - (ends - n), n)
        return self.buffer[places].tobytes().decode("utf-8", "replace")


_codecs: dict[str, TextCodec] = {}


def codec(path: str) -> TextCodec:
    """One per process and file, until a task of another operator claims the worker."""
    claim("bpe", _codecs)
    if path not in _codecs:
        _codecs[path] = TextCodec(path)
    return _codecs[path]


def code_digests(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of `docs`; other columns are left out.

    A null text counts as empty: 0 tokens and the hash of nothing. Repeated rows come out as often as they went in. The
    pass is a map over the rows; a worker holds one batch of texts and a bounded table of pieces.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, ids, back = [], [], []
            for x in batch.column(1):
                packed = c.encode(x.as_py())
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(c.decode(packed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
