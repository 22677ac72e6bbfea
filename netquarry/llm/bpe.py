"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

The last token of a prefix's encoding is unique: it is the one token t that ends the prefix, is
compatible with the last token of what comes before it, and encodes itself. So one pass over a
piece of text finds, for each prefix, all tokens that end it (an automaton over the vocabulary
reports them, longest first), tests each against the stored last token of the shorter prefix, and
stores the one that fits; back-pointers from the end give the ids. The work is linear in the
length whatever the text. Two tokens are compatible if undoing their merges, the latest first,
meets no merge across their border that byte-pair encoding would have made before.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, held, table
from .runs import Runs

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces and pairs of tokens remembered by a worker; beyond that it starts anew.
REMEMBERED = 200_000
#: Bytes of text that the pipeline's stage encodes together, beside which an executor's memory has the most left by earlier stages.
TEXT = 4 << 20
#: Bits of a token's number.
SHIFT = 20
#: Longer pieces are encoded each time.
LONG = 64
#: The pattern that cuts texts into pieces; white space as Unicode has it.
PATTERN = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s+", r"\p{White_Space}+"))


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves,
    the others follow from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Maps a piece to its ids as little-endian unsigned 32-bit integers; computes those it doesn't remember."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocabulary = told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, i in vocabulary.items():
            self.bytes[i] = raw(token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        # by pair (the first token's number SHIFT bits up) the rank of its merge; by token the rank of the
        # merge that makes it (-1: none, a single byte) and that merge's halves
        self.merged: dict[int, int] = {}
        self.rank, self.left, self.right = ([-1] * len(self.bytes) for _ in range(3))
        for rank, (a, b) in enumerate(told["model"]["merges"]):
            whole = vocabulary[a + b]
            self.merged[vocabulary[a] << SHIFT | vocabulary[b]] = rank
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, vocabulary[a], vocabulary[b]
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i in vocabulary.values():
            if len(self.bytes[i]) == 1 or self.rank[i] >= 0:
                self.automaton.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.automaton.make_automaton()
        for i in [i for i, r in enumerate(self.rank) if r >= 0 and not self._compatible(self.left[i], self.right[i], r)]:
            self.automaton.remove_word(self.bytes[i].decode("latin-1"))
        self.automaton.make_automaton()
        self.runs = Runs(self.encode, self._after_space, list(self.special), REMEMBERED)
        self.end = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def _compatible(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Does the encoding of the bytes of a, then b, keep their border, looking at merges of a rank below limit only?

        The two tokens at the border are followed back in time: whichever was merged last is undone (of equal
        merges the left one came first), and from then on only earlier merges can have crossed the border.
        """
        merged, rank, left, right = self.merged, self.rank, self.left, self.right
        while True:
            across = merged.get(a << SHIFT | b)
            if across is not None and across < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, a = ra, right[a]
            elif rb < 0:
                return True
            else:
                limit, b = rb + 1, left[b]

    def piece(self, piece: str) -> list[int]:
        """Ids of a piece."""
        text = piece if piece.isascii() else piece.encode().decode("latin-1")
        fits, compatible = self.fits, self._compatible
        if len(fits) >= REMEMBERED:
            fits.clear()
        last = [-1] * (len(text) + 1)  # of each prefix, its last token and how many bytes come before it
        back = [0] * (len(text) + 1)
        done = -1
        for end, (token, n) in self.automaton.iter(text):
            if end == done:
                continue
            start = end + 1 - n
            if start:
                pair = last[start] << SHIFT | token
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = last[start] >= 0 and compatible(last[start], token)
                if not fit:
                    continue
            last[end + 1], back[end + 1], done = token, start, end
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.piece(piece)).tobytes()
        if len(piece) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        return b"".join(map(self.__getitem__, PATTERN.findall(text)))

    def _after_space(self, runs: list[str]) -> list[bytes]:
        return [self.plain(" " + r) for r in runs]

    def encode(self, text: str | None) -> bytes:
        """Ids of one text, 4 bytes each; the strings of special tokens in it are those tokens."""
        text = text or ""
        if self.end is None or not self.end.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.end.finditer(text):
            out += [self.plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The text of ids; those that the vocabulary doesn't have stand for nothing, as in the library."""
        known = np.frombuffer(ids, "<u4")
        if len(known) and known.max() >= len(self.bytes):
            known = known[known < len(self.bytes)]
        return b"".join(map(self.bytes.__getitem__, known.tolist())).decode("utf-8", "replace")


def encoder(path: str = VOCABULARY) -> Encoder:
    """One for each worker and file."""
    return held(("bpe", path), "encoder", lambda: Encoder(path))


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens long, ids array<int>. A null or empty text has no ids; every row is returned."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path).runs
        for batch in bounded(batches, 1, TEXT, holding=True):
            ids, ends = own.encode(batch.column(1))
            ends = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.view(np.int32)))],
                ["doc_id", "n_tokens", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>")


def decoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs (doc_id, ids array<int>) -> doc_id, text. Null or empty ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def _round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder()
    for batch in bounded(batches, 1, holding=True):
        ids, ends = own.runs.encode(batch.column(1))
        n, ids_digest, text_digest = np.diff(ends, prepend=0), [], []
        for x in np.split(ids, ends[:-1]) if len(ends) else []:
            ids_digest.append(hashlib.sha256(x).hexdigest())
            text_digest.append(hashlib.sha256(own.decode(x.tobytes()).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the text decoded from them, one row for each row of documents: repeated
    ones too, null ids as they are; a null or empty text has no ids. Empty table: no rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.mapInArrow(_round_trip, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the ids of each document's whole text."""
    return encoded(docs)


QUERIES = {"op3_bpe": op3_bpe}
ORACLE: dict[str, str] = {}
