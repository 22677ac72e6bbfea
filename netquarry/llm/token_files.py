"""Token ids as binary files: one concatenated array a shard, document boundaries in Elias-Fano code.

A shard holds the documents of one range of doc_id, in ascending order. Its file is

    MAGIC | ids, little-endian, 2 bytes each (4 if the vocabulary needs them)
    | boundaries | doc_ids | footer

where boundaries are the exclusive ends of the documents in the id array and doc_ids the ascending
ids less the smallest, both as Elias-Fano sequences: n values below u take n low parts of
floor(log2(u / n)) bits and a bitmap of their high parts in unary, about 2 + log2(u / n) bits a
value instead of 64. The position of every SAMPLE-th one in the bitmap is kept, so that select finds
the i-th boundary from the nearest sample. The footer is JSON, then its length and MAGIC.

Writers name each attempt's file anew; the manifest, a Parquet table that Spark commits, lists the
files that count. So retried and speculative tasks do no harm. Readers take ranges of documents, whose
offsets come from select.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, held, shared_path, table
from .runs import Runs

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The id that ends each document.
END = 2
MAGIC = b"NQIDS001"
SAMPLE = 256
#: How byte-level vocabularies write a space.
SPACE = "\u0120"
#: Runs of text that a worker remembers the ids of.
REMEMBERED = 300_000
#: Bytes of text that are encoded together.
TEXT = 8 << 20
#: Documents of a range that is read together, and about how many ids of it at a time.
RANGE, AT_ONCE = 2048, 2 << 20


class EliasFano:
    """An ascending sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v, n = values.astype(np.uint64), len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        bits = max(0, (int(v[-1]) + 1) // n).bit_length() - 1 if int(v[-1]) + 1 > n else 0
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        bitmap = np.zeros(int(ones[-1]) + 1, np.uint8)
        bitmap[ones] = 1
        return cls(n, bits, low, np.packbits(bitmap, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4" if ones[-1] < 2**32 else "<u8").tobytes())

    def sizes(self) -> dict:
        return {"n": self.n, "low_bits": self.low_bits, "sizes": [len(self.low), len(self.high), len(self.samples)]}

    def tobytes(self) -> bytes:
        return self.low + self.high + self.samples

    @classmethod
    def read(cls, raw: bytes, at: int, told: dict) -> tuple[EliasFano, int]:
        parts = []
        for size in told["sizes"]:
            parts.append(bytes(raw[at : at + size]))
            at += size
        return cls(told["n"], told["low_bits"], *parts), at

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample."""
        return int(self.selected(i, i + 1)[0])

    def selected(self, i: int, j: int) -> np.ndarray:
        """The values from the i-th to before the j-th: the bitmap from the sample before to the one behind them, and their
        low parts. Nothing else is read."""
        if i >= j:
            return np.zeros(0, np.int64)
        width = len(self.samples) // -(-self.n // SAMPLE)
        place = lambda k: int.from_bytes(self.samples[k * width : (k + 1) * width], "little")
        first, behind = i // SAMPLE, -(-j // SAMPLE)
        begin = place(first) // 8
        end = place(behind) // 8 + 1 if behind * SAMPLE < self.n else len(self.high)
        ones = np.nonzero(np.unpackbits(np.frombuffer(self.high[begin:end], np.uint8), bitorder="little"))[0] + 8 * begin
        skip = int(np.searchsorted(ones, place(first))) + i % SAMPLE
        upper = ones[skip : skip + j - i] - np.arange(i, j)
        if not self.low_bits:
            return upper
        at = i * self.low_bits
        low = np.unpackbits(np.frombuffer(self.low[at // 8 : -(-j * self.low_bits // 8)], np.uint8), bitorder="little")[at % 8 :]
        low = low[: (j - i) * self.low_bits].reshape(j - i, self.low_bits).astype(np.int64)
        return (upper << self.low_bits) | (low << np.arange(self.low_bits)).sum(1)

    def values(self) -> np.ndarray:
        """All values."""
        return self.selected(0, self.n)


class Library:
    """Ids by the tokenizers library, which is asked once for each run of text between spaces (see runs)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        self.after = np.zeros(self.size, bool)  # tokens that begin with a space
        self.after[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(SPACE)]] = True
        self.runs = Runs(self.encode, self._after_space, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()], REMEMBERED)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, 4 bytes each."""
        return array("I", self.tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()

    def _after_space(self, runs: list[str]) -> list[bytes]:
        """All runs go as one text, whose ids are cut before each token that begins with a space."""
        out: list = [None] * len(runs)
        joint = list(filter(None, runs))
        if joint:
            told = self.tokenizer.encode_batch_fast([" " + " ".join(joint)], add_special_tokens=False)[0]
            ids = np.array(told.ids, "<u4")
            at = np.nonzero(self.after[ids])[0]
            if len(at) == len(joint) and at[0] == 0:
                raw, cuts = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                cut = [raw[a:b] for a, b in pairwise(cuts)]
                if len(cut) == len(runs):
                    return cut
                told = iter(cut)
                out = [next(told) if r else None for r in runs]
        return [self.encode(" " + r) if b is None else b for r, b in zip(runs, out, strict=True)]


def library(path: str = VOCABULARY) -> Library:
    """One for each worker and file."""
    return held(("library", path), "library", lambda: Library(path))


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END) -> None:
    """docs (doc_id, text) -> shards and a manifest under path, in a file system that pyarrow and Spark both know.

    Documents are in ascending order of doc_id (null first), then text; a null text is empty. Each ends with the id end.
    Repeated rows are documents of their own. No documents: no shards. There is a shard for each partition that the
    scan of docs has, of about the same number of documents.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shards = max(1, docs.rdd.getNumPartitions())
    hashed = F.xxhash64("text")
    ordered = docs.withColumn("h", hashed).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = library(vocabulary), TaskContext.get().partitionId()
        width = "<u2" if own.size <= 1 << 16 and end < 1 << 16 else "<u4"
        store, at = fs.FileSystem.from_uri(path)
        name, out = f"shard-{number:06d}-{uuid.uuid4().hex}.ids", None
        lengths, doc_ids, nulls = array("q"), array("q"), 0
        for batch in bounded(batches, 1, TEXT, holding=True):
            if not len(batch):
                continue
            if out is None:
                store.create_dir(at, recursive=True)
                out = store.open_output_stream(f"{at}/{name}")
                out.write(MAGIC)
            ids, ends = own.runs.encode(batch.column(1))
            out.write(np.insert(ids.astype(width), ends, end).tobytes())
            lengths.frombytes((np.diff(ends, prepend=0) + 1).astype(np.int64).tobytes())
            nulls += batch.column(0).null_count
            doc_ids.frombytes(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
        if out is None:
            return
        ends, known = np.cumsum(np.frombuffer(lengths, np.int64)), np.frombuffer(doc_ids, np.int64)
        low = int(known[0]) if len(known) else 0
        boundaries, names = EliasFano.of(ends), EliasFano.of(known - low)
        told = {"ids": int(ends[-1]), "width": width, "nulls": nulls, "least": low, "boundaries": boundaries.sizes(), "doc_ids": names.sizes()}
        tail = json.dumps(told).encode()
        out.write(boundaries.tobytes() + names.tobytes() + tail + len(tail).to_bytes(8, "little") + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": [number], "file": [name], "documents": [len(lengths)], "ids": [int(ends[-1])]})

    made = ordered.mapInArrow(shard, "shard long, file string, documents long, ids long")
    made.write.parquet(f"{path}/manifest")


class Shard:
    """A shard's file (open, or its bytes), of which only what is asked for is read."""

    def __init__(self, file: pa.NativeFile | bytes):
        self.file = pa.BufferReader(file) if isinstance(file, bytes) else file
        size = self.file.size()
        told = self._part(max(0, size - len(MAGIC) - 8), len(MAGIC) + 8)
        if told[8:] != MAGIC or self._part(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a shard, or one cut short")
        tail = int.from_bytes(told[:8], "little")
        told = json.loads(self._part(size - len(told) - tail, tail))
        self.width, self.nulls, self.least = np.dtype(told["width"]), told["nulls"], told["least"]
        at = len(MAGIC) + told["ids"] * self.width.itemsize
        parts = self._part(at, sum(told["boundaries"]["sizes"]) + sum(told["doc_ids"]["sizes"]))  # some bits a document
        self.boundaries, at = EliasFano.read(parts, 0, told["boundaries"])
        self.names, _ = EliasFano.read(parts, at, told["doc_ids"])

    def _part(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ends(self, i: int, j: int) -> np.ndarray:
        """Where the document before the i-th ends (0: none), and those up to before the j-th, by select."""
        return np.concatenate([np.zeros(int(i == 0), np.int64), self.boundaries.selected(max(0, i - 1), j)])

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from begin to before end of the shard's array."""
        return np.frombuffer(self._part(len(MAGIC) + begin * self.width.itemsize, (end - begin) * self.width.itemsize), self.width)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.ids(*self.ends(i, i + 1).tolist())

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """Of the documents from the i-th to before the j-th; null ones are the first."""
        none = min(j, self.nulls) - min(i, self.nulls)
        return [None] * none + (self.names.selected(max(0, i - self.nulls), max(0, j - self.nulls)) + self.least).tolist()


def read(spark: SparkSession, path: str) -> DataFrame:
    """What write() wrote: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, in no particular order.

    A shard's start is the sum of the ids of the shards before it, over groups of shards and within them. Tasks read ranges
    of RANGE documents, each by the select structures of its shard.
    """
    manifest = spark.read.parquet(f"{path}/manifest").withColumn("part", F.floor(F.col("shard") / 1024))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before().orderBy("part")), F.lit(0)).alias("begin"))
    within = F.coalesce(F.sum("ids").over(before("part").orderBy("shard")), F.lit(0))
    shards = manifest.withColumn("within", within).join(parts, "part").select("file", (F.col("begin") + F.col("within")).alias("base"), "documents")
    ranges = shards.select("file", "base", "documents", F.explode(F.sequence(F.lit(0), F.col("documents") - 1, F.lit(RANGE))).alias("first"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(path)
        name, shard = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name = row["file"]
                    shard = Shard(store.open_input_file(f"{at}/{name}"))
                i, j = row["first"], min(row["documents"], row["first"] + RANGE)
                ends = shard.ends(i, j)
                cuts, crc = ends.tolist(), []
                while len(crc) < j - i:
                    k = len(crc)
                    behind = max(k + 1, int(np.searchsorted(ends, cuts[k] + AT_ONCE, "right")) - 1)
                    ids = shard.ids(cuts[k], cuts[behind]).astype("<u4")
                    crc += [zlib.crc32(ids[b - cuts[k] : e - cuts[k]]) for b, e in zip(cuts[k:behind], cuts[k + 1 : behind + 1], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids(i, j), pa.int64()), pa.array(ends[:-1] + row["base"]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return ranges.repartition(F.col("file"), F.col("first")).mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, repeated ones too, written and read back; a null or empty text has the end id alone. Null ids
    come first. Empty table: no rows."""
    write(table(spark, sf_dir, "documents", "doc_id", "text"), path := shared_path(spark, "token-files"))
    return read(spark, path)


QUERIES = {"op8_token_files": op8_token_files}
ORACLE: dict[str, str] = {}
