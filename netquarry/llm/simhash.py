"""SimHash near-duplicates, linked through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. The binary Golay code of length 23 is perfect:
every 23-bit word lies within three errors of exactly one codeword. A word's keys are the
codewords that it and its 23 one-bit neighbours decode to (one key where the word is within two
errors of its codeword, else six), and any two words within two errors of each other have a
neighbour in common, hence a key in common. At most two errors over three segments leave one
segment without any (pigeonhole), and the next segment has at most two: so every pair to be
linked shares one of about 16 keys (number, an exact segment, a Golay key of the next), each
of 33 bits and more.

Buckets of up to MEDIUM fingerprints are verified pair by pair inside a row. Members of larger
buckets are keyed again by the fingerprint and its 64 one-bit neighbours: two fingerprints meet
in one of those exactly if they differ in two bits or fewer, such a group has 65 members at most,
and a star around its least one replaces its pairs. So the work is linear in the fingerprints,
whatever the sizes of the buckets. Copies share one fingerprint and are counted once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import jaccard
from .common import bounded, settled, shielded, table, written
from .components import components

SEED = 42
WORDS = 3
#: Fingerprints link at this many differing bits or fewer: what the Golay keys guarantee.
RADIUS = 2
#: Largest bucket whose pairs are verified directly.
MEDIUM = 24
#: Fingerprints of more than one in so many rows are joined by broadcast: there are fewer than that.
HOT = 1000
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the binary Golay code (23, 12).
GENERATOR = 0b110001110101


def fingerprint(text: str | None) -> int:
    """SimHash of a text's word shingles as an unsigned 64-bit number; 0 without words (or text)."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    if len(words) < WORDS:
        words = [b" ".join(words)]
        shingles = words
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    hashed = xxhash.xxh64_intdigest
    return majority(np.fromiter((hashed(s, SEED) for s in shingles), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, 1):
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(parity of each 12-bit message, least error pattern of each 11-bit syndrome)."""
    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    parity = np.array([remainder(m << 11) for m in range(1 << 12)], np.int64)
    one = [remainder(1 << i) for i in range(23)]
    leader = np.zeros(1 << 11, np.int64)
    for i in range(23):
        leader[one[i]] = 1 << i
        for j in range(i):
            leader[one[i] ^ one[j]] = 1 << i | 1 << j
            for k in range(j):
                leader[one[i] ^ one[j] ^ one[k]] = 1 << i | 1 << j | 1 << k
    return parity, leader


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    parity, leader = golay()
    return (words ^ leader[(words & 0x7FF) ^ parity[words >> 11]]) >> 11


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the distinct codeword indices of each word and its one-bit neighbours."""
    flips = np.concatenate([[0], 1 << np.arange(23)])
    keys = np.sort(nearest(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        bits = fps.view(np.uint64)
        parts = [((bits >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
        for i in range(3):
            row, key = golay_keys(parts[(i + 1) % 3])
            yield pa.RecordBatch.from_arrays(
                [pa.array((i << 34) | (parts[i][row] << 12) | key), pa.array(fps[row])], ["key", "fp"]
            )


def links(fps: DataFrame) -> DataFrame:
    """fp (distinct longs, no nulls) -> edges (a, b) whose components are those of all pairs within RADIUS."""
    keys = written(fps.select("fp").mapInArrow(_keys, "key long, fp long"), "golay")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = written(sizes, "buckets")
    close = F.expr(f"bit_count(a ^ b) <= {RADIUS}")
    pairs = sizes.where("n = 2").select("a", "b").where(close)
    members = keys.join(sizes.where("n > 2").select("key", "n"), "key")
    medium = (
        members.where(F.col("n") <= MEDIUM)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("fp")).alias("m"))
        .select(
            F.explode(
                F.expr(
                    "flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), "
                    f"y -> bit_count(x ^ y) <= {RADIUS}), y -> struct(x AS a, y AS b))))"
                )
            ).alias("p")
        )
        .select("p.a", "p.b")
    )
    middle = F.explode(F.expr("array_append(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)), fp)"))
    crowd = written(members.where(F.col("n") > MEDIUM).select("fp").distinct(), "crowd").select("fp", middle.alias("mid"))
    least = crowd.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = crowd.join(least.select("mid", "a"), "mid").select("a", F.col("fp").alias("b"))
    return pairs.union(medium).union(stars).where("a <> b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any more) -> doc_id, fp long, component_id, one row for each row of docs.

    component_id is the smallest doc_id that links reach. A null or empty text and one of white
    space only have fingerprint 0 and link like any other. Repeated rows are each returned. A null
    doc_id is kept; it is smallest only in a component without any other. Empty input: no rows.
    """
    fps = written(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    least = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    root = written(components(links(least)), "roots")
    of = root.join(least, root["node"] == least["fp"]).select("fp", "first", "root")
    merged = of.groupBy("root").agg(F.min("first").alias("smallest"))
    linked = of.join(merged, "root").select("fp", F.col("smallest").alias("linked"))
    named = written(least.join(linked, "fp", "left").select("fp", F.coalesce("linked", "first").alias("component_id"), "n"), "named")
    # fewer than HOT fingerprints have more than that share of the rows: theirs don't meet in one task
    rows = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = named.where(F.col("n") * HOT > rows).select("fp", "component_id")
    few = fps.join(F.broadcast(often), "fp", "left_anti").join(named.where(F.col("n") * HOT <= rows), "fp")
    return few.select("doc_id", "fp", "component_id").union(fps.join(F.broadcast(often), "fp").select("doc_id", "fp", "component_id"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _marked(at: int):
    """Appends node, the hash of a text's words, and fp, the SimHash of its distinct five-word shingles."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, at):
            words = [jaccard.words(t) for t in batch.column(at).to_pylist()]
            names = np.array([jaccard.name(w) for w in words], np.uint64)
            fps = np.array([majority(jaccard.shingles_of(w).view(np.uint64)) for w in words], np.uint64)
            yield batch.append_column("node", pa.array(names.view(np.int64))).append_column("fp", pa.array(fps.view(np.int64)))

    return marked


def proposed(fps: DataFrame) -> DataFrame:
    """fps (node, fp) -> (a, b), pairs of nodes: those of one fingerprint with the least of them, and the least ones of
    fingerprints that Golay keys link."""
    least = written(fps.groupBy("fp").agg(F.min("node").alias("least")), "least")
    same = fps.join(least, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    end = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}"))
    near = links(least).join(end("a"), "a").join(end("b"), "b").select("node_a", "node_b")
    return same.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of the rows that links of five-word Jaccard similarity 0.8 or more join one stays, whatever their
    doc_ids: the smallest doc_id's (a null one only where no row has any), of several the first by its text, then by
    the other columns that have an order.

    Golay keys of the texts' SimHash fingerprints propose pairs, which their shingle sets verify. Texts as similar as that may
    differ in more bits than any keys can bridge; an exact join of the sets links those. Rows with a null or
    repeated doc_id stay where their texts are no near duplicates. Texts without words are alike. No rows: none.
    """
    settled(spark)  # of the stage before
    inner, restored = shielded(docs, "doc_id", "text")
    schema = StructType([*inner.schema.fields, StructField("node", LongType()), StructField("fp", LongType())])
    # columns without an order go along as those of the row that stays
    loose = [c for c in inner.columns if re.search("map|variant", inner.schema[c].dataType.simpleString())]
    order = F.struct(F.col("doc_id").isNull().alias("none"), *dict.fromkeys(["doc_id", "text", *[c for c in inner.columns if c not in loose]]))
    least = lambda r: [F.min(r).alias("r"), *[F.min_by(c, r).alias(c) for c in loose]]
    rows = inner.mapInArrow(_marked(inner.columns.index("text")), schema)
    distinct = written(rows.groupBy("node").agg(*least(order), F.min("fp").alias("fp")), "distinct")
    root = jaccard.groups(distinct.select("node", "r.text"), proposed(distinct.select("node", "fp")))
    alone = distinct.join(root, "node", "left_anti").select("r", *loose)
    linked = distinct.join(root, "node").groupBy("root").agg(*least(F.col("r"))).select("r", *loose)
    return restored(alone.union(linked).select(*[c if c in loose else F.col(f"r.{c}").alias(c) for c in inner.columns]))


QUERIES = {"op2_simhash": op2_simhash}
ORACLE: dict[str, str] = {}
