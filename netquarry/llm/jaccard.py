"""Near duplicates by Jaccard similarity of five-word shingle sets: an exact join by prefixes.

Two sets whose similarity is SIMILAR or more share one of the first |x| - ceil(SIMILAR |x|) + 1
shingles of each, under any one order of all shingles. The order here puts shingles that a sample of
texts has often last, so that common lines make no candidates; what the sample misses costs time,
never a pair. Texts that share a prefix shingle, whose sizes and places in the prefixes admit the
similarity, are candidates, and their sets are intersected.

Components are wanted, not pairs. So pairs that a caller proposes are tried first. Then each text is held
only against PIVOTS pivots of each of its prefix shingles whose texts aren't in one component yet, in TURNS turns with
different pivots, some of them the texts with most links so far; at last all candidates that are still in different components are, few as they are
then. No pair between components is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, kept, settled, written
from .components import components

SEED = 42
SHINGLE = 5
#: Similarity from which texts are linked: OVER / UNDER.
OVER, UNDER = 4, 5
#: Turns of pivots before all pairs, pivots of a shingle in each, and how many of them are those with most links; texts up to which the sample that gives the order
#: has all, of how many it has one beyond that, how often in it a shingle is common, and most of these.
TURNS, PIVOTS, CENTRAL = 2, 2, 1
SAMPLE, ONE_IN, COMMON, MOST = 10_000, 4, 4, 500_000
#: 64-bit words of the bitmap that spares the shuffle of shingles that one text alone has.
SLOTS = 1 << 17
#: 64-bit words of a set's sketch, and the columns of sets.
SKETCH = 32
SETS = "node long, own array<long>, n int, bits array<long>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces


def name(got: list[bytes]) -> int:
    """Hash of a text's words: the same for copies, and for all texts without words."""
    return xxhash.xxh3_64_intdigest(b" ".join(got), SEED)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes (int64) of a text's shingles; a text shorter than one is its own."""
    return shingles_of(words(text))


def shingles_of(got: list[bytes]) -> np.ndarray:
    if not got:
        return np.zeros(0, np.int64)
    hashed = xxhash.xxh3_64_intdigest
    h = np.fromiter((hashed(w, SEED) for w in got), np.uint64, len(got))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, min(len(h), SHINGLE), np.uint64)
    for k in range(min(len(h), SHINGLE)):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((out ^ (out >> np.uint64(32))).view(np.int64))


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set that one of those of any similar set is among, the least common first."""
    often = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        often = np.where(common[at] == own, counts[at], 0)
    return own[np.lexsort((own, often))][: len(own) - -(-OVER * len(own) // UNDER) + 1]


def _marked(marks, keys: np.ndarray) -> np.ndarray:
    """Which keys the bitmap has."""
    return marks.value[(keys >> 6) & (SLOTS - 1)] >> (keys & 63).astype(np.uint64) & np.uint64(1) == 1


def sketch(own: np.ndarray) -> np.ndarray:
    """SKETCH words (int64) with one bit set for each shingle of a set: a bit of one set's that another's lacks is a shingle
    that the other set lacks."""
    bits = np.zeros(SKETCH * 64, np.uint8)
    bits[own & (SKETCH * 64 - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _sets(marks=None):
    """Rows of node, own, its text's shingles, their number and their sketch; with marks (a bitmap) only of marked nodes."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            if marks is not None:
                batch = batch.filter(pa.array(_marked(marks, batch.column(0).to_numpy(zero_copy_only=False))))
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.int64)])
            bits = np.concatenate([*map(sketch, sets), np.zeros(0, np.int64)])
            begins = np.arange(len(sets) + 1, dtype=np.int32) * SKETCH
            lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(v)) for e, v in ((ends, flat), (begins, bits))]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists[0], pa.array(np.diff(ends)), lists[1]], ["node", "own", "n", "bits"])

    return sets_of


def _keyed(shared, marks=None):
    """Rows of key, node, n, at; with marks (a bitmap) only those whose key is marked."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for part in bounded(batches, 1):
            sets = [shingles(t) for t in part.column(1).to_pylist()]
            firsts = [prefix(s, common, counts) for s in sets]
            n = [len(f) for f in firsts]
            columns = (
                np.concatenate([*firsts, np.zeros(0, np.int64)]), np.repeat(part.column(0).to_numpy(zero_copy_only=False), n),
                np.repeat([len(s) for s in sets], n).astype(np.int32), np.concatenate([*map(np.arange, n), np.zeros(0)]).astype(np.int32),
            )
            if marks is not None:
                kept = _marked(marks, columns[0])
                columns = tuple(c[kept] for c in columns)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "n", "at"])

    return keyed


def _admitted(other: str, m: str, at: str):
    """Whether a row's text and another may be similar, by their sizes and places of the shingle."""
    shared = f"least(n - at, {m} - {at})"
    return F.expr(f"node <> {other} AND {UNDER} * least(n, {m}) >= {OVER} * greatest(n, {m}) AND {OVER + UNDER} * {shared} >= {OVER} * (n + {m})")


def _pairs(rows: DataFrame, other: str) -> DataFrame:
    return rows.select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b")).distinct()


def _similar(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of pairs (a, b) whose texts' sets have the similarity, written. A bitmap picks the texts, which aren't shuffled; the
    joins are exact. Sketches, an eighth of a usual set, come first: the shingles that one set surely lacks of the other bound
    the intersection, and only sets of pairs that may still be similar are joined."""
    marks = texts.sparkSession.sparkContext.broadcast(_marks(_ends(pairs)))
    sets, drop = kept(texts.select("node", "text").mapInArrow(_sets(marks), SETS), "sets")
    side = lambda c, *of: sets.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in of])
    lacks = lambda x, y: f"aggregate(zip_with(bits_{x}, bits_{y}, (x, y) -> int(bit_count(x & ~y))), 0, (s, v) -> s + v)"
    enough = f"{OVER + UNDER} * %s >= {OVER} * (n_a + n_b)"
    met = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b")
    maybe, done = kept(met.where(enough % f"least(n_a - {lacks('a', 'b')}, n_b - {lacks('b', 'a')})").select("a", "b"), "maybe")
    sets = sets.join(_ends(maybe).select(F.col("key").alias("node")).distinct(), "node", "left_semi")
    both = maybe.join(side("a", "n", "own"), "a").join(side("b", "n", "own"), "b")
    out = written(both.where(enough % "size(array_intersect(own_a, own_b))").select("a", "b"), "links")
    drop()
    done()
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("key"))


def _turn(members: DataFrame, edges: DataFrame, used: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, Callable[[], None]]:
    """(key, node, n, at, root of the members of keys whose texts are still in several components; those keys with
    their pivots; a function that deletes the former). Partial aggregates only: no key's members are gathered."""
    root = written(components(edges), "roots")
    links = edges.select(F.explode(F.array("a", "b")).alias("node")).join(used, "node", "left_anti").groupBy("node").agg(F.count("*").alias("links"))
    told = written(root.join(links, "node", "left"), "told")
    rooted = members.join(told, "node", "left").select("key", "node", "n", "at", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    left, drop = kept(rooted.join(apart, "key", "left_semi"), "members")
    least = []
    for i in range(PIVOTS):  # nodes are hashes: their own order, turned by each turn, is random
        order = [(-F.col("links")).alias("o")] if i < CENTRAL else []
        mine = F.col("node").bitwiseXOR(F.xxhash64(F.lit(turn * PIVOTS + i))).alias("h")
        least.append(F.min(F.struct(*order, mine, *[F.col(c).alias(f"p_{c}") for c in ("node", "place", "root")])))
    chosen = F.array(*[F.struct(*[F.col(f"p{i}.p_{c}") for c in ("node", "place", "root")]) for i in range(PIVOTS)])
    return left, left.withColumn("place", _place()).groupBy("key").agg(*[x.alias(f"p{i}") for i, x in enumerate(least)]).select("key", F.array_distinct(chosen).alias("pivots")), drop


def _place():
    """A text's size and the shingle's place in its prefix, as one number."""
    return F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))


def _marks(keys: DataFrame) -> np.ndarray:
    """A bitmap of 64 SLOTS bits with those of the keys: whatever their number, its size is the same."""
    word = F.expr(f"int(shiftright(key, 6) & {SLOTS - 1}L)").alias("word")
    told = keys.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, int(key & 63L))")).alias("bits")).toPandas()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.uint64)
    out[told["word"].to_numpy(np.int64)] = told["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def groups(texts: DataFrame, links: DataFrame) -> DataFrame:
    """texts (node long, the name() of its text, each once; text), links (a, b: pairs of nodes that may be similar, to be
    tried first) -> node, root of the texts similar to another, as components()."""
    texts = texts.select("node", "text")
    settled(texts.sparkSession)
    # a share of the texts, not a number: else what is just not common is in more texts the more there are, and pairs grow with the square
    share = min(ONE_IN, max(1, texts.count() // SAMPLE))
    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).mapInArrow(_sets(), SETS)
    common = sample.select(F.explode("own").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    common = written(common, "common").orderBy(F.desc("n"), "s").limit(MOST).toPandas().sort_values("s")  # the order of shingles only
    shared = texts.sparkSession.sparkContext.broadcast((common["s"].to_numpy(np.int64), common["n"].to_numpy(np.int64)))
    tried = written(links.select("a", "b").where("a <> b").distinct(), "pairs")
    edges = _similar(texts, tried)
    keyed = "key long, node long, n int, at int"
    several = texts.mapInArrow(_keyed(shared), keyed).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    several = written(several, "several")
    marks = texts.sparkSession.sparkContext.broadcast(_marks(several))
    members, drop = kept(texts.mapInArrow(_keyed(shared, marks), keyed).join(several, "key", "left_semi"), "keys")
    used = texts.select("node").limit(0)
    for turn in range(TURNS + 1):
        settled(texts.sparkSession)
        before, (members, pivots, drop) = drop, _turn(members, edges, used, turn)
        before()
        if turn < TURNS:
            pivots = written(pivots, "pivots")
            used = used.union(pivots.select(F.explode("pivots.p_node").alias("node")))
            asked = pivots.select("key", F.inline("pivots")).withColumns({"p_n": F.expr("int(shiftright(p_place, 32))"), "p_at": F.expr("int(p_place & 4294967295L)")})
            found = members.join(asked, "key").where("root <> p_root")
        else:
            other = members.select("key", *[F.col(c).alias(f"p_{c}") for c in ("node", "n", "at", "root")])
            found = members.join(other, "key").where("root <> p_root AND node < p_node")
        pairs = written(_pairs(found.where(_admitted("p_node", "p_n", "p_at")), "p_node").join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(pairs)
        edges = edges.union(_similar(texts, pairs))
        members = members.drop("root", "links")
    drop()
    return written(components(edges), "roots")
