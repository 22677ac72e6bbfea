"""Exact top-k inner products over a bit-sliced index.

Each component x of a vector becomes the integer floor(1024 * x). The index holds blocks of BLOCK
vectors; of each component it keeps the part above the lowest bits as slices, one bitmap over the
block's rows for each bit, and the whole integers beside them. A query adds up the slices, shifted
by the bits of its own components, with carry-save adders over bitmaps (a negative component takes
the complement of the slices), which gives the slices of every row's score without the low parts.
The k-th largest of these is found from the most significant slice downward; rows that the low
parts could still lift to it are selected by comparing slices, and their scores computed exactly.
So the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SCALE = 1024
#: Vectors of a block; slices kept of each component.
BLOCK, SLICES = 8192, 7
#: Queries that are sent to the executors at a time.
PAGE = 4096
K = 10
#: Vectors with larger integers have blocks of their own, so that they don't coarsen the slices of others.
WIDE = 1 << 24
#: Integers of this size and more leave a long when they are scaled: such vectors take no part.
LARGEST = 1 << 62


def integers(vector) -> np.ndarray | None:
    """floor(SCALE * x) of each component as a double; None where a vector takes no part."""
    if vector is None or len(vector) == 0 or any(x is None for x in vector):
        return None
    x = np.asarray(vector, np.float64)
    if not np.isfinite(x).all() or (np.abs(x := np.floor(SCALE * x)) >= LARGEST).any():
        return None
    return x.astype(np.int64)


class Block:
    """Some vectors of one length: vec_ids, integers (rows, length), and slices of each component."""

    def __init__(self, vec_ids: np.ndarray, values: np.ndarray, shift: int, least: int, slices: np.ndarray):
        self.vec_ids, self.values, self.shift, self.least, self.slices = vec_ids, values, shift, least, slices

    @classmethod
    def of(cls, vec_ids: np.ndarray, values: np.ndarray) -> Block:
        low, high = int(values.min()), int(values.max())
        shift = max(0, (high - low).bit_length() - SLICES)
        while (high >> shift) - (low >> shift) >> SLICES:
            shift += 1
        least = low >> shift
        return cls(vec_ids, values, shift, least, cls.sliced((values >> shift) - least))

    @staticmethod
    def sliced(parts: np.ndarray) -> np.ndarray:
        """(length, SLICES, words) bitmaps over rows."""
        rows, length = parts.shape
        padded = np.zeros((-(-rows // 64) * 64, length), np.uint8)
        padded[:rows] = parts
        bits = (padded.T[:, None, :] >> np.arange(SLICES, dtype=np.uint8)[None, :, None]) & 1
        return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, scores) of the k best rows but the query's own, ties to the smaller vec_id; scores beyond a long are left out."""
        words = self.slices.shape[2]
        mine = np.zeros(words * 64, np.uint8)
        mine[: len(self.vec_ids)] = self.vec_ids != query_id
        taking = np.packbits(mine, bitorder="little").view(np.uint64)
        if not (k := min(k, int(mine.sum()))):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = sum(map(abs, query.tolist()))
        if size * max(abs(int(self.values.max())), abs(int(self.values.min()))) >= 1 << 62:
            return self._top_of_large(query, query_id, k)
        total = added(self.slices, query)
        # low parts lie between 0 and 2 ** shift - 1: so far two scores of one sliced sum may differ
        slack = -(-((1 << self.shift) - 1) * size >> self.shift) if self.shift else 0
        near = at_least(total, kth_largest(total, taking, k) - slack, taking)
        rows = np.nonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))[0]
        scores, ids = self.values[rows].astype(np.int64) @ query, self.vec_ids[rows]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


    def _top_of_large(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """top() of whole integers, where sums might leave a long."""
        rows = np.nonzero(self.vec_ids != query_id)[0]
        scores = self.values[rows].astype(object) @ query.astype(object)
        best = sorted((-s, i) for s, i in zip(scores.tolist(), self.vec_ids[rows].tolist(), strict=True) if -(1 << 63) <= s < 1 << 63)[:k]
        return np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)


def added(slices: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices, least significant first, of the sum over components of |q| times the component's part, or its complement
    where q is negative."""
    weights: list[list[np.ndarray]] = []
    size = np.abs(query)
    for bit in range(int(size.max()).bit_length()):
        up, down = ((size >> bit & 1) == 1) & (query > 0), ((size >> bit & 1) == 1) & (query < 0)
        for s in range(slices.shape[1]):
            while len(weights) <= bit + s:
                weights.append([])
            weights[bit + s] += [slices[up, s], ~slices[down, s]]
    out, carried = [], []
    at = 0
    while at < len(weights) or carried:
        bitmaps = np.concatenate([*(weights[at] if at < len(weights) else []), *carried])
        carried = []
        while len(bitmaps) > 2:
            n = len(bitmaps) // 3
            x, y, z = bitmaps[:n], bitmaps[n : 2 * n], bitmaps[2 * n : 3 * n]
            odd = x ^ y
            carried.append((x & y) | (odd & z))
            bitmaps = np.concatenate([odd ^ z, bitmaps[3 * n :]])
        if len(bitmaps) == 2:
            carried.append((bitmaps[0] & bitmaps[1])[None])
            bitmaps = (bitmaps[0] ^ bitmaps[1])[None]
        out.append(bitmaps[0] if len(bitmaps) else np.zeros(slices.shape[2], np.uint64))
        at += 1
    return out


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth_largest(total: list[np.ndarray], taking: np.ndarray, k: int) -> int:
    """The k-th largest value among the rows of the bitmap taking, from the most significant slice downward."""
    value, left, open_ = 0, k, taking
    for bit in range(len(total) - 1, -1, -1):
        ones = open_ & total[bit]
        if (n := count(ones)) >= left:
            open_, value = ones, value | 1 << bit
        else:
            open_, left = open_ & ~total[bit], left - n
    return value


def at_least(total: list[np.ndarray], bound: int, taking: np.ndarray) -> np.ndarray:
    """Bitmap of the rows of taking whose value is bound or more."""
    if bound <= 0:
        return taking
    above, equal = np.zeros_like(taking), taking
    for bit in range(max(len(total), bound.bit_length()) - 1, -1, -1):
        one = total[bit] if bit < len(total) else np.zeros_like(taking)
        if bound >> bit & 1:
            equal = equal & one
        else:
            above, equal = above | (equal & one), equal & ~one
    return above | equal


_INDEX = "length int, n int, shift int, least long, width string, vec_ids binary, integers binary, slices binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[tuple[int, bool], list[tuple[int, np.ndarray]]] = {}

    def block(kind: tuple[int, bool]) -> pa.RecordBatch:
        rows, length = waiting.pop(kind), kind[0]
        b = Block.of(np.array([r[0] for r in rows], np.int64), np.stack([r[1] for r in rows]))
        width = next(f"<i{n}" for n in (2, 4, 8) if np.abs(b.values).max() < 1 << 8 * n - 1)
        told = (length, len(rows), b.shift, b.least, width, b.vec_ids.tobytes(), b.values.astype(width).tobytes(), b.slices.tobytes())
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())
        names = [c.split()[0] for c in _INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(told, kinds, strict=True)], names)

    for batch in batches:
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if vec_id is not None and (x := integers(vector)) is not None:
                kind = len(x), bool((np.abs(x) > WIDE).any())
                waiting.setdefault(kind, []).append((vec_id, x))
                if len(waiting[kind]) == BLOCK:
                    yield block(kind)
    for kind in list(waiting):
        yield block(kind)


def index(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding) -> the bit-sliced index, one row a block, written to the shared folder.

    Takes every row but those whose vec_id is null or whose vector is null, empty, holds null or non-finite components
    or integers of LARGEST and more. Vectors of different lengths go to different blocks.
    """
    return written(vectors.select("vec_id", "embedding").mapInArrow(_index, _INDEX), "slices")


def search(indexed: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """queries (vec_id, embedding) -> query_id, rank, vec_id, score: the k rows of the index with the highest integer
    inner products, but for rows of the query's own vec_id; ties to the smaller vec_id. Vectors of another length aren't
    candidates. Of several query rows with one vec_id the least vector asks. Repeated rows of the index are each ranked.
    """
    spark = indexed.sparkSession
    asked = written(queries.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    pages = max(1, -(-asked.count() // PAGE))
    found = None
    for page in range(pages):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(pages)) == page).collect()  # about PAGE rows
        told = [(r["vec_id"], x) for r in sorted(rows) if (x := integers(r["embedding"])) is not None]
        shared = spark.sparkContext.broadcast(told)

        def answer(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    values = np.frombuffer(row["integers"], row["width"]).reshape(row["n"], row["length"])
                    slices = np.frombuffer(row["slices"], np.uint64).reshape(row["length"], SLICES, -1)
                    block = Block(np.frombuffer(row["vec_ids"], np.int64), values, row["shift"], row["least"], slices)
                    got = [(q, *block.top(x, q, k)) for q, x in shared.value if len(x) == row["length"]]
                    asking = np.repeat([q for q, _, _ in got], [len(ids) for _, ids, _ in got]).astype(np.int64)
                    flat = [np.concatenate([g[c] for g in got]) if got else np.zeros(0, np.int64) for c in (1, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array(asking), *map(pa.array, flat)], ["query_id", "vec_id", "score"])

        part = indexed.mapInArrow(answer, "query_id long, vec_id long, score long")
        found = part if found is None else found.union(part)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score by search() over all of embeddings. Empty table: no rows."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search(index(vectors), vectors.where("vec_id % 100 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

QUERIES = {"op6_topk": op6_topk}
ORACLE = {"op6_topk": ORACLE_SQL}
