"""Benchmark decontamination: a BM25 inverted index of test items, searched by block maxima.

The roles are turned round: test items are indexed and every training document is a query, with the
distinct terms of all its passages together, since an item's parts may stand far apart. Scores are
BM25 divided by the item's score for its own text.

An item is retrieved from the least score on that a document with OVERLAP of its shingles can have:
a word that a document lacks takes all shingles with it, a shingle has SHINGLE words at most, so the
words that can be lacking have SHINGLE times the shingles that may be missing between them; the
heaviest such words (in part, at the end) give the bound.

Items are sorted by length and cut into blocks. For each term the index keeps the largest impact
in each block; a block whose maxima, summed over a document's distinct terms, miss its items' least bound is
skipped, and only the postings of the remaining blocks are added up exactly: all items at or above
their bounds are found. They are then verified: at least OVERLAP of the item's distinct word
shingles, its question and its answer together, must occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, shielded, table, written

WORD = re.compile(r"[^\W_]+")
#: Words of a shingle, and the share of an item's shingles that makes a document contaminated.
SHINGLE, OVERLAP = 5, 0.8
#: BM25's parameters and the share of an item's own score from which search() finds it if no bounds are given.
K1, B, THRESHOLD = 1.2, 0.75, 0.45
BLOCK = 32
#: Most items that are broadcast at a time; a larger benchmark takes several passes over the documents.
ITEMS = 20_000
#: And most bytes of their texts.
AT_ONCE = 32 << 20
#: The last sentence or line of an item is its answer, the rest its question.
ANSWER = re.compile(r"(?<=[.?!:])\s+(?=\S)|\n+(?=.*\w)")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(got: list[str]) -> set[tuple[str, ...]]:
    """Distinct shingles; a sequence shorter than one is its own."""
    return {tuple(got[i : i + SHINGLE]) for i in range(max(1, len(got) - SHINGLE + 1))} if got else set()


def parts(text: str) -> tuple[str, str]:
    """(question, answer); the answer is empty where there is no second part with words."""
    cuts = [m for m in ANSWER.finditer(text) if WORD.search(text, m.end()) and WORD.search(text[: m.start()])]
    return (text[: cuts[-1].start()], text[cuts[-1].end() :]) if cuts else (text, "")


@dataclass
class Index:
    """Terms are numbers from 0. Postings and block maxima of term t lie between starts[t] and
    starts[t + 1]. items: for each item (id, shingles of all, of the question, of the answer)."""

    terms: dict[str, int]
    starts: np.ndarray
    units: np.ndarray
    impacts: np.ndarray
    block_starts: np.ndarray
    blocks: np.ndarray
    maxima: np.ndarray
    item_of: np.ndarray
    items: list[tuple]
    bounds: np.ndarray

    def search(self, passage: np.ndarray, threshold: float | np.ndarray = THRESHOLD) -> np.ndarray:
        """Numbers of all units whose score for the distinct terms of a passage reaches the threshold (one for all, or of each)."""
        n = -(-len(self.item_of) // BLOCK)
        at = _ranges(self.block_starts, passage)
        bound = np.bincount(self.blocks[at], self.maxima[at], n)
        threshold = np.broadcast_to(np.asarray(threshold, float), self.item_of.shape)
        live = bound >= np.minimum.reduceat(threshold, np.arange(0, len(threshold), BLOCK)) - 1e-9
        if not live.any():
            return np.zeros(0, np.int64)
        at = _ranges(self.starts, passage)
        at = at[live[self.units[at] // BLOCK]]
        return np.nonzero(np.bincount(self.units[at], self.impacts[at], len(self.item_of)) >= threshold - 1e-9)[0]

    def contaminations(self, text: str | None) -> list[tuple[int, int, int, float, float]]:
        """(item_id, shingles, shared shingles, share of the question's, of the answer's) of each item that text holds."""
        got = words(text)
        if not got or not self.items:
            return []
        get = self.terms.get
        ids = np.fromiter((get(w, -1) for w in got), np.int64, len(got))
        passage = np.unique(ids[ids >= 0])
        found = self.item_of[self.search(passage, self.bounds)].tolist() if len(passage) else []
        if not found:
            return []
        own, out = shingles(got), []
        share = lambda part: len(part & own) / len(part) if part else 1.0
        for item_id, whole, question, answer in (self.items[i] for i in sorted(found)):
            # a text shorter than a shingle is its own only shingle: found where its words stand together
            short = len(next(iter(whole)))
            mine = own if short == SHINGLE else {tuple(got[i : i + short]) for i in range(len(got) - short + 1)}
            if (n := len(whole & mine)) >= OVERLAP * len(whole):
                out.append((item_id, len(whole), n, share(question), share(answer)))
        return out


def _ranges(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All positions between starts[r] and starts[r + 1], for each r in rows."""
    first, n = starts[rows], starts[rows + 1] - starts[rows]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


def _grouped(keys: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=size))])


def least_score(got: list[str], impact: dict[str, float]) -> float:
    """A bound on the summed impacts, 1 for all, of those words of an item that a document with OVERLAP of its shingles has."""
    own = shingles(got)
    held: dict[str, int] = {}
    for s in own:
        for w in set(s):
            held[w] = held.get(w, 0) + 1
    missing = len(own) - int(np.ceil(OVERLAP * len(own) - 1e-9))
    left, lost = SHINGLE * missing, 0.0
    for w in sorted((w for w in held if held[w] <= missing), key=lambda w: -impact[w] / held[w]):
        lost += impact[w] * min(1.0, left / held[w])
        left -= held[w]
        if left <= 0:
            break
    return 1 - lost


def build(items: list[tuple[int, str]], documents: dict[str, int] | None = None, total: int | None = None) -> Index:
    """Index of (item_id, text); items without words are left out. documents: in how many of total items
    each word occurs, over the whole benchmark (of these items, if not given)."""
    kept = [(i, t, words(t)) for i, t in items]
    kept = [x for x in kept if x[2]]
    if documents is None:
        documents, total = {}, len(kept)
        for _, _, got in kept:
            for w in set(got):
                documents[w] = documents.get(w, 0) + 1
    units = sorted((got, k) for k, (_, _, got) in enumerate(kept))
    units.sort(key=lambda x: len(x[0]))
    mean = sum(len(u) for u, _ in units) / max(1, len(units))
    terms: dict[str, int] = {}
    rows: list[tuple[int, int, float]] = []
    bounds = []
    for u, (got, _) in enumerate(units):
        tf: dict[str, int] = {}
        for w in got:
            tf[w] = tf.get(w, 0) + 1
        norm = K1 * (1 - B + B * len(got) / mean)
        idf = {w: np.log1p((total - documents[w] + 0.5) / (documents[w] + 0.5)) for w in tf}
        impact = {w: idf[w] * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
        whole = sum(impact.values())
        impact = {w: x / whole for w, x in impact.items()}
        rows += [(terms.setdefault(w, len(terms)), u, x) for w, x in impact.items()]
        bounds.append(least_score(got, impact))
    rows.sort()
    t, u = (np.array([r[c] for r in rows], np.int64) for c in (0, 1))
    x = np.array([r[2] for r in rows], float)
    blocks = -(-len(units) // BLOCK)
    key = t * blocks + u // BLOCK
    first = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1]) if len(key) else np.zeros(0, np.int64)
    top = np.maximum.reduceat(x, first) if len(key) else x
    listed = []
    for item_id, text, got in kept:
        question, answer = parts(text)
        listed.append((item_id, shingles(got), shingles(words(question)), shingles(words(answer))))
    return Index(
        terms, _grouped(t, len(terms)), u, x, _grouped(key[first] // max(1, blocks), len(terms)), key[first] % max(1, blocks), top,
        np.array([k for _, k in units], np.int64), listed, np.array(bounds, float),
    )


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [w for text in batch.column(0).to_pylist() for w in set(words(text))]
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], ["word"])


def indexes(spark: SparkSession, benchmark: DataFrame, items_at_once: int = ITEMS) -> Iterator:
    """Broadcast indexes of the benchmark's items, about items_at_once items and AT_ONCE bytes of them in each."""
    known = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    told = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    # in how many items each word occurs, over the whole benchmark
    frequency = written(known.select("text").mapInArrow(_distinct_words, "word string").groupBy("word").agg(F.count("*").alias("n")), "words")
    pieces = max(1, -(-told["n"] // items_at_once), -(-told["bytes"] // AT_ONCE))
    for piece in range(pieces):
        part = known if pieces == 1 else known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces)) == piece)
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=str)  # about items_at_once rows
        own = part.select("text").mapInArrow(_distinct_words, "word string").distinct()
        counts = frequency.join(own, "word", "left_semi").toPandas()  # the words of those items
        yield spark.sparkContext.broadcast(build(rows, dict(zip(counts["word"], counts["n"].tolist(), strict=True)), told["n"]))


def contaminated(docs: DataFrame, benchmark: DataFrame, items_at_once: int = ITEMS) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, n_shingles, n_shared, question, answer.

    One row for each pair of a doc_id and an item that one of its texts holds; rows of one doc_id with several texts
    give the largest overlap. Null or empty texts hold nothing and are held by nothing; null ids are kept as they are.
    Repeated rows and ties change nothing. The benchmark is indexed items_at_once items at a time.
    """
    out = None
    for index in indexes(docs.sparkSession, benchmark, items_at_once):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches, 1):
                texts = batch.column(1).to_pylist()
                found = [(i, *x) for i, text in enumerate(texts) for x in index.value.contaminations(text)]
                columns = [batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))]
                for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), 1):
                    columns.append(pa.array([f[k] for f in found], kind))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_shingles", "n_shared", "question", "answer"])

        got = docs.select("doc_id", "text").mapInArrow(
            search, "doc_id long, item_id long, n_shingles long, n_shared long, question double, answer double"
        )
        out = got if out is None else out.union(got)
    best = F.max(F.struct("n_shared", "n_shingles", "question", "answer")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, items_at_once: int = ITEMS) -> DataFrame:
    """The rows of docs (text, any more columns) whose text holds no item: decided by row, whatever its ids, without a
    shuffle. Null and empty texts stay."""
    at = docs.columns.index("text")
    for index in indexes(docs.sparkSession, benchmark, items_at_once):

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches, at):
                yield batch.filter(pa.array([not index.value.contaminations(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared of contaminated(), over all documents and items. Empty tables: no rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of documents whose text holds a benchmark item go; each row is judged by its own text, so that null
    and repeated ids make no difference. No rows: none. All columns stay."""
    inner, restored = shielded(docs, "doc_id", "text")
    return restored(clean(inner, table(spark, sf_dir, "benchmark", "item_id", "text")))


_SHINGLES = """
  SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
  FROM (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM %s) WHERE len(w) > 0"""

#: Items of fewer than five words are left to the tests.
ORACLE_SQL = f"""
WITH d AS ({_SHINGLES % "(SELECT doc_id AS id, text FROM documents)"}),
b AS ({_SHINGLES % "(SELECT item_id AS id, text FROM benchmark)"}),
n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n) AS n_shingles, count(*) AS n_shared
FROM b JOIN d USING (s) JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n.n)"""

QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE = {"op7_decontaminate": ORACLE_SQL}
