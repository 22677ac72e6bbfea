"""Connected components by randomised contraction, in joins and partial aggregates only.

Each round gives every node of the remaining graph a representative, the node of smallest
random priority among itself and its neighbours, and replaces both ends of each edge by their
representatives. An expected constant share of the nodes goes in every round, whatever the
graph's shape or diameter, so the rounds number O(log n). No group is ever collected: a hub
with millions of neighbours is one row of a partial ``min``. Once FEW edges or fewer are left,
however many there were, one task joins them exactly by union-find instead of further rounds,
each of which costs the driver ten jobs, whatever it still has to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that one task joins.
FEW = 1 << 14


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of node and rep, the least node of its component, from all edges (a, b)."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low, high = sorted((root(a), root(b)))
            above[high] = low
    both = [np.fromiter(x, np.int64, len(above)) for x in (above, map(root, above))]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["node", "rep"])


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root), one row for each node of an edge between two nodes.

    Repeated and reversed edges count once; self-loops and rows with a null end are ignored
    (their nodes are not returned unless another edge has them). No edges: no rows. The root is
    a node of the component, the same for all its nodes, and otherwise arbitrary.
    """
    live = written(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    rounds: list[DataFrame] = []
    while (left := live.count()) > FEW:
        salt = F.lit(len(rounds) + 1)
        best = lambda node: F.struct(F.xxhash64(node, salt).alias("h"), node.alias("n"))
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(best(F.col("b"))).alias("m"))
        rep = written(near.select(F.col("a").alias("node"), F.least("m", best(F.col("a")))["n"].alias("rep")), "reps")
        rounds.append(rep)
        moved = (
            live.join(rep.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a")
            .join(rep.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b")
            .where("ra <> rb")
        )
        live = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if left:
        rounds.append(written(live.repartition(1).mapInArrow(_joined, "node long, rep long"), "reps"))
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    out = rounds[0].select("node", F.col("rep").alias("root"))
    for rep in rounds[1:]:
        out = out.join(rep.select(F.col("node").alias("root"), "rep"), "root", "left").select(
            "node", F.coalesce("rep", "root").alias("root")
        )
    return out
