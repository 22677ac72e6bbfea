"""WARC fixity: Merkle trees over records and ordered offset ranges, compared from the roots down.

A record's leaf is the SHA-256 of its offset, its length and its bytes. A tree's lowest nodes stand
for ranges of RANGE bytes of an archive and hash the leaves of the records that begin there, by
offset; each node above stands for FAN adjacent ranges and hashes its children with their places.
Ranges are cut by offset, not by count, so that nodes of two replicas correspond whatever is missing
or surplus in one, and a node never gathers more than RANGE bytes' records or FAN children.

An audit joins two replicas' roots and then, level by level, only the children of nodes that
differ; leaves are joined in the differing ranges alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Bytes of a lowest range; children of a node.
RANGE, FAN = 1 << 18, 16
#: Page numbers of one archive.
PAGES = 4096


def header(url: Column, payload: Column) -> Column:
    """A WARC/1.1 response record's header, with the digest that names it."""
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.sha2(payload, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> archive, offset, length, page_id, record binary: the archives' records as laid out.

    Archive n holds the pages n * PAGES and on, by page_id, then url, then html (nulls first), one after the other; a null
    page_id is in the archive null. A null html is empty. Repeated rows are records of their own.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    whole = F.concat(header(F.col("url"), payload).cast("binary"), payload, F.lit("\r\n\r\n").cast("binary"))
    laid = pages.select(F.floor(F.col("page_id") / PAGES).alias("archive"), "page_id", "url", F.xxhash64("html").alias("h"), whole.alias("record"))
    laid = laid.withColumn("length", F.octet_length("record").cast("long"))
    before = Window.partitionBy("archive").orderBy("page_id", "url", "h", F.sha2("record", 256)).rowsBetween(Window.unboundedPreceding, -1)
    return laid.select("archive", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length", "page_id", "record")


def leaves(records_: DataFrame) -> DataFrame:
    """records (archive, offset, length, record, any more) -> the same with leaf string in the record's place."""
    place = F.concat_ws(":", "offset", "length", F.sha2(F.coalesce("record", F.lit("").cast("binary")), 256))
    return records_.withColumn("leaf", F.sha2(place, 256)).drop("record")


def tree(leaves_: DataFrame) -> list[DataFrame]:
    """leaves (archive, offset, leaf) -> levels from the lowest: (archive, node, digest), the last with one node an archive.

    A null archive is an archive (named by the digest of nothing when compared); rows with a null offset stand in range 0.
    Records of one offset are hashed in the order of their leaves. No records: one empty level.
    """
    node = F.floor(F.coalesce("offset", F.lit(0)) / RANGE)
    held = F.array_sort(F.collect_list(F.struct(F.coalesce("offset", F.lit(0)).alias("o"), "leaf")))
    low = leaves_.groupBy("archive", node.alias("node")).agg(F.sha2(F.array_join(F.transform(held, lambda x: x["leaf"]), ""), 256).alias("digest"))
    levels = [written(low, "merkle")]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        digest = F.sha2(F.array_join(F.transform(children, lambda x: F.concat_ws(":", x["node"], x["digest"])), ","), 256)
        above = levels[-1].groupBy("archive", F.floor(F.col("node") / FAN).alias("parent")).agg(digest.alias("digest"))
        levels.append(written(above.select("archive", F.col("parent").alias("node"), "digest"), "merkle"))
    return levels


def _differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes that only one side has or whose digests differ: archive, node."""
    a, b = ours.alias("a"), theirs.alias("b")
    same = F.col("a.archive").eqNullSafe(F.col("b.archive")) & (F.col("a.node") == F.col("b.node"))
    both = a.join(b, same, "full")
    pick = lambda c: F.when(F.col("a.node").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return both.where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select(pick("archive"), pick("node"))


def _within(rows: DataFrame, node: Column, parents: DataFrame) -> DataFrame:
    p = parents.select(F.col("archive").alias("p_archive"), F.col("node").alias("p_node"))
    return rows.join(p, rows["archive"].eqNullSafe(p["p_archive"]) & (node == p["p_node"]), "left_semi")


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Two replicas' leaves (archive, offset, length, leaf) -> the records in which they differ.

    Columns: archive, offset, length, status: "changed" (both have a record there, not the same), "missing" (only ours)
    or "extra" (only theirs). The length is ours where we have the record. Equal replicas, empty ones too: no rows.
    A record that one replica has several times at one offset is compared as often.
    """
    mine, other = tree(ours), tree(theirs)
    depth = max(len(mine), len(other))
    for levels in (mine, other):  # a shorter tree is continued upwards: its root is a lone first child
        while len(levels) < depth:
            alone = F.sha2(F.concat_ws(":", F.lit(0), "digest"), 256).alias("digest")
            levels.append(levels[-1].select("archive", "node", alone))
    bad = written(_differing(mine[-1], other[-1]), "differing")
    for a, b in zip(mine[-2::-1], other[-2::-1], strict=True):
        up = F.floor(F.col("node") / FAN)
        bad = written(_differing(_within(a, up, bad), _within(b, up, bad)), "differing")
    begin = F.floor(F.coalesce("offset", F.lit(0)) / RANGE)
    turn = Window.partitionBy("archive", "offset").orderBy("leaf")
    a, b = (
        _within(x, begin, bad).select("archive", "offset", "length", "leaf").withColumn("turn", F.row_number().over(turn)).alias(n)
        for x, n in ((ours, "a"), (theirs, "b"))
    )
    same = F.col("a.archive").eqNullSafe(F.col("b.archive")) & F.col("a.offset").eqNullSafe(F.col("b.offset")) & (F.col("a.turn") == F.col("b.turn"))
    status = F.when(F.col("b.turn").isNull(), "missing").when(F.col("a.turn").isNull(), "extra").otherwise("changed")
    pick = lambda c: F.when(F.col("a.turn").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return (
        a.join(b, same, "full")
        .where(~F.col("a.leaf").eqNullSafe(F.col("b.leaf")))
        .select(pick("archive"), pick("offset"), pick("length"), status.alias("status"))
    )


def damaged(records_: DataFrame) -> DataFrame:
    """A replica with known faults, by page_id: of every 97th page the record's middle byte is another one; of every
    211th the record is gone."""
    flipped = F.expr("overlay(record PLACING (CASE WHEN substring(record, int(length / 2) + 1, 1) = X'23' THEN X'24' ELSE X'23' END) FROM int(length / 2) + 1)")
    kept = records_.where("page_id IS NULL OR page_id % 211 <> 5")
    return kept.withColumn("record", F.when(F.col("page_id") % 97 == 3, flipped).otherwise(F.col("record")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lays all pages out as archives and audits a replica with known faults against them."""
    laid = records(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    # both replicas' leaves from one layout: the records themselves aren't written again
    pair = laid.select("archive", "offset", "length", "page_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("replica"), "record")
    hashed = written(leaves(pair.where("replica = 0").unionByName(damaged(pair.where("replica = 1")))), "leaves")
    ours, theirs = hashed.where("replica = 0"), hashed.where("replica = 1")
    found = audit(ours, theirs)
    named = ours.select(F.col("archive").alias("n_archive"), F.col("offset").alias("n_offset"), "page_id")
    same = found["archive"].eqNullSafe(named["n_archive"]) & (found["offset"] == named["n_offset"])
    return found.join(named, same, "left").select("archive", "offset", "length", "page_id", "status")


ORACLE_SQL = f"""
WITH r AS (
  SELECT page_id // {PAGES} AS archive, page_id, url, html,
    (strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
      || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)) + 64
      + strlen(coalesce(html, '')) + 4)::BIGINT AS length FROM pages),
o AS (SELECT archive, page_id, length, (sum(length) OVER (PARTITION BY archive ORDER BY page_id, url) - length)::BIGINT AS "offset" FROM r)
SELECT archive, "offset", length, page_id, CASE WHEN page_id % 211 = 5 THEN 'missing' ELSE 'changed' END AS status
FROM o WHERE page_id % 211 = 5 OR page_id % 97 = 3"""

QUERIES = {"op10_warc": op10_warc}
ORACLE = {"op10_warc": ORACLE_SQL}
