"""Queries of reports over several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from .common import table


def _by_nation(spark, d):
    c = table(spark, d, "customer", "c_nationkey", "c_acctbal").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    s = table(spark, d, "supplier", "s_nationkey", "s_acctbal").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    return c, s


def outer_merge(spark, d):
    c, s = _by_nation(spark, d)
    return reports.outer_merge({"customer": c.where("nation % 3 <> 0"), "supplier": s.where("nation % 2 = 0")}, ["nation"])


def chained_merge(spark, d):
    c, s = _by_nation(spark, d)
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return reports.chained_merge({"c": c, "s": s, "n": n}, ["nation"])


def left_merge(spark, d):
    c, s = _by_nation(spark, d)
    return reports.left_merge(c.select("nation", "n"), s.where("nation % 2 = 1").select("nation", "balance"), ["nation"])


def status_changes(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    flag = table(spark, d, "lineitem", "l_orderkey", "l_returnflag").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_returnflag").alias("o_orderstatus"))
    return reports.status_changes(o.where("o_orderkey % 5 <> 0"), flag, "o_orderkey", "o_orderstatus")


def _gains(spark, d):
    return table(spark, d, "part", "p_brand", "p_retailprice").groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 2).alias("gain"))


def ranked_gains(spark, d):
    r = reports.ranked_gains(_gains(spark, d), "p_brand", "gain")
    return r.select("p_brand", "rank", F.round("gain_ratio", 6).alias("gain_ratio"), F.round("cumulative_ratio", 6).alias("cumulative_ratio"))


def top_gains(spark, d):
    return reports.top_by(_gains(spark, d), "gain", "p_brand", 10)


def against_baseline(spark, d):
    by = table(spark, d, "orders", "o_orderpriority", "o_totalprice").groupBy("o_orderpriority").agg(F.count("*").cast("double").alias("orders"), F.round(F.avg("o_totalprice"), 2).alias("price"))
    r = reports.against_baseline(by, "o_orderpriority", "5-LOW", ["orders", "price"])
    return r.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in r.columns[1:]])


def limited_union(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    return reports.limited_union(rows, "l_returnflag", {"A": 50, "N": 30, "R": 20}, ["l_orderkey", "l_linenumber"])


def type_mapping(spark, d):
    return reports.mapping(table(spark, d, "part", "p_type", "p_size"), "p_type", "p_size")


def _custkeys(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select("o_custkey"), o.where("o_orderstatus = 'O'").select("o_custkey")


def only_in_first(spark, d):
    return reports.only_in(*_custkeys(spark, d))


def in_both(spark, d):
    return reports.in_both(*_custkeys(spark, d))


def date_parts(spark, d):
    at = reports.date_parts(table(spark, d, "events", "ts").withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())), "ts")
    return at.groupBy("hour", "day_of_week").agg(F.count("*").alias("n"))


def latencies(spark, d):
    r = reports.latencies(table(spark, d, "events", "event_type", "value"), "event_type", "value")
    return r.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("median", "p95", "throughput")])


def overlapping_fields(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("group"), F.round("c_acctbal").cast("long").alias("size"))
    s = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("group"), F.round("s_acctbal").cast("long").alias("size"))
    return reports.overlapping(c, s, ["nation", "group", "size"])


def validated_rows(spark, d):
    rows = table(spark, d, "part", "p_partkey", "p_size", "p_retailprice").select(
        F.col("p_partkey").alias("_id"), F.when(F.col("p_size") % 7 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("size"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit(1e39)).otherwise(F.col("p_retailprice")).alias("price"),
    )
    return reports.validated(rows, ["size", "price"]).select(F.col("_id").alias("id"), "size", F.array_join("invalid", ",").alias("invalid"))


def ordered_flows(spark, d):
    return table(spark, d, "events", "event_id", "ts", "user_id").where("user_id < 5").orderBy("ts", "event_id").select("event_id", "user_id")


def temporary_view(spark, d):
    table(spark, d, "lineitem", "l_returnflag", "l_quantity").where("l_quantity > 10").createOrReplaceTempView("netquarry_larger")
    return spark.sql("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM netquarry_larger GROUP BY l_returnflag")


QUERIES = {f.__name__: f for f in (
    outer_merge, chained_merge, left_merge, status_changes, ranked_gains, top_gains, against_baseline, limited_union, type_mapping, only_in_first, in_both,
    date_parts, latencies, overlapping_fields, validated_rows, ordered_flows, temporary_view,
)}

_C = "(SELECT c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1)"
_S = "(SELECT s_nationkey AS nation, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1)"
_G = "(SELECT p_brand, round(sum(p_retailprice), 2) AS gain FROM part GROUP BY 1)"
_B = "(SELECT o_orderpriority, count(*)::DOUBLE AS orders, round(avg(o_totalprice), 2) AS price FROM orders GROUP BY 1)"
_L = "(SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = '{}' ORDER BY 1, 2 LIMIT {})"
_E = "SELECT '{0}' AS field, count(*) AS n FROM (SELECT DISTINCT {1} AS v FROM customer INTERSECT SELECT DISTINCT {2} FROM supplier WHERE s_suppkey % 2 = 0)"

ORACLE = {
    "outer_merge": f"""SELECT nation, coalesce(c.n, 0) AS n_customer, coalesce(c.balance, 0) AS balance_customer, coalesce(s.n, 0) AS n_supplier,
      coalesce(s.balance, 0) AS balance_supplier FROM (SELECT * FROM {_C} WHERE nation % 3 <> 0) c FULL JOIN (SELECT * FROM {_S} WHERE nation % 2 = 0) s USING (nation)""",
    "chained_merge": f"""SELECT nation, c.n AS n_c, c.balance AS balance_c, s.n AS n_s, s.balance AS balance_s, r.n_regionkey AS region_n
      FROM {_C} c JOIN {_S} s USING (nation) JOIN nation r ON r.n_nationkey = nation""",
    "left_merge": f"SELECT nation, c.n, s.balance FROM {_C} c LEFT JOIN (SELECT * FROM {_S} WHERE nation % 2 = 1) s USING (nation)",
    "status_changes": """SELECT o_orderstatus AS old_status, f AS new_status, count(*) AS n FROM (SELECT l_orderkey, max(l_returnflag) AS f FROM lineitem GROUP BY 1)
      LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    "ranked_gains": f"""SELECT p_brand, (row_number() OVER (ORDER BY gain DESC, p_brand))::INT AS rank, round(gain / sum(gain) OVER (), 6) AS gain_ratio,
      round(sum(gain) OVER (ORDER BY gain DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(gain) OVER (), 6) AS cumulative_ratio FROM {_G}""",
    "top_gains": f"SELECT * FROM {_G} ORDER BY gain DESC, p_brand LIMIT 10",
    "against_baseline": f"""SELECT b.o_orderpriority, b.orders, b.price, b.orders - z.orders AS orders_delta, round(b.price - z.price, 4) AS price_delta,
      round(100 * (1 - b.orders / z.orders), 4) AS orders_reduction, round(100 * (1 - b.price / z.price), 4) AS price_reduction
      FROM {_B} b, {_B} z WHERE z.o_orderpriority = '5-LOW'""",
    "limited_union": " UNION ALL ".join(f"SELECT * FROM {_L.format(k, n)}" for k, n in (("A", 50), ("N", 30), ("R", 20))),
    "type_mapping": "SELECT p_type, min(p_size) AS p_size FROM part GROUP BY 1",
    "only_in_first": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "in_both": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "date_parts": "SELECT hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS day_of_week, count(*) AS n FROM events GROUP BY 1, 2",
    "latencies": """SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95,
      round(count(value) / sum(value), 6) AS throughput FROM events GROUP BY 1""",
    "overlapping_fields": " UNION ALL ".join(_E.format(*x) for x in (
        ("nation", "c_nationkey", "s_nationkey"), ("group", "c_mktsegment", "s_name"), ("size", "round(c_acctbal)::BIGINT", "round(s_acctbal)::BIGINT"))),
    "validated_rows": """SELECT p_partkey AS id, CASE WHEN p_size % 7 <> 0 THEN p_size::DOUBLE END AS size,
      concat_ws(',', CASE WHEN p_size % 7 = 0 THEN 'size' END, CASE WHEN p_partkey % 5 = 0 THEN 'price' END) AS invalid FROM part""",
    "ordered_flows": "SELECT event_id, user_id FROM events WHERE user_id < 5",
    "temporary_view": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity > 10 GROUP BY 1",
}
