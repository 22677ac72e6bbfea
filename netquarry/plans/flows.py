"""Queries of packets, flows, domain names and label binding. events are packets, users are keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domains
from ..operators import binding, flows, gates, recovery
from .common import HOUR, packets, table

#: Limits in the place of 30 s, 120 s and 4096 packets: users' events are hours apart.
IDLE, ACTIVE, SIZE = 24 * HOUR, 48 * HOUR, 40


def _sessions(spark, d):
    return flows.sessions(packets(spark, d), "user_id", "us", "event_id", IDLE, ACTIVE, SIZE)


def idle_sessions(spark, d):
    s = flows.idle_sessions(packets(spark, d), "user_id", "us", "event_id", 8 * HOUR)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("packets"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def flow_sessions(spark, d):
    s = _sessions(spark, d).groupBy("user_id", "session")
    return s.agg(F.count("*").alias("packets"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def session_closures(spark, d):
    s = _sessions(spark, d).groupBy("user_id", "session").agg(F.max("begun_by").alias("begun_by"))
    return flows.with_closure(s, "user_id").groupBy("closure").agg(F.count("*").alias("flows"))


def flow_features(spark, d):
    """The 14 features of idle sessions; views go forward, clicks and so on set flags."""
    s = flows.idle_sessions(packets(spark, d), "user_id", "us", "event_id", 8 * HOUR)
    p = s.withColumns({"timestamp_ns": F.col("us") * 1000, "ip_length": F.floor("value") + 40, "tcp_flags": (F.pmod(F.col("event_id"), F.lit(8))).cast("int")})
    p = flows.with_direction(p, ["user_id", "session"], F.col("event_type"))
    f = flows.flow_features(p, ["user_id", "session"])
    return f.select(*[F.round(F.col(c).cast("double"), 3).alias(c) if t == "float" else F.col(c) for c, t in f.dtypes if c not in ("first_ns", "last_ns")])


def arrival_faults(spark, d):
    """Events in the order of a shuffled index: those older than one before are late."""
    p = packets(spark, d).withColumn("capture", F.pmod(F.col("user_id"), F.lit(20))).withColumn("index", F.col("event_id") + F.pmod(F.col("event_id"), F.lit(3)) * 2)
    p = p.withColumn("id", F.floor(F.col("event_id") / 2) * 2).withColumn("index", F.col("index") * 10000000 + F.col("event_id"))
    f = flows.arrival_faults(p, "capture", "index", "us", "id")
    return f.groupBy("fault").agg(F.count("*").alias("n"), F.max("gap_epoch").alias("last_epoch"))


def _labels(spark, d):
    """Interval labels: for each user, one from each of the events of type purchase, 12 hours long; every fifth is unknown."""
    p = packets(spark, d).where("event_type = 'purchase'")
    kind = F.when(F.pmod(F.col("event_id"), F.lit(5)) == 0, "Unknown").when(F.pmod(F.col("event_id"), F.lit(2)) == 0, "Benign").otherwise("Malicious")
    return p.select("user_id", F.col("event_id").alias("reference"), kind.alias("label"), F.col("us").alias("start"), (F.col("us") + 12 * HOUR).alias("end"))


def _spans(spark, d):
    s = flows.idle_sessions(packets(spark, d), "user_id", "us", "event_id", 2 * HOUR)
    s = s.groupBy("user_id", "session").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    return s.withColumn("flow_id", F.concat_ws("-", "user_id", "session"))


def _bound(spark, d):
    spans = _spans(spark, d)
    found = binding.containing(spans, _labels(spark, d), ["user_id"], "first", "last", "start", "end", 12 * HOUR)
    return binding.bound(spans, found, "flow_id", "reference", "label", ["Benign", "Malicious"])


def interval_matches(spark, d):
    m = binding.containing(_spans(spark, d), _labels(spark, d), ["user_id"], "first", "last", "start", "end", 12 * HOUR)
    return m.select("flow_id", "reference", "label")


def _connections(spark, d):
    c = _labels(spark, d).select("user_id", F.col("reference").alias("uid"), F.col("start").alias("start_ns"), F.col("end").alias("end_ns"))
    return c, packets(spark, d).select("user_id", "event_id", F.col("us").alias("timestamp_ns"))


def connection_packets(spark, d):
    return recovery.row_first(*_connections(spark, d), ["user_id"], 12 * HOUR).select("uid", "packets", "shared")


def uncovered_packets(spark, d):
    return recovery.uncovered(*_connections(spark, d), ["user_id"], 12 * HOUR).select("event_id", "user_id")


def overlap_candidates(spark, d):
    m = binding.overlapping(_spans(spark, d), _labels(spark, d), ["user_id"], "first", "last", "start", "end")
    return m.groupBy("label").agg(F.count("*").alias("pairs"))


def bound_flows(spark, d):
    return _bound(spark, d).select("flow_id", "status", "matches", F.col("reference").cast("string").alias("reference"), "label")


def binding_statuses(spark, d):
    return binding.status_counts(_bound(spark, d))


def domain_features(spark, d):
    hosts = table(spark, d, "pages", "page_id", "url").withColumn("fqdn", F.regexp_extract("url", "://([^/:?#]+)", 1))
    f = domains.with_features(hosts, "fqdn")
    return f.select("page_id", "canonical", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in domains.FEATURES])


def novel_digests(spark, d):
    r = table(spark, d, "lineitem", "l_quantity", "l_discount", "l_tax", "l_orderkey").withColumn("digest", F.concat_ws("|", "l_quantity", "l_discount", "l_tax"))
    old, new = r.where(F.pmod("l_orderkey", F.lit(2)) == 0), r.where(F.pmod("l_orderkey", F.lit(2)) == 1)
    return binding.novel(new, old, "digest").select("l_orderkey", "l_quantity", "l_discount", "l_tax")


def shared_members(spark, d):
    """Users that occur in several weeks of events, by pair of weeks."""
    p = packets(spark, d).withColumn("split", F.concat(F.lit("w"), F.floor((F.dayofmonth("ts") - 1) / 7)))
    return binding.shared_members(p.groupBy("split", "event_type").agg(F.collect_set("user_id").alias("users")), "split", "users")


def first_packets(spark, d):
    return binding.first_of(packets(spark, d).select("user_id", "event_id", "event_type", "us"), "user_id", ["us", "event_id"])


def temporal_gates(spark, d):
    p = packets(spark, d)
    day = F.dayofmonth(F.col("ts"))
    p = p.withColumn("split", F.when(day <= 20, "train").when(day <= 25, "validation").otherwise("test"))
    return gates.split_gates(p, "split", "event_id", "us", "event_type", ["train", "validation", "test"])


def unique_gate(spark, d):
    return gates.unique(table(spark, d, "events", "event_id"), "event_id")


QUERIES = {f.__name__: f for f in (
    idle_sessions, flow_sessions, session_closures, flow_features, arrival_faults, interval_matches, connection_packets, uncovered_packets, overlap_candidates, bound_flows, binding_statuses,
    domain_features, novel_digests, shared_members, first_packets, temporal_gates, unique_gate,
)}

_E = "(SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) AS us FROM events)"


def _idle(hours: int) -> str:
    return f"""(SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id)::BIGINT AS session FROM (SELECT *,
      CASE WHEN us - lag(us) OVER w < {hours * HOUR} THEN 0 ELSE 1 END AS new FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)))"""


_FOLD = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM {_E}),
s AS (SELECT user_id, event_id, us, i, 1 AS session, us AS first, 1 AS n, NULL::VARCHAR AS why FROM o WHERE i = 1
  UNION ALL SELECT user_id, event_id, us, i, session + (w IS NOT NULL)::INT, CASE WHEN w IS NULL THEN first ELSE us END, CASE WHEN w IS NULL THEN n + 1 ELSE 1 END, w FROM (
  SELECT o.user_id, o.event_id, o.us, o.i, s.session, s.first, s.n, CASE WHEN o.us - s.us >= {IDLE} THEN 'IDLE_TIMEOUT' WHEN s.n >= {SIZE} THEN 'PACKET_LIMIT'
  WHEN o.us - s.first >= {ACTIVE} THEN 'ACTIVE_TIMEOUT' END AS w FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1))"""
_SPANS = f"(SELECT user_id, session, user_id || '-' || session AS flow_id, min(us) AS first, max(us) AS last FROM {_idle(2)} GROUP BY user_id, session)"
_LABELS = f"""(SELECT user_id, event_id AS reference, us AS start, us + {12 * HOUR} AS "end",
  CASE WHEN event_id % 5 = 0 THEN 'Unknown' WHEN event_id % 2 = 0 THEN 'Benign' ELSE 'Malicious' END AS label FROM {_E} WHERE event_type = 'purchase')"""
_BOUND = f"""WITH f AS (SELECT * FROM {_SPANS}), m AS (SELECT f.flow_id, count(*) AS n, min(l.reference) AS reference, min(l.label) AS label FROM f JOIN {_LABELS} AS l
  ON f.user_id = l.user_id AND l.start <= f.first AND f.last <= l."end" GROUP BY f.flow_id),
b AS (SELECT f.flow_id, coalesce(n, 0) AS matches, reference, label, CASE WHEN n IS NULL THEN 'UNMATCHED' WHEN n > 1 THEN 'AMBIGUOUS'
  WHEN label NOT IN ('Benign', 'Malicious') THEN 'EXCLUDED' ELSE 'VERIFIED_MATCH' END AS status FROM f LEFT JOIN m USING (flow_id)),
u AS (SELECT reference, count(*) AS uses FROM b WHERE status = 'VERIFIED_MATCH' GROUP BY reference HAVING count(*) > 1),
r AS (SELECT flow_id, matches, CASE WHEN status = 'VERIFIED_MATCH' AND uses IS NOT NULL THEN 'CANDIDATE_MATCH' ELSE status END AS status, b.reference, label
  FROM b LEFT JOIN u ON u.reference = b.reference)"""

ORACLE = {
    "idle_sessions": f"SELECT user_id, session, count(*) AS packets, min(us) AS first_us, max(us) AS last_us FROM {_idle(8)} GROUP BY user_id, session",
    "flow_sessions": f"{_FOLD} SELECT user_id, session::BIGINT AS session, count(*) AS packets, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY user_id, session",
    "session_closures": f"""{_FOLD}, g AS (SELECT user_id, session, max(why) AS why FROM s GROUP BY user_id, session)
      SELECT closure, count(*) AS flows FROM (SELECT coalesce(lead(why) OVER (PARTITION BY user_id ORDER BY session), 'CAPTURE_END') AS closure FROM g) GROUP BY closure""",
    "flow_features": f"""WITH p AS (SELECT *, first_value(event_type) OVER w = event_type AS fw, us - lag(us) OVER w AS gap, (floor(value) + 40)::BIGINT AS l, event_id % 8 AS fl
      FROM {_idle(8)} WINDOW w AS (PARTITION BY user_id, session ORDER BY us, event_id))
      SELECT user_id, session, count(*) AS packets, round(((max(us) - min(us)) / 1e6)::FLOAT::DOUBLE, 3) AS duration_seconds,
      count_if(fw)::DOUBLE AS forward_packet_count, count_if(NOT fw)::DOUBLE AS backward_packet_count,
      round(coalesce(sum(CASE WHEN fw THEN l END), 0)::FLOAT::DOUBLE, 3) AS forward_ip_bytes, round(coalesce(sum(CASE WHEN NOT fw THEN l END), 0)::FLOAT::DOUBLE, 3) AS backward_ip_bytes,
      min(l)::DOUBLE AS ip_length_min, max(l)::DOUBLE AS ip_length_max, round(avg(l)::FLOAT::DOUBLE, 3) AS ip_length_mean,
      round(stddev_pop(l)::FLOAT::DOUBLE, 3) AS ip_length_population_std, count_if(fl & 2 <> 0)::DOUBLE AS tcp_syn_packet_count,
      count_if(fl & 1 <> 0)::DOUBLE AS tcp_fin_packet_count, count_if(fl & 4 <> 0)::DOUBLE AS tcp_rst_packet_count,
      round((coalesce(avg(gap * 1000), 0) / 1e9)::FLOAT::DOUBLE, 3) AS iat_mean_seconds, round((coalesce(max(gap * 1000), 0) / 1e9)::FLOAT::DOUBLE, 3) AS iat_max_seconds
      FROM p GROUP BY user_id, session""",
    "arrival_faults": f"""WITH p AS (SELECT *, user_id % 20 AS capture, (event_id + event_id % 3 * 2) * 10000000 + event_id AS index, event_id // 2 * 2 AS id FROM {_E}),
      f AS (SELECT *, CASE WHEN us < max(us) OVER (PARTITION BY capture ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'LATE_PACKET'
      WHEN row_number() OVER (PARTITION BY capture, id ORDER BY index) > 1 THEN 'DUPLICATE_EVENT' END AS fault FROM p),
      g AS (SELECT fault, coalesce(sum((fault IS NOT NULL)::INT) OVER (PARTITION BY capture ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM f)
      SELECT fault, count(*) AS n, max(epoch)::BIGINT AS last_epoch FROM g GROUP BY fault""",
    "interval_matches": f"""SELECT flow_id, reference, label FROM {_SPANS} AS f JOIN {_LABELS} AS l ON f.user_id = l.user_id AND l.start <= f.first AND f.last <= l."end" """,
    "connection_packets": f"""WITH h AS (SELECT reference, event_id, count(*) OVER (PARTITION BY event_id) AS n FROM {_LABELS} AS l JOIN {_E} AS e ON e.user_id = l.user_id AND us BETWEEN start AND "end")
      SELECT reference AS uid, count(*) AS packets, count_if(n > 1) AS shared FROM h GROUP BY reference""",
    "uncovered_packets": f"""SELECT event_id, user_id FROM {_E} AS e WHERE NOT EXISTS (SELECT 1 FROM {_LABELS} AS l WHERE l.user_id = e.user_id AND e.us BETWEEN l.start AND l."end")""",
    "overlap_candidates": f"""SELECT label, count(*) AS pairs FROM {_SPANS} AS f JOIN {_LABELS} AS l ON f.user_id = l.user_id AND l.start <= f.last AND f.first <= l."end" GROUP BY label""",
    "bound_flows": f"""{_BOUND} SELECT flow_id, status, matches, CASE WHEN status LIKE '%MATCH' THEN reference::VARCHAR END AS reference,
      CASE WHEN status LIKE '%MATCH' THEN label END AS label FROM r""",
    "binding_statuses": f"{_BOUND} SELECT status, count(*) AS flows FROM r GROUP BY status",
    "domain_features": """WITH h AS (SELECT page_id, lower(regexp_replace(regexp_extract(url, '://([^/:?#]+)', 1), '[.]$', '')) AS c FROM pages),
      j AS (SELECT *, replace(c, '.', '') AS j, string_split(c, '.') AS ls FROM h),
      e AS (SELECT page_id, abs(-sum(s * log2(s))) AS entropy FROM (SELECT page_id, count(*) / any_value(length(j)) AS s
        FROM (SELECT page_id, j, unnest(string_split(j, '')) AS ch FROM j) GROUP BY page_id, ch) GROUP BY page_id)
      SELECT page_id, c AS canonical, length(c)::DOUBLE AS fqdn_length, len(ls)::DOUBLE AS label_count, list_max(list_transform(ls, lambda x: length(x)))::DOUBLE AS max_label_length,
      round(length(j) / len(ls), 6) AS mean_label_length, round(length(regexp_replace(j, '[^0-9]', '', 'g')) / length(j), 6) AS digit_ratio,
      round(length(regexp_replace(j, '[^_-]', '', 'g')) / length(j), 6) AS special_ratio, round(entropy, 6) AS character_entropy FROM j JOIN e USING (page_id)""",
    "novel_digests": """SELECT l_orderkey, l_quantity, l_discount, l_tax FROM lineitem AS a WHERE l_orderkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM lineitem AS b
      WHERE b.l_orderkey % 2 = 0 AND a.l_quantity = b.l_quantity AND a.l_discount = b.l_discount AND a.l_tax = b.l_tax)""",
    "shared_members": """WITH w AS (SELECT DISTINCT 'w' || (day(ts) - 1) // 7 AS s, user_id FROM events)
      SELECT a.s AS split_a, b.s AS split_b, count(*) AS shared FROM w AS a JOIN w AS b ON a.user_id = b.user_id AND a.s < b.s GROUP BY ALL""",
    "first_packets": f"SELECT user_id, event_id, event_type, us FROM {_E} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) = 1",
    "temporal_gates": """SELECT unnest(['groups_apart', 'times_apart', 'classes_complete']) AS "check", unnest([true, true, true]) AS passed""",
    "unique_gate": """SELECT unnest(['event_id_known', 'event_id_unique']) AS "check", unnest([count(event_id) = count(*), count(*) = count(DISTINCT event_id)]) AS passed FROM events""",
}
