from functools import reduce

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netquarry.functions import domains, numeric, packets
from netquarry.operators import evaluation, flows, gates, patterns, profile, ranks, statistics

from .conftest import rows


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


def test_domain_features(spark):
    df = spark.createDataFrame([("Aa.11.",), ("A-._1.",), ("",), ("a..b",), ("x" * 64,), ("ü.de",), (None,), ("1",), ("a" * 63 + "." + "b",)], "fqdn string")
    got = {r["fqdn"]: [r[c] for c in domains.FEATURES] for r in domains.with_features(df, "fqdn").collect()}
    assert got["Aa.11."] == pytest.approx([5, 2, 2, 2, 0.5, 0, 1])
    assert got["A-._1."] == pytest.approx([5, 2, 2, 2, 0.25, 0.5, 2])
    for bad in ("", "a..b", "x" * 64, "ü.de", None):
        assert got[bad] == [None] * 7
    assert got["1"] == pytest.approx([1, 1, 1, 1, 1, 0, 0])
    assert got["a" * 63 + ".b"][2] == 63


def test_flow_features_of_three_packets(spark):
    data = [("f", 0, "a", 40, 2, "x"), ("f", 10**9, "b", 80, 18, "y"), ("f", 3 * 10**9, "c", 40, 1, "x")]
    df = spark.createDataFrame(data, "flow string, timestamp_ns long, event_id string, ip_length int, tcp_flags int, source string")
    r = flows.flow_features(flows.with_direction(df, ["flow"], F.col("source")), ["flow"]).first()
    values = list(r)[4:]
    assert values == pytest.approx([3, 2, 1, 80, 80, 40, 80, 53.3333, 18.8562, 2, 1, 0, 1.5, 2], rel=1e-5)


@pytest.mark.parametrize(("gap", "sessions"), [(29_999_999_999, 1), (30_000_000_000, 2), (30_000_000_001, 2)])
def test_idle_boundary(spark, gap, sessions):
    df = spark.createDataFrame([("k", 0, 1), ("k", gap, 2)], "k string, t long, o long")
    s = flows.sessions(df, "k", "t", "o", 30 * flows.SECOND, 120 * flows.SECOND, 4096)
    assert s.agg(F.max("session")).first()[0] == sessions


def test_active_and_size_limits(spark):
    df = spark.createDataFrame([("k", i * 24 * flows.SECOND, i) for i in range(6)], "k string, t long, o long")
    s = flows.sessions(df, "k", "t", "o", 30 * flows.SECOND, 120 * flows.SECOND, 4096).orderBy("o").collect()
    assert [r["session"] for r in s] == [1] * 5 + [2] and s[5]["begun_by"] == "ACTIVE_TIMEOUT"
    s = flows.sessions(df, "k", "t", "o", 30 * flows.SECOND, 10**15, 2).orderBy("o").collect()
    assert [r["session"] for r in s] == [1, 1, 2, 2, 3, 3] and s[2]["begun_by"] == "PACKET_LIMIT"
    empty = flows.sessions(df.limit(0), "k", "t", "o", 1, 1, 1)
    assert empty.count() == 0


def test_arrival_faults(spark):
    df = spark.createDataFrame([("c", 1, 10, "a"), ("c", 2, 9, "b"), ("c", 3, 10, "c"), ("c", 4, 11, "a")], "c string, i long, t long, e string")
    got = [(r["fault"], r["gap_epoch"]) for r in flows.arrival_faults(df, "c", "i", "t", "e").orderBy("i").collect()]
    assert got == [(None, 0), ("LATE_PACKET", 0), (None, 1), ("DUPLICATE_EVENT", 1)]


def test_packet_faults(spark):
    good = ("e", "0" * 64, "s", 1, "10.0.0.1", 1, "10.0.0.2", 2, "tcp", 40, 2)
    names = "event_id interface_id capture_session_id timestamp_ns source_address source_port destination_address destination_port transport ip_length tcp_flags".split()
    changes = {
        None: {}, "EVENT_ID": {"event_id": ""}, "INTERFACE": {"interface_id": "0" * 63}, "TIMESTAMP": {"timestamp_ns": -1}, "TRANSPORT": {"transport": "icmp"},
        "PORT": {"source_port": 65536}, "FLAGS": {"transport": "udp", "ip_length": 28}, "ADDRESS": {"source_address": "10.0.0.01"}, "LENGTH": {"ip_length": 39},
        "SELF_PAIR": {"destination_address": "10.0.0.1", "destination_port": 1},
    }
    for want, change in changes.items():
        values = dict(zip(names, good, strict=True)) | change
        assert one(spark, packets.fault(), **values) == want, want
    v6 = dict(zip(names, good, strict=True)) | {"source_address": "fe80::1", "destination_address": "::", "ip_length": 60}
    assert one(spark, packets.fault(), **v6) is None
    for bad in ("fe80:0:0:0:0:0:0:1", "FE80::1", "1::2::3", "01::", "1:2:3:4:5:6:7:8:9", "::1.2.3.4"):
        assert one(spark, packets.fault(), **(v6 | {"source_address": bad})) == "ADDRESS", bad
    key = packets.flow_key()
    back = dict(zip(names, good, strict=True)) | {"source_address": "10.0.0.2", "source_port": 2, "destination_address": "10.0.0.1", "destination_port": 1}
    assert one(spark, key, **dict(zip(names, good, strict=True))) == one(spark, key, **back)


def test_numbers(spark):
    assert one(spark, numeric.ratio_or_null(F.lit(1), F.lit(0))) is None
    assert one(spark, numeric.ratio_or_zero(F.lit(1), F.lit(0))) == 0
    assert [one(spark, numeric.finite(F.lit(x))) for x in (1.5, float("nan"), float("inf"), float("-inf"))] == [1.5, None, None, None]
    assert [one(spark, numeric.quantised(F.lit(x), 1.0)) for x in (0.5, 1.5, 2.5, 1e9, -1e9)] == [0, 2, 2, 127, -128]
    assert one(spark, numeric.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == [0.5, 0.5]
    assert one(spark, numeric.argmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)))) == 1
    assert [one(spark, numeric.literal_length(F.lit(x).cast("string"))) for x in ("[1, 2]", "set()", "[]", None)] == [2, 0, 0, 0]
    assert one(spark, numeric.standardised(F.lit(None).cast("double"), 3.0, 0.0)) == 0
    assert [one(spark, numeric.level(F.lit(x), 0.5, 0.3, 0.1)) for x in (-0.5, 0.3, 0.1, 0.0)] == ["large", "medium", "small", "negligible"]


def test_rank_tests(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 2, 3)] + [("b", float(x)) for x in (2, 4, 5)] + [("c", 9.0), ("a", None)], "g string, x double")
    m = statistics.mann_whitney(df, ["x"], "g", "a", "b").first()
    assert (m["n1"], m["n2"], m["u1"]) == (4, 3, 1.0 + 0.0) or m["u1"] == sum((x > y) + (x == y) / 2 for x in (1, 2, 2, 3) for y in (2, 4, 5))
    assert 0 < m["p"] <= 1 and m["effect"] == pytest.approx(2 * m["u1"] / 12 - 1)
    same = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, x double")
    assert statistics.mann_whitney(same, ["x"], "g", "a", "b").first()["p"] == 1
    k = statistics.kruskal_wallis(same, ["x"], "g").first()
    assert (k["h"], k["p"]) == (0, 1)
    assert statistics.chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert statistics.chi_square_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert statistics.chi_square_tail(23.684791, 14) == pytest.approx(0.05, abs=1e-6)
    assert statistics.chi_square_tail(24.995790, 15) == pytest.approx(0.05, abs=1e-6)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", 0.5)], "name string, p double")
    q = {r["name"]: r["q"] for r in statistics.false_discovery(p).collect()}
    assert q == pytest.approx({"a": 0.04, "b": 0.16 / 3, "c": 0.16 / 3, "d": None, "e": 0.5})


def test_metrics_without_classes(spark):
    none = spark.createDataFrame([], "y int, p double")
    assert evaluation.binary(none, "y", "p", 0.5).first()["precision"] is None
    assert tuple(evaluation.ranking(none, "y", "p").first()) == (None, None)
    single = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, p double")
    assert tuple(evaluation.ranking(single, "y", "p").first()) == (None, None)
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (1, None), (2, 0.5)], "y int, p double")
    r = evaluation.ranking(ties, "y", "p").first()
    assert r["roc_auc"] == 0.875 and r["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3, abs=1e-6)


def test_evidence(spark):
    e = evaluation.evidence(F.array(F.lit(0.25), F.lit(0.75)), ["Benign", "Bot"], "Benign")
    r = one(spark, e)
    assert (r["predicted_class"], r["class_id"], r["confidence"], r["threat_score"]) == ("Bot", 1, 0.75, 0.75)
    assert one(spark, evaluation.evidence(F.array(F.lit(0.25), F.lit(0.7)), ["Benign", "Bot"], "Benign")) is None


def test_patterns_with_nulls(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 1, "b"), (None, 1, "b"), (2.0, 1, "a"), (2.0, 1, None)], "x double, y int, label string")
    f = patterns.frequencies(df, ["x", "y"], "label")
    assert rows(patterns.conflict_details(f, ["x", "y"], "label")) == [(None, 1, "a", "b", 1, 2, "b")]
    assert all(r["passed"] for r in gates.conserved(f, df, "label").collect())
    empty = patterns.conflict_summary(patterns.conflict_details(f.limit(0), ["x", "y"], "label"))
    assert empty.count() == 0
    w = patterns.weighted(f, "label", {"b": 1.5}, "a", 1).where("label = 'a'").collect()
    assert len(w) == 1 and w[0]["sample_weight"] == 2.0


def test_split_keeps_patterns_together(spark):
    df = spark.range(20000).select((F.col("id") % 997).alias("a"), (F.col("id") % 7).alias("b"))
    leaks = patterns.leakage(patterns.split_by_pattern(df, ["a", "b"]), ["a", "b"]).first()
    assert leaks["train_validation"] == leaks["train_test"] == leaks["validation_test"] == 0
    shares = patterns.split_by_pattern(df, ["a", "b"]).groupBy("split").count().collect()
    assert {r["split"]: round(r["count"] / 20000, 1) for r in shares} == {"train": 0.7, "validation": pytest.approx(0.15, abs=0.06), "test": pytest.approx(0.15, abs=0.06)}


def test_sampling(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "r").otherwise("c").alias("label"))
    assert dict(rows(patterns.sampled(df, "label", {"c": 50}, ["id"]).groupBy("label").count())) == {"c": 50, "r": 100}
    assert patterns.fractional_sample(df, 0.5, 100).count() == 100
    first = rows(patterns.sampled(df, "label", {"c": 50, "r": 5}, ["id"]))
    assert first == rows(patterns.sampled(df.repartition(7), "label", {"c": 50, "r": 5}, ["id"]))


def test_profiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double, g string")
    assert profile.moments(df, ["a"]).first()["mean"] is None
    assert profile.correlations(df, ["a", "b"]).first()["r"] is None
    assert profile.group_summary(df, ["g"], ["a"]).count() == 0


def test_gates(spark):
    checks = reduce(lambda a, b: a.unionAll(b), [spark.createDataFrame([(n, p)], "check string, passed boolean") for n, p in (("a", True), ("b", True))])
    assert gates.admitted(checks, ["a", "b"]).first()[0]
    assert not gates.admitted(checks, ["a", "b", "c"]).first()[0]
    assert not gates.admitted(checks.unionAll(spark.createDataFrame([("c", False)], checks.schema)), ["a", "b"]).first()[0]
    samples = spark.createDataFrame([("a", "1", "x", 0), ("b", "2", "x", 1), ("c", "2", "y", 1)], "i string, r string, s string, l int")
    assert dict(rows(gates.declared(samples, "i", "r", "s", "l"))) == {"identities_unique": True, "raw_unique": False, "both_classes": False}


def test_sessions_keep_packets_without_key_and_repeated_ones(spark):
    from netquarry.operators import flows

    rows = [(None, 0, 1), (None, 5, 2), ("k", 0, 3), ("k", 0, 3), ("k", 1, 4), ("k", 50, 5), ("k", 51, 6), ("k", 52, 7), ("k", 53, 8)]
    got = flows.sessions(spark.createDataFrame(rows, "k string, t long, o long"), "k", "t", "o", 10, 100, 3)
    want = [(None, 0, 1, 1, None), (None, 5, 2, 1, None), ("k", 0, 3, 1, None), ("k", 0, 3, 1, None), ("k", 1, 4, 1, None)]
    want += [("k", 50, 5, 2, "IDLE_TIMEOUT"), ("k", 51, 6, 2, "IDLE_TIMEOUT"), ("k", 52, 7, 2, "IDLE_TIMEOUT"), ("k", 53, 8, 3, "PACKET_LIMIT")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_overlap_and_validation_fail_hard(spark):
    from netquarry.operators import reports

    a, b = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string"), spark.createDataFrame([(2, "y"), (3, None)], "i int, s string")
    with pytest.raises(ValueError, match="'i': 1"):
        reports.required_apart(a, b, ["i", "s"])
    reports.required_apart(a, b, ["s"])
    with pytest.raises(ValueError, match=r"missing \['z'\], unexpected \['s'\]"):
        reports.validated(a, ["i", "z"])


def most_read(spark, run):
    """Most records that one task of run() reads from a shuffle."""
    sc = spark.sparkContext
    group = f"read {run!r}"
    sc.setJobGroup(group, "")
    run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    most = 0
    for stage in {i for j in jobs for i in j.stageIds}:
        tasks = sc._jsc.sc().statusStore().taskList(stage, 0, 1000)
        most = max([most, *[tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size())]])
    return most


def test_samples_and_splits_are_those_of_one_sort_of_each_class(spark):
    df = spark.range(50_000).select("id", F.when(F.col("id") % 10 == 0, "r").when(F.col("id") % 3 > 0, "c").alias("label"))
    whole = Window.partitionBy("label")
    placed = df.withColumn("p", F.row_number().over(whole.orderBy(F.xxhash64(F.lit(42), "id"), "id"))).withColumn("n", F.count("*").over(whole))
    kept = patterns.sampled(df, "label", {"c": 5000, "r": 0}, ["id"])
    assert rows(kept) == rows(placed.where("label IS NULL OR label = 'c' AND p <= 5000").select("id", "label"))
    assert rows(patterns.sampled(df, "label", {"r": 10**6}, ["id"])) == rows(df)
    for share in (0.0, 0.3, 1.0):
        got = patterns.train_test(df, "label", ["id"], share)
        assert rows(got) == rows(placed.select("id", "label", F.col("p") <= F.ceil(F.col("n") * F.lit(share))))
    assert patterns.train_test(df.limit(0), "label", ["id"]).count() == 0
    same = df.withColumn("o", F.lit(1))  # equal rows: how many is given, not which
    assert rows(patterns.sampled(same, "label", {"c": 7, "r": 9}, ["o"]).where("label IS NOT NULL").groupBy("label").count()) == [("c", 7), ("r", 9)]


@pytest.mark.parametrize("of", [lambda df: patterns.sampled(df, "label", {"c": 3000}, ["id"]), lambda df: patterns.train_test(df, "label", ["id"])])
def test_no_class_is_sorted_by_one_task(spark, of):
    df = spark.range(2_000_000).select("id", F.lit("c").alias("label"))
    assert most_read(spark, lambda: of(df).write.format("noop").mode("overwrite").save()) < 300_000


def test_exact_quantiles_are_those_of_one_sort(spark):
    near = [1e9 + i / 2**22 for i in range(3000)]  # one range of the first turn
    wild = [s * 10.0**e for s in (1, -1, 1.7) for e in range(-320, 308, 3)]
    odd = [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, float("nan"), float("inf"), float("-inf"), None]
    data = [("a", x, y) for x, y in zip(near, (wild + odd) * 10)] + [(None, 2.0, 1.0), (None, 3.0, None), ("b", None, None), ("c", 5.0, -5.0)]
    df = spark.createDataFrame(data, "g string, x double, y double").repartition(3)
    at = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    wanted = [F.percentile(numeric.finite(F.col(c)), F.array(*map(F.lit, at))) for c in "xy"]
    told = lambda out: {tuple(r[:-1]): r["q"] for r in out.collect() if r["q"] is not None}
    one = df.agg(*wanted).first()
    assert told(ranks.quantiles(df, ["x", "y"], at)) == {("x",): one[0], ("y",): one[1]}
    for few in (None, False):
        by = {(r["g"], c): r[1 + i] for r in df.groupBy("g").agg(*wanted).collect() for i, c in enumerate("xy") if r[1 + i] is not None}
        assert told(ranks.quantiles(df, ["x", "y"], at, ["g"], few)) == by
    assert rows(ranks.quantiles(df.limit(0), ["x", "y"], at)) == [("x", None), ("y", None)]
    summary = {(r["g"], r["name"]): r["median"] for r in profile.group_summary(df, ["g"], ["x", "y"]).collect()}
    assert summary[None, "x"] == 2.5 and summary["b", "x"] is None and summary["c", "y"] == -5.0 and len(summary) == 8


PROFILES = {
    "median_differences": lambda df: profile.median_differences(df, F.col("id") % 2 == 0, ["x"]),
    "quantiles": lambda df: profile.quantiles(df, ["x"]),
    "medians": lambda df: profile.medians(df, ["x"]),
    "iqr_outliers": lambda df: profile.iqr_outliers(df, ["x"]),
    "trimmed": lambda df: profile.trimmed(df, "x"),
    "group_summary": lambda df: profile.group_summary(df, ["g"], ["x"]),
}


def shuffled(spark, run):
    """Bytes that run() reads from shuffles in all."""
    sc = spark.sparkContext
    sc.setJobGroup(group := f"bytes {run!r}", "")
    run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    tasks = [sc._jsc.sc().statusStore().taskList(stage, 0, 1000) for stage in {i for j in jobs for i in j.stageIds}]
    read = [t.apply(i).taskMetrics().get().shuffleReadMetrics() for t in tasks for i in range(t.size())]
    return sum(r.localBytesRead() + r.remoteBytesRead() for r in read)


@pytest.mark.parametrize("name", PROFILES)
def test_no_task_reads_all_values_for_a_quantile(spark, name):
    df = spark.range(300_000).select("id", F.lit("g").alias("g"), (F.col("id") * 7919 % 1_000_003 / 7).alias("x"))
    assert shuffled(spark, lambda: PROFILES[name](df).write.format("noop").mode("overwrite").save()) < 2_000_000


def test_no_task_trains_on_more_rows_than_a_part(spark, monkeypatch):
    from netquarry.operators import models

    df = spark.range(5000).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 4).cast("int").alias("y")).coalesce(1)
    seen, fit = [], models.GBTClassifier.fit
    monkeypatch.setattr(models, "PART_ROWS", 1000, raising=False)
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda self, rows: seen.append(rows.groupBy(F.spark_partition_id()).count().collect()) or fit(self, rows))
    model = models.trained(df, "boosted", ["x"], "y", 2, maxIter=1, maxDepth=2)
    assert sum(r["count"] for r in seen[0]) == 5000 and max(r["count"] for r in seen[0]) <= 1001
    assert models.predicted(df, model, ["x"]).where("predicted = y").count() == 5000
    assert models.spread(df.limit(0)).count() == 0 and models.spread(df, 5000).rdd.getNumPartitions() == 1
