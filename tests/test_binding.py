import io
import json

from netquarry import cli
from netquarry.operators import binding


def test_connections_bind_by_precedence(spark):
    flow = "k string, flow_id string, first_ns long, last_ns long, counts array<long>"
    conn = "k string, uid string, start_ns long, end_ns long, counts array<long>, missed_bytes long, label string"
    ok = [1, 40, 1, 40]
    flows = [(k, k, 10, 20, ok) for k in "abcdefghijk"] + [("z", "z1", 10, 12, ok), ("z", "z2", 15, 20, ok)]
    conns = [
        ("a", "A", 10, 20, ok, 0, "Benign"), ("b", "B", 10, 20, ok, 0, "Benign"), ("b", "B2", 5, 25, ok, 0, "Benign"), ("c", "C", 10, 20, ok, 0, "Odd"),
        ("d", "D", 10, 20, ok, 5, "Benign"), ("e", "E", 10, 20, None, 0, "Benign"), ("f", "F", 9, 20, ok, 0, "Benign"), ("g", "G", 10, None, ok, 0, "Benign"),
        ("h", "H", 10, 15, ok, 0, "Benign"), ("i", "I", 10, 15, ok, 0, "Benign"), ("i", "I2", 10, 12, ok, 0, "Benign"), ("k", "K", 10, 20, [1, 40, 1, 41], 0, "Malicious"),
        ("z", "Z", 10, 20, ok, 0, "Benign"),
    ]
    got = binding.bound_connections(spark.createDataFrame(flows, flow), spark.createDataFrame(conns, conn), ["k"])
    assert {r["flow_id"]: (r["status"], r["reason"]) for r in got.collect()} == {
        "a": ("VERIFIED_MATCH", "SAME"), "b": ("AMBIGUOUS", "SEVERAL_CONNECTIONS"), "c": ("EXCLUDED", "LABEL"), "d": ("EXCLUDED", "MISSED_BYTES"), "e": ("EXCLUDED", "NO_COUNTS"),
        "f": ("CANDIDATE_MATCH", "NOT_THE_SAME"), "g": ("EXCLUDED", "NO_END"), "h": ("CANDIDATE_MATCH", "ANCHOR_ONLY"), "i": ("AMBIGUOUS", "SEVERAL_ANCHORS"),
        "j": ("UNMATCHED", "NO_CONNECTION"), "k": ("CANDIDATE_MATCH", "NOT_THE_SAME"), "z1": ("VERIFIED_MATCH", "SAME"), "z2": ("CANDIDATE_MATCH", "NOT_THE_SAME"),
    }


def test_packets_of_connections(spark):
    packets = spark.createDataFrame([("k", f"e{t}", t) for t in (1, 2, 4, 8, 16, 33)], "k string, event_id string, timestamp_ns long")
    conns = spark.createDataFrame([("k", "A", 1, 4), ("k", "B", 8, 8), ("k", "C", 8, 20)], "k string, uid string, start_ns long, end_ns long")
    got = {r["timestamp_ns"]: (r["uid"], r["matches"]) for r in binding.partitioned(packets, conns, ["k"]).collect()}
    assert got == {1: ("A", 1), 2: ("A", 1), 4: ("A", 1), 8: (None, 2), 16: ("C", 1), 33: (None, 0)}


def test_names_join_by_canonical_form(spark):
    names = spark.createDataFrame([("A.b.",), ("c",), (None,), ("..",)], "fqdn string")
    labels = spark.createDataFrame([("a.B", "r", 1), ("..", "x", 0)], "fqdn string, reference string, label int")
    assert [tuple(r) for r in binding.named_labels(names, labels).collect()] == [("A.b.", "r", 1)]


def test_command_line(spark):
    def run(raw, *arguments):
        out = io.StringIO()
        return cli.main(list(arguments), io.BytesIO(raw), out), json.loads(out.getvalue())

    code, got = run(b'["Aa.11.", "..", "x"]', "domains")
    assert code == 0 and got[0]["label_count"] == 2 and got[1]["canonical"] is None
    assert run(b'{"fqdns": [], "fqdns": []}', "domains")[0] == 1
    assert run(b"[" + b" " * cli.LIMIT + b"]", "domains")[0] == 1
    assert run(b"", "list")[1]
