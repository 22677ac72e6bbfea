from netquarry.operators import recovery

FLOW = "flow_id string, key string, transport string, status string, reason string, reference string, label string, incomplete boolean, closure string"
PACKET = "flow_id string, session string, packet_index long, event_id string, timestamp_ns long, source string, ip_length int"
WIRE = "session string, packet_index long, timestamp_ns long, source string, ip_length int, flags int, payload_length int, sequence long, acknowledgment long"
CONNECTION = (
    "key string, session string, uid string, reference string, originator string, start_ns long, end_ns long, counts array<long>, missed_bytes long, label string, detailed string"
)
COMPARE = ["timestamp_ns", "source", "ip_length"]


class Tables:
    """Flows of three opening packets at 10, 20, 30, which two connections hold: 10 to 20 and 30. Cases change one thing each."""

    def __init__(self):
        self.flows, self.packets, self.wire, self.connections, self.index = [], [], [], [], 0

    def add(self, name, times=(10, 20, 30), flow=(), wire=None, connections=None):
        facts = dict(flow_id=name, key=name, transport="tcp", status="CANDIDATE_MATCH", reason="ANCHOR_ONLY", reference=f"{name}1", label="Benign", incomplete=False, closure=None)
        self.flows.append(tuple((facts | dict(flow)).values()))
        for i, t in enumerate(times):
            self.index += 1
            self.packets.append((name, name, self.index, f"e{self.index}", t, "a", 40))
            row = dict(session=name, packet_index=self.index, timestamp_ns=t, source="a", ip_length=40, flags=2, payload_length=0, sequence=7, acknowledgment=0)
            if (changed := (wire or {}).get(i, {})) is not None:
                self.wire.append(tuple((row | changed).values()))
        held = [
            dict(key=name, session=name, uid=f"{name}1", reference=f"{name}1", originator="a", start_ns=10, end_ns=20, counts=[2, 80, 0, 0], missed_bytes=0, label="Benign", detailed="-"),
            dict(key=name, session=name, uid=f"{name}2", reference=f"{name}2", originator="a", start_ns=30, end_ns=None, counts=[1, 40, 0, 0], missed_bytes=0, label="Benign", detailed="-"),
        ]
        self.connections += [tuple((c | (connections or {}).get(i, {})).values()) for i, c in enumerate(held)]

    def recovered(self, spark):
        make = spark.createDataFrame
        frames = make(self.flows, FLOW), make(self.packets, PACKET), make(self.wire, WIRE), make(self.connections, CONNECTION)
        return {r["flow_id"]: r for r in recovery.recovered(*frames, COMPARE).collect()}


def test_recovery_by_case(spark):
    t = Tables()
    t.add("good")
    t.add("closed", flow={"incomplete": True, "closure": "CAPTURE_GAP"})
    t.add("verified", flow={"status": "VERIFIED_MATCH", "reason": "SAME"})
    t.add("udp", flow={"transport": "udp"})
    t.add("twin", connections={1: {"uid": "twin1"}})
    t.add("unseen", wire={1: None})
    t.add("altered", wire={1: {"ip_length": 41}, 2: None})
    t.add("data", wire={1: {"flags": 16}})
    t.add("reuse", wire={2: {"sequence": 8}})
    t.add("stuck", times=(10, 20, 20))
    t.add("gap", times=(10, 20, 25, 30))
    t.add("twice", connections={1: {"start_ns": 20, "end_ns": 30}})
    t.add("counters", connections={0: {"counts": [2, 81, 0, 0]}})
    t.add("bounds", connections={0: {"end_ns": 22}})
    t.add("missed", connections={1: {"missed_bytes": 3}})
    t.add("odd", connections={0: {"label": "Odd"}, 1: {"label": "Odd"}})
    t.add("mixed", connections={1: {"label": "Malicious"}})
    t.add("none", flow={"key": "elsewhere"})
    got = {k: (r["status"], r["reason"], r["basis"]) for k, r in t.recovered(spark).items()}
    assert got == {
        "good": ("VERIFIED_MATCH", recovery.RECOVERED, "RECOVERED"), "closed": ("EXCLUDED", "CAPTURE_GAP", "BASELINE"), "verified": ("VERIFIED_MATCH", "SAME", "BASELINE"),
        "udp": ("CANDIDATE_MATCH", "ANCHOR_ONLY", "BASELINE"), "twin": ("AMBIGUOUS", recovery.DUPLICATE_UID, "UNVERIFIED"),
        "unseen": ("CANDIDATE_MATCH", recovery.UNAVAILABLE, "UNVERIFIED"), "altered": ("EXCLUDED", recovery.MISMATCH, "UNVERIFIED"),
        "data": ("CANDIDATE_MATCH", "ANCHOR_ONLY", "BASELINE"), "reuse": ("CANDIDATE_MATCH", recovery.SEQUENCE, "UNVERIFIED"),
        "stuck": ("EXCLUDED", recovery.TIMES, "UNVERIFIED"), "gap": ("CANDIDATE_MATCH", recovery.UNCOVERED, "UNVERIFIED"), "twice": ("AMBIGUOUS", recovery.UNCOVERED, "UNVERIFIED"),
        "counters": ("CANDIDATE_MATCH", recovery.COUNTERS, "UNVERIFIED"), "bounds": ("CANDIDATE_MATCH", recovery.BOUNDS, "UNVERIFIED"),
        "missed": ("EXCLUDED", recovery.QUALITY, "UNVERIFIED"), "odd": ("EXCLUDED", recovery.QUALITY, "UNVERIFIED"), "mixed": ("AMBIGUOUS", recovery.LABELS, "UNVERIFIED"),
        "none": ("AMBIGUOUS", recovery.REFERENCE, "UNVERIFIED"),
    }


def test_recovered_references_and_labels(spark):
    t = Tables()
    t.add("good", flow={"status": "EXCLUDED", "reason": "NO_END", "reference": None, "label": None})
    t.add("mixed", connections={1: {"label": "Malicious"}})
    t.add("empty", times=())
    got = {k: (list(r["references"]), r["label"]) for k, r in t.recovered(spark).items()}
    assert got == {"good": (["good1", "good2"], "Benign"), "mixed": (["mixed1"], None), "empty": (["empty1"], "Benign")}


def test_connections_hold_packets(spark):
    packets = spark.createDataFrame([("k", f"e{t}", t) for t in (1, 2, 4, 8, 16, 33)], "k string, event_id string, timestamp_ns long")
    conns = spark.createDataFrame([("k", "A", 1, 4), ("k", "B", 8, 8), ("k", "C", 8, 20), ("z", "D", 1, 9)], "k string, uid string, start_ns long, end_ns long")
    for width in (None, 5):
        got = {r["uid"]: (r["packets"], r["shared"]) for r in recovery.row_first(conns, packets, ["k"], width).collect()}
        assert got == {"A": (3, 0), "B": (1, 1), "C": (2, 1), "D": (0, 0)}
        assert [r["event_id"] for r in recovery.uncovered(conns, packets, ["k"], width).collect()] == ["e33"]
