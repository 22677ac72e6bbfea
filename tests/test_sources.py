import bz2
import struct

import pytest
from pyspark.sql import functions as F

from netquarry.sources import captures, logs, tables
from netquarry.streaming import flows as streaming

from .conftest import rows


def ipv4(transport, payload=b"", flags=2):
    tcp = struct.pack("!HHIIHHHH", 1000, 80, 1, 2, 5 << 12 | flags, 0, 0, 0)
    udp = struct.pack("!HHHH", 1000, 80, 8 + len(payload), 0)
    body = (tcp if transport == 6 else udp) + payload
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, transport, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + body


def ipv6(transport):
    body = struct.pack("!HHIIHHHH", 1000, 80, 1, 2, 5 << 12 | 18, 0, 0, 0) if transport == 6 else struct.pack("!HHHH", 1000, 80, 8, 0)
    return struct.pack("!IHBB16s16s", 6 << 28, len(body), transport, 64, bytes(15) + b"\x01", bytes(15) + b"\x02") + body


def ethernet(ip, kind, tag=False):
    return bytes(12) + (struct.pack("!HH", 0x8100, 5) if tag else b"") + struct.pack("!H", kind) + ip


FRAMES = [ethernet(ipv4(6), 0x800), ethernet(ipv4(17), 0x800, True), ethernet(ipv6(6), 0x86DD), ethernet(ipv6(17), 0x86DD)]


def pcap(order, nano, frames=FRAMES):
    out = struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return out + b"".join(struct.pack(order + "IIII", 5, i + 1, len(f), len(f)) + f for i, f in enumerate(frames))


def pcapng(order, resolution=6, frames=FRAMES):
    block = lambda kind, body: struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3xHH", 9, 1, resolution, 0, 0))
    for i, f in enumerate(frames):
        ticks = 5 * 10**resolution + i + 1
        body = struct.pack(order + "IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f + bytes(-len(f) % 4)
        out += block(6, body)
    return out


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("nano", [False, True])
def test_capture_formats(order, nano):
    tick = 1 if nano else 1000
    want = [5 * 10**9 + (i + 1) * tick for i in range(4)]
    assert [r[0] for r in captures.records(pcap(order, nano))] == want
    assert [r[0] for r in captures.records(pcapng(order, 9 if nano else 6))] == want
    assert [r[0] for r in captures.records(bz2.compress(pcap(order, nano)))] == want


@pytest.mark.parametrize("cut", [0, 5, 23, 30, 39, 50])
def test_cut_captures(cut):
    with pytest.raises(captures.Damaged, match="TRUNCATED"):
        list(captures.records(pcap("<", False)[:cut]))


def test_damaged_captures():
    good = bz2.compress(pcap("<", False))
    for raw, what in ((good + b"x", "BZIP2_TRAILING"), (good[:-4], "BZIP2_TRUNCATED"), (b"\0" * 40, "MAGIC"), (pcap("<", False).replace(b"\x02\0\x04\0", b"\x03\0\x04\0", 1), "VERSION")):
        with pytest.raises(captures.Damaged, match=what):
            list(captures.records(raw))


def test_frames():
    got = [captures.frame(f, len(f), len(f)) for f in FRAMES]
    assert [(g["transport"], g["ip_length"], g["tcp_flags"], g["source_address"]) for g in got] == [
        ("tcp", 40, 2, "10.0.0.1"), ("udp", 28, 0, "10.0.0.1"), ("tcp", 60, 18, "::1"), ("udp", 48, 0, "::1"),
    ]
    assert all(captures.frame(FRAMES[0][:n], n, n)["error"] for n in (0, 10, 13, 15, 30, 40))
    assert captures.frame(ethernet(ipv4(1), 0x800), 42, 42)["error"] == "TRANSPORT"
    assert captures.frame(ethernet(b"", 0x806), 14, 14)["error"] == "ETHERTYPE"


def test_capture_source(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap("<", False))
    (tmp_path / "b.pcapng").write_bytes(pcapng(">"))
    (tmp_path / "c.pcap").write_bytes(pcap("<", False)[:-3])
    got = captures.decoded(captures.read(spark, f"{tmp_path}/*.pcap*"))
    counts = got.groupBy(F.element_at(F.split("path", "/"), -1).alias("f")).agg(F.count("frame.transport").alias("n"), F.max("error").alias("e"))
    assert rows(counts) == [("a.pcap", 4, None), ("b.pcapng", 4, None), ("c.pcap", 3, "TRUNCATED")]


def test_csv_reconciliation(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Label, x ,y\nA,1,2\nLabel,x,y\n")
    (tmp_path / "b.csv").write_text("x,Label,z\n3,B,4\n")
    df = tables.reconciled(spark, f"{tmp_path}/*.csv", "Label")
    assert df.columns == ["Label", "x", "source_file"] and rows(df) == [("A", "1", "a.csv"), ("B", "3", "b.csv")]
    report = tables.schema_report({"a": ["Label", "x", "y"], "b": ["x", "Label", "z"]})
    assert report == {"common": ["Label", "x"], "union": ["Label", "x", "y", "z"], "extra": {"a": ["y"], "b": ["z"]}}
    with pytest.raises(FileNotFoundError):
        tables.files(spark, f"{tmp_path}/*.none")
    tagged = tables.tagged(spark, {"benign": [f"{tmp_path}/a.csv"], "attack": [f"{tmp_path}/b.csv"]})
    assert tagged.groupBy("Type").count().count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.5]), (2, None, [])], "i int, s string, v array<double>")
    tables.write_sealed_jsonl(df, f"{tmp_path}/j")
    assert rows(tables.read_sealed_jsonl(spark, f"{tmp_path}/j", df.schema)) == rows(df)
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_sealed_jsonl(df, f"{tmp_path}/j")
    df.limit(1).write.mode("append").json(f"{tmp_path}/j/rows")
    with pytest.raises(ValueError, match="seals"):
        tables.read_sealed_jsonl(spark, f"{tmp_path}/j", df.schema)
    assert tables.write_parquet(df, f"{tmp_path}/p", if_there="skip") and not tables.write_parquet(df, f"{tmp_path}/p", if_there="skip")
    built = tables.valid_or_rebuilt(spark, f"{tmp_path}/p", df.columns, 3, lambda: df.union(df.limit(1)))
    assert built.count() == 3
    assert tables.parquet(spark, f"{tmp_path}/p", ["s"]).columns == ["s"]
    tables.write_csv(df.drop("v"), f"{tmp_path}/c")
    tables.write_csv(df.drop("v"), f"{tmp_path}/c", append=True)
    assert tables.csv(spark, f"{tmp_path}/c").count() == 4
    (tmp_path / "m.json").write_text('{"Benign": 0, "Bot": 1}')
    told = tables.mapping(spark, f"{tmp_path}/m.json")
    assert [r[0] for r in spark.range(3).select(tables.named(F.col("id").cast("int"), told)).collect()] == ["Benign", "Bot", None]


HEAD = "#separator \\x09\n#fields\t{}\n#types\t-\n"


def test_zeek(spark, tmp_path):
    from netquarry.sources.contracts import ZEEK

    names = "\t".join(ZEEK[:20]) + "\ttunnel_parents   label   det_label"
    line = "1.5\tC1\t10.0.0.1\t5\t10.0.0.2\t80\ttcp\t-\t2.000000001\t1\t2\tSF\t-\t-\t0\tS\t1\t40\t1\t40\t"
    open_ended = line.replace("2.000000001", "-").replace("1.5\tC1", "1.0000000001\tC2")
    (tmp_path / "z.log").write_text(HEAD.format(names) + line + "(empty)   Malicious   C&C\n" + open_ended + "-\t-\t-\n" + "x\ty\n#close\n")
    (tmp_path / "bad.log").write_text(HEAD.format("ts\tuid") + line + "-\tBenign\t-\n")
    got = {(r["file"].rsplit("/")[-1], r["uid"]): r for r in logs.zeek(spark, f"{tmp_path}/*.log").collect()}
    good = got["z.log", "C1"]
    assert (good["start_ns"], good["end_ns"], good["label"], good["detailed"], good["counts"], good["error"]) == (1_500_000_000, 3_500_000_001, "Malicious", "C&C", [1, 40, 1, 40], None)
    assert got["z.log", "C2"]["error"] == "START" and got["z.log", "y"]["error"] == "CELLS" and got["bad.log", "C1"]["error"] == "HEADER"


def test_argus(spark, tmp_path):
    head = "StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,Label\n"
    (tmp_path / "a.csv").write_text(
        head + "2011/08/18 10:19:13.328200,0.5,tcp,10.0.0.1,5,->,10.0.0.2,0x50,flow=From-Botnet-V48-TCP\n"
        "2011/08/18 10:19:13,1,tcp,a,1,->,b,2,x\n2011/08/18 10:19:13.000000,1,icmp,a,1,->,b,2,flow=From-Normal-V48-X\n"
    )
    got = logs.argus(spark, f"{tmp_path}/a.csv", 2).collect()
    first = got[0]
    assert (first["start_ns"], first["end_ns"] - first["start_ns"], first["destination_port"], first["kind"]) == (1313655553328200000, 500_000_000, 80, "BOTNET")
    assert [r["error"] for r in got] == [None, "TIME", "TRANSPORT"] and got[2]["kind"] == "NORMAL"


def test_streamed_flows(spark, tmp_path):
    day = "2024-01-01 "
    data = [("a", day + "00:00:00", 40), ("a", day + "00:00:10", 40), ("a", day + "00:01:00", 40), ("b", day + "00:00:05", 50), ("z", day + "01:00:00", 1), ("z", day + "01:00:01", 1)]
    df = spark.createDataFrame(data, "k string, t string, n int").select("k", F.to_timestamp("t").alias("ts"), "n")
    for i in range(2):  # two batches: the second lets the watermark close what is open
        df.where(F.col("k") != "z" if i == 0 else F.col("k") == "z").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    src = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = streaming.sessions(src, "k", "ts", "n", 30_000_000, 120_000_000, 4096)
    q = out.writeStream.format("memory").queryName("flows").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r["key"], r["packets"], r["closure"]) for r in spark.table("flows").collect()}
    assert got == {("a", 2, "IDLE_TIMEOUT"), ("a", 1, "IDLE_TIMEOUT"), ("b", 1, "IDLE_TIMEOUT")}
