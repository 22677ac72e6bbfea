"""Packet predicates and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYN, FIN, RST, ACK = 2, 1, 4, 16


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def endpoint(address: str, port: str) -> Column:
    return F.struct(F.col(address).alias("address"), F.col(port).alias("port"))


def flow_key(transport: str = "transport", source=("source_address", "source_port"), destination=("destination_address", "destination_port")) -> Column:
    """The same struct for both directions: transport, then the two endpoints in order (addresses as text)."""
    a, b = endpoint(*source), endpoint(*destination)
    return F.struct(F.col(transport).alias("transport"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


_V4 = r"\A(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!\z)|\z)){4}\z"


def is_v4(address: Column) -> Column:
    return address.rlike(_V4)


def is_v6(address: Column) -> Column:
    """Canonical text: lower case, no leading zeros, one run of two zero groups or more written "::"."""
    group = "(?:0|[1-9a-f][0-9a-f]{0,3})"
    whole = address.rlike(rf"\A{group}(?::{group}){{7}}\z") & ~address.rlike(r"(?:\A|:)0:0(?:\z|:)")
    short = address.rlike(rf"\A(?:{group}(?::{group})*)?::(?:{group}(?::{group})*)?\z")
    groups = F.size(F.filter(F.split(address, ":"), lambda g: g != ""))
    ends = ~address.rlike(r"(?:\A|:)0::") & ~address.rlike(r"::0(?:\z|:)")
    return whole | (short & (groups <= 6) & ends)


def fault() -> Column:
    """Name of the first rule that a packet breaks, null if it is valid. Columns as in sources.contracts.PACKET."""
    c = F.col
    v4 = is_v4(c("source_address")) & is_v4(c("destination_address"))
    v6 = is_v6(c("source_address")) & is_v6(c("destination_address"))
    least = F.when(c("transport") == "tcp", 20).otherwise(8) + F.when(v6, 40).otherwise(20)
    rules = (
        ("EVENT_ID", F.length("event_id").between(1, 256)),
        ("INTERFACE", c("interface_id").rlike(r"\A[0-9a-f]{64}\z")),
        ("SESSION", F.length("capture_session_id").between(1, 128)),
        ("TIMESTAMP", c("timestamp_ns") >= 0),
        ("TRANSPORT", c("transport").isin("tcp", "udp")),
        ("PORT", c("source_port").between(0, 65535) & c("destination_port").between(0, 65535)),
        ("FLAGS", c("tcp_flags").between(0, 511) & ((c("transport") == "tcp") | (c("tcp_flags") == 0))),
        ("ADDRESS", v4 | v6),
        ("LENGTH", c("ip_length").between(least, 65535)),
        ("SELF_PAIR", ~((c("source_address") == c("destination_address")) & (c("source_port") == c("destination_port")))),
    )
    out = F.lit(None).cast("string")
    for name, good in reversed(rules):
        out = F.when(F.coalesce(good, F.lit(False)), out).otherwise(F.lit(name))
    return out
