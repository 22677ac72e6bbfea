"""Schemas of what comes in."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

PACKET = (
    "event_id string, interface_id string, capture_session_id string, timestamp_ns bigint, source_address string, source_port int, "
    "destination_address string, destination_port int, transport string, ip_length int, tcp_flags int"
)
RECORD = "path string, index bigint, timestamp_ns bigint, captured_length int, wire_length int, header binary, error string"
FRAME = "source_address string, source_port int, destination_address string, destination_port int, transport string, ip_length int, tcp_flags int, error string"

# The columns of a labelled Zeek connection log.
ZEEK = (
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration", "orig_bytes", "resp_bytes", "conn_state",
    "local_orig", "local_resp", "missed_bytes", "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes", "tunnel_parents", "label",
    "detailed-label",
)
# The columns of a bidirectional Argus log that are read.
ARGUS = ("StartTime", "Dur", "Proto", "SrcAddr", "Sport", "Dir", "DstAddr", "Dport", "Label")


def digest(names: Sequence[str]) -> str:
    """Names a feature contract: SHA-256 of its ordered names, one a line."""
    return hashlib.sha256("\n".join(names).encode()).hexdigest()
