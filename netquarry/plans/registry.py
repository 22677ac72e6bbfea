"""Every query of the library proper, by name, with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluating, flows, modelling, prepare, profiling, reporting
from .common import counts_as_bigint

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (prepare, profiling, evaluating, flows, modelling, reporting)


def queries() -> dict[str, Query]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: counts_as_bigint(s) for m in _MODULES for k, s in m.ORACLE.items()}


FLAGSHIP: Query = prepare.conflict_summary
