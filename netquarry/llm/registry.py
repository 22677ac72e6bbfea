"""Every query of this subpackage, by name, with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, extract, pii, simhash, token_files, topk, toxicity, warc

_MODULES = (extract, simhash, bpe, toxicity, pii, topk, decontaminate, token_files, chat, warc)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    out = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
