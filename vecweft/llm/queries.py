"""Registered queries of this subpackage, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact_dedup, facts, langid, near_dedup, packing, pii, quality, sharding, toxicity
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": lambda s, d: chat.recover(table(s, d, "conversations")),
        "op2_packing": lambda s, d: packing.pack(table(s, d, "documents")),
        "op3_quality": lambda s, d: quality.rate(table(s, d, "documents")),
        "op4_sharding": lambda s, d: sharding.shard_report(table(s, d, "documents")),
        "op5_exact_dedup": lambda s, d: exact_dedup.exact_dedup(table(s, d, "documents")),
        "op6_langid": lambda s, d: langid.identify(table(s, d, "documents")),
        "op7_pii": lambda s, d: pii.report(table(s, d, "documents"), pii.session_key(s)),
        "op8_bpe": lambda s, d: bpe.round_trip(table(s, d, "documents")),
        "op9_near_dedup": lambda s, d: near_dedup.near_duplicates(table(s, d, "documents"), words=4),
        "op10_toxicity": lambda s, d: toxicity.score(table(s, d, "documents"), table(s, d, "labels")),
    } | facts.queries()


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.SQL, "op9_near_dedup": near_dedup.sql()} | facts.oracle_sql()
