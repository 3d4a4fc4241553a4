"""The queries and DuckDB statements of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query -> its module here
MODULES = {
    "op1_quality": "quality",
    "op2_chat": "chat",
    "op3_suffix_dedup": "suffix_dedup",
    "op4_token_counts": "token_counts",
    "op5_line_dedup": "line_dedup",
    "op7_decontaminate": "decontaminate",
    "op9_lm_score": "lm_score",
    "op10_jaccard_join": "jaccard_join",
    "op8_langid": "langid",
    "op6_packing": "packing",
}
#: query -> (module, name of its DuckDB statement)
SQL = {"op2_chat": ("chat", "OP2_SQL"), "op5_line_dedup": ("line_dedup", "OP5_SQL")}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f".{module}", __package__), what) for name, (module, what) in SQL.items()}
