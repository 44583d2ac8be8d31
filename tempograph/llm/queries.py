"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .ann import op7_nearest_neighbours
from .chat_format import op8_chat_format
from .media import op9_lossless_webp
from .near_dedup import op10_near_dedup
from .packing import op5_packing
from .quality import op4_quality_classifier
from .secret_scan import op1_secret_scan
from .token_counts import op3_token_counts
from .token_encoding import op2_bpe_encoding
from .url_filter import op6_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_bpe_encoding, op3_token_counts, op4_quality_classifier, op5_packing, op6_url_filter, op7_nearest_neighbours, op8_chat_format, op9_lossless_webp, op10_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return sql.all_()
