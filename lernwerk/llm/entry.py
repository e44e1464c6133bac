"""Queries of this subpackage, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_bpe
from .decontaminate import op10_decontaminate
from .html_extract import op1_html
from .licenses import op9_licenses
from .near_dedup import op2_near_dedup
from .pii import op5_pii
from .quality_classifier import op6_quality_classifier
from .quality_rules import op3_quality_rules
from .source_divergence import SQL as SOURCE_DIVERGENCE_SQL
from .source_divergence import op13_source_divergence
from .source_mixing import op11_source_mixing
from .suffix_dedup import op7_suffix_dedup
from .token_alignment import op12_token_alignment
from .token_counts import op4_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html, op2_near_dedup, op3_quality_rules, op4_token_counts, op5_pii, op6_quality_classifier, op7_suffix_dedup, op8_bpe, op9_licenses, op10_decontaminate, op11_source_mixing, op12_token_alignment, op13_source_divergence)
}
ORACLE_SQL: dict[str, str] = {"op13_source_divergence": SOURCE_DIVERGENCE_SQL}
