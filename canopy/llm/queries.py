"""Queries of this package: each applies its operator with production parameters to its whole table. SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canopy.llm.decontamination import op9_decontamination
from canopy.llm.html_extraction import op8_html_extraction
from canopy.llm.jaccard_join import op10_jaccard_join
from canopy.llm.line_dedup import OP3_SQL, op3_line_dedup
from canopy.llm.mixing import op4_mixing
from canopy.llm.quality_classifier import op1_quality_classifier
from canopy.llm.quality_rules import OP7_SQL, op7_quality_rules
from canopy.llm.secrets import OP5_SQL, op5_secrets
from canopy.llm.sharding import op2_shard
from canopy.llm.warc import OP6_SQL, op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_shard": op2_shard,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extraction": op8_html_extraction,
    "op9_decontamination": op9_decontamination,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op5_secrets": OP5_SQL, "op6_warc": OP6_SQL, "op7_quality_rules": OP7_SQL}
