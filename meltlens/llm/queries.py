"""Registered queries of the package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP6_SQL, op6_decontamination
from .fill_in_middle import OP12_SQL, op12_fill_in_middle
from .html_extract import op5_html_extract
from .jaccard_join import OP8_SQL, op8_jaccard_join
from .merkle_manifest import OP11_SQL, op11_merkle_manifest
from .packing import op10_best_fit_packing
from .quality_classifier import op4_quality_classifier
from .quality_rules import OP3_SQL, op3_quality_rules
from .quote_links import op2_quote_links
from .secret_scan import OP7_SQL, op7_secret_scan
from .source_mixing import OP13_SQL, op13_source_mixing
from .token_codes import op9_token_codes
from .url_filter import OP1_SQL, op1_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_quote_links": op2_quote_links,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_html_extract": op5_html_extract,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_token_codes": op9_token_codes,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_mixing": op13_source_mixing,
}
ORACLE = {
    "op1_url_filter": OP1_SQL,
    "op3_quality_rules": OP3_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_secret_scan": OP7_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_source_mixing": OP13_SQL,
}
