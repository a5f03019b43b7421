"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_bpe import op1_bpe
from .op10_packing import op10_packing
from .op2_quality_rules import op2_quality_rules
from .op3_suffix_dedup import op3_suffix_dedup
from .op4_language import op4_language
from .op5_exact_dedup import ORACLE as EXACT_DEDUP
from .op5_exact_dedup import op5_exact_dedup
from .op6_minhash import op6_minhash
from .op7_warc import ORACLE as WARC
from .op7_warc import op7_warc
from .op8_quality_classifier import op8_quality_classifier
from .op9_url_filters import ORACLE as URL_FILTERS
from .op9_url_filters import op9_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_quality_rules, op3_suffix_dedup, op4_language, op5_exact_dedup, op6_minhash, op7_warc, op8_quality_classifier, op9_url_filters, op10_packing)
}
ORACLES: dict[str, str] = {"op5_exact_dedup": EXACT_DEDUP, "op7_warc": WARC, "op9_url_filters": URL_FILTERS}
