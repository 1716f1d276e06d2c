"""The queries of this subpackage, one for each operator, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import shipped
from .bpe import op6_bpe_segment_tree
from .hash_forest import op2_hash_forest
from .language import op4_language_svm
from .ngram_join import op10_ngram_jaccard
from .norm_buckets import op3_norm_bucket_topk
from .packing import op9_best_fit_packing
from .quality import op1_quality_knn
from .sentence_spans import op8_sentence_spans
from .sql import ORACLES
from .tokenbin import op5_token_binary
from .warc import op7_warc_zstd


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_quality_knn": op1_quality_knn,
        "op2_hash_forest": op2_hash_forest,
        "op3_norm_bucket_topk": op3_norm_bucket_topk,
        "op4_language_svm": op4_language_svm,
        "op5_token_binary": op5_token_binary,
        "op6_bpe_segment_tree": op6_bpe_segment_tree,
        "op7_warc_zstd": op7_warc_zstd,
        "op8_sentence_spans": op8_sentence_spans,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_ngram_jaccard": op10_ngram_jaccard,
    }
    return {name: shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
