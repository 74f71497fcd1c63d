"""The queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ball_tree import OP12_SQL, op12_centroid_clusters
from .crf_language import op11_language_id
from .exact_digest import op7_document_fingerprints
from .media import op10_media_columns
from .merkle import OP13_SQL, op13_merkle_manifest
from .packing import op8_best_fit_packing
from .suffix_dedup import op3_suffix_dedup
from .token_counts import op2_token_counts
from .sentencepiece_fst import op4_sentencepiece
from .simhash import op5_simhash_near_dedup
from .toxicity import op6_toxicity
from .url_filter import op1_url_filter
from .warc import op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_token_counts, op3_suffix_dedup, op4_sentencepiece, op5_simhash_near_dedup, op6_toxicity, op7_document_fingerprints, op8_best_fit_packing, op9_warc, op10_media_columns, op11_language_id, op12_centroid_clusters, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op12_centroid_clusters": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
