"""The queries of this folder: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .codes import op11_vector_codes
from .common import bounded_batches
from .contamination import op4_decontamination
from .jaccard import op9_jaccard_join
from .mixing import op3_mixing
from .neighbours import op6_nearest
from .pii import op7_pii
from .quality import op8_quality
from .secrets import op10_secrets
from .tokens import op5_token_counts
from .topk import op12_exact_top_k
from .urls import op1_url_filter
from .warc import op2_warc_derivatives



def bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_nearest": op6_nearest,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_secrets": op10_secrets,
    "op11_vector_codes": op11_vector_codes,
    "op12_exact_top_k": op12_exact_top_k,
}
QUERIES = {name: bounded(query) for name, query in QUERIES.items()}
