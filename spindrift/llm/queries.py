"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.jaccard import OP8_SQL, op8_ngram_jaccard
from spindrift.llm.licenses import op3_license_scan
from spindrift.llm.matrices import op10_packed_matrices
from spindrift.llm.mixing import OP7_SQL, op7_mix_sources
from spindrift.llm.neardup_vectors import OP2_SQL, op2_vector_neardup
from spindrift.llm.packing import op1_best_fit_packing
from spindrift.llm.quality import BASE_SQL, op4_quality_rules, quality_base
from spindrift.llm.sharding import OP6_SQL, op6_byte_sharding
from spindrift.llm.tokenfiles import op9_token_counts
from spindrift.llm.urls import OP5_SQL, op5_url_filter

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_vector_neardup": op2_vector_neardup,
        "op3_license_scan": op3_license_scan,
        "op4_quality_rules": op4_quality_rules,
        "op5_url_filter": op5_url_filter,
        "op6_byte_sharding": op6_byte_sharding,
        "op7_mix_sources": op7_mix_sources,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_token_counts": op9_token_counts,
        "op10_packed_matrices": op10_packed_matrices,
        "quality_base": quality_base,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_vector_neardup": OP2_SQL, "op5_url_filter": OP5_SQL, "op6_byte_sharding": OP6_SQL, "op7_mix_sources": OP7_SQL, "op8_ngram_jaccard": OP8_SQL, "quality_base": BASE_SQL}
