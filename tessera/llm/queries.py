"""The queries of this package: builders (spark, sf_dir) -> DataFrame, and DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontamination import op9_decontamination
from tessera.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from tessera.llm.license_scan import op5_license_scan
from tessera.llm.lm_scoring import op13_lm_scoring
from tessera.llm.ngram_join import OP8_SQL, op8_ngram_join
from tessera.llm.quality import op10_quality
from tessera.llm.ranked_search import OP12_SQL, op12_ranked_search
from tessera.llm.source_mixing import op4_source_mixing
from tessera.llm.token_counts import op1_token_counts
from tessera.llm.token_output import op3_token_output
from tessera.llm.toxicity import op7_toxicity
from tessera.llm.url_filters import op2_url_filters
from tessera.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filters": op2_url_filters,
    "op3_token_output": op3_token_output,
    "op4_source_mixing": op4_source_mixing,
    "op5_license_scan": op5_license_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_join": op8_ngram_join,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_ranked_search": op12_ranked_search,
    "op13_lm_scoring": op13_lm_scoring,
}
ORACLE_SQL: dict[str, str] = {"op6_exact_dedup": OP6_SQL, "op8_ngram_join": OP8_SQL,
                              "op11_vector_codes": OP11_SQL, "op12_ranked_search": OP12_SQL}
