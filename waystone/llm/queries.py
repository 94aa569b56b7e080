"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op6_chat_formatting
from .decontaminate import op2_benchmark_decontamination
from .embeddings import op9_embedding_near_dedup
from .fim import op13_fill_in_middle
from .html import op8_html_extraction
from .langid import op10_language_id
from .licenses import op1_license_scans
from .lm import op12_lm_scoring
from .mixing import op4_mix_sources
from .ngram_join import op7_ngram_jaccard_join
from .oracles import ORACLES
from .quality import op3_quality_classifier
from .resample import op11_importance_resampling
from .secrets import op5_secret_scans

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    t = _table
    return {
        "op1_license_scans": lambda s, d: op1_license_scans(t(s, d, "documents")),
        "op2_benchmark_decontamination": lambda s, d: op2_benchmark_decontamination(t(s, d, "documents"), t(s, d, "benchmark")),
        "op3_quality_classifier": lambda s, d: op3_quality_classifier(t(s, d, "documents"), t(s, d, "labels")),
        "op4_mix_sources": lambda s, d: op4_mix_sources(t(s, d, "documents")),
        "op5_secret_scans": lambda s, d: op5_secret_scans(t(s, d, "documents")),
        "op6_chat_formatting": lambda s, d: op6_chat_formatting(t(s, d, "conversations")),
        "op7_ngram_jaccard_join": lambda s, d: op7_ngram_jaccard_join(t(s, d, "documents")),
        "op8_html_extraction": lambda s, d: op8_html_extraction(t(s, d, "pages")),
        "op9_embedding_near_dedup": lambda s, d: op9_embedding_near_dedup(t(s, d, "embeddings")),
        "secret_base": lambda s, d: op5_secret_scans(t(s, d, "documents")).drop("spans"),
        "op10_language_id": lambda s, d: op10_language_id(t(s, d, "documents")),
        "op11_importance_resampling": lambda s, d: op11_importance_resampling(t(s, d, "documents"), t(s, d, "benchmark")),
        "op12_lm_scoring": lambda s, d: op12_lm_scoring(t(s, d, "documents")),
        "op13_fill_in_middle": lambda s, d: op13_fill_in_middle(t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
