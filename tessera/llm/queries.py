"""The queries of this subpackage and their SQL, for the catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bwt_dedup import op9_bwt_dedup
from tessera.llm.centroids import OP13_SQL, op13_centroids
from tessera.llm.decontaminate import op10_decontaminate
from tessera.llm.near_dedup import OP1_SQL, op1_near_dedup
from tessera.llm.ngram_lm import op8_lm_score
from tessera.llm.packing import op6_packing
from tessera.llm.phrases import OP12_SQL, op12_phrases
from tessera.llm.pii import op7_pii
from tessera.llm.quality_rules import op4_quality_rules
from tessera.llm.simhash_dedup import op11_simhash
from tessera.llm.substring_dedup import OP5_SQL, op5_substring_dedup
from tessera.llm.token_archive import op3_token_archive
from tessera.llm.warc_store import OP2_SQL, op2_warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_warc": op2_warc,
        "op3_token_archive": op3_token_archive,
        "op4_quality_rules": op4_quality_rules,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_packing": op6_packing,
        "op7_pii": op7_pii,
        "op8_lm_score": op8_lm_score,
        "op9_bwt_dedup": op9_bwt_dedup,
        "op10_decontaminate": op10_decontaminate,
        "op11_simhash": op11_simhash,
        "op12_phrases": op12_phrases,
        "op13_centroids": op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": OP1_SQL,
        "op2_warc": OP2_SQL,
        "op5_substring_dedup": OP5_SQL,
        "op12_phrases": OP12_SQL,
        "op13_centroids": OP13_SQL,
    }
