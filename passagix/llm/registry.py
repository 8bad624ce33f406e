"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passagix.llm.ann import op2_nearest_neighbours
from passagix.llm.fingerprints import op9_document_fingerprints
from passagix.llm.langid import op4_language_id
from passagix.llm.licenses import OP1_SQL, op1_license_scan
from passagix.llm.lines import OP10_SQL, op10_line_dedup
from passagix.llm.mixing import OP3_SQL, op3_source_mixing
from passagix.llm.packing import op8_best_fit_packing
from passagix.llm.simhash import op6_simhash_near_dedup
from passagix.llm.tokens import op7_token_counts
from passagix.llm.toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_nearest_neighbours,
        op3_source_mixing,
        op4_language_id,
        op5_toxicity,
        op6_simhash_near_dedup,
        op7_token_counts,
        op8_best_fit_packing,
        op9_document_fingerprints,
        op10_line_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_license_scan": OP1_SQL, "op3_source_mixing": OP3_SQL, "op10_line_dedup": OP10_SQL}
