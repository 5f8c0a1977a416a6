"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.decontam import op4_decontamination
from quillgraph.llm.fim import op11_fim
from quillgraph.llm.fingerprint import op9_fingerprints
from quillgraph.llm.langid import op3_language
from quillgraph.llm.mixing import op1_mixing
from quillgraph.llm.neardup import op10_neardup
from quillgraph.llm.oracle import oracle_sql
from quillgraph.llm.pii import op6_pii
from quillgraph.llm.secretscan import op7_secrets
from quillgraph.llm.substring import op5_substring
from quillgraph.llm.tokencount import op12_token_counts
from quillgraph.llm.toxicity import op8_toxicity
from quillgraph.llm.urlfilter import op2_url_filter
from quillgraph.llm.variants import op13_variants

__all__ = ["oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_url_filter, op3_language, op4_decontamination, op5_substring, op6_pii, op7_secrets, op8_toxicity, op9_fingerprints, op10_neardup, op11_fim, op12_token_counts, op13_variants)}
