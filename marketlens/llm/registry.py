"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm.concat_cut import op12_concat_packing
from marketlens.llm.decontaminate import op4_decontaminate
from marketlens.llm.filter_audit import OP11_SQL, op11_filter_audit
from marketlens.llm.hmm import op2_lm_scores
from marketlens.llm.licenses import op3_licenses
from marketlens.llm.linkrank import op10_urls
from marketlens.llm.neardup import op7_neardup
from marketlens.llm.packing import op8_packing
from marketlens.llm.quality import op9_quality
from marketlens.llm.sharding import op1_shards
from marketlens.llm.token_alignment import op13_token_alignment
from marketlens.llm.token_counts import op6_token_counts
from marketlens.llm.token_files import op5_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {fn.__name__: fn for fn in (
    op1_shards, op2_lm_scores, op3_licenses, op4_decontaminate, op5_token_files,
    op6_token_counts, op7_neardup, op8_packing, op9_quality, op10_urls, op11_filter_audit,
    op12_concat_packing, op13_token_alignment)}
#: Random draws, fitted models, tokenizer tables and iterations to a limit have no SQL twin, counts do;
#: the tests hold the others against brute force.
SQL: dict[str, str] = {"op11_filter_audit": OP11_SQL}
