"""Queries over the synthetic tables, one for each operator, and their SQL."""

from __future__ import annotations

from plumbline.llm.chunked_bpe import op9_chunked_bpe
from plumbline.llm.embedding_dedup import op8_embedding_dedup
from plumbline.llm.html_extraction import op1_html_extraction
from plumbline.llm.jaccard_join import op6_jaccard_join
from plumbline.llm.language_id import op10_language_id
from plumbline.llm.metric_search import op2_metric_search
from plumbline.llm.packing import op5_packing
from plumbline.llm.quality_nbsvm import op4_quality_nbsvm
from plumbline.llm.quotation_linking import ORACLE_SQL as OP3_SQL
from plumbline.llm.quotation_linking import op3_quotation_linking
from plumbline.llm.resharding import op7_resharding

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_metric_search": op2_metric_search,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_quality_nbsvm": op4_quality_nbsvm,
    "op5_packing": op5_packing,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_resharding": op7_resharding,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_chunked_bpe": op9_chunked_bpe,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quotation_linking": OP3_SQL,
}
