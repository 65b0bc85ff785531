"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from graphloom.llm import oracles
from graphloom.llm.byte_bpe import op2_byte_bpe
from graphloom.llm.jaccard_join import op8_ngram_jaccard_join
from graphloom.llm.language import op5_language_id
from graphloom.llm.media_tiff import op3_media_tiff
from graphloom.llm.neardup_vectors import op4_neardup_vectors
from graphloom.llm.packing import op9_packing_bm25
from graphloom.llm.quality import op10_quality_classifier
from graphloom.llm.repeats import op6_substring_dedup
from graphloom.llm.token_counts import op7_token_counts
from graphloom.llm.toxicity import op1_toxicity_fm

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity_fm": op1_toxicity_fm,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_media_tiff": op3_media_tiff,
    "op4_neardup_vectors": op4_neardup_vectors,
    "op5_language_id": op5_language_id,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_packing_bm25": op9_packing_bm25,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op4_neardup_vectors": oracles.VECTORS,
    "op6_substring_dedup": oracles.REPEATS,
    "op8_ngram_jaccard_join": oracles.JACCARD,
}

if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
