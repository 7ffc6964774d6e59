"""Queries of the training-data operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from .embeddings import op8_embedding_neardup
from .language import op2_language_id
from .licenses import op7_license_scan
from .licenses import oracle as license_sql
from .mixing import op10_mixing
from .neardup import op6_minhash_neardup
from .pieces import op1_sentencepiece
from .ppm import op3_lm_score
from .quality import op5_quality_rules
from .quality import oracle as quality_sql
from .tokenfiles import op4_token_files
from .toxicity import op9_toxicity

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_lm_score": op3_lm_score,
    "op4_token_files": op4_token_files,
    "op5_quality_rules": op5_quality_rules,
    "op6_minhash_neardup": op6_minhash_neardup,
    "op7_license_scan": op7_license_scan,
    "op8_embedding_neardup": op8_embedding_neardup,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
}
ORACLES = {"op5_quality_rules": quality_sql(), "op7_license_scan": license_sql()}
