"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL, run

from .alignment import op13_token_alignment
from .embedding_dedup import op1_embedding_dedup
from .exact_dedup import op12_exact_dedup
from .html_text import op8_html_text
from .importance import op11_importance_resampling
from .language_id import op6_language_id
from .license_scan import op3_license_scan
from .line_dedup import op7_line_dedup
from .oracles import EMBEDDING_DEDUP, EXACT_DEDUP, IMPORTANCE, LINE_DEDUP
from .packing import op5_packing
from .quality_rules import op10_quality_rules
from .sentencepiece_viterbi import op4_sentencepiece
from .simhash import op2_simhash
from .url_filter import op9_url_filter

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_simhash": op2_simhash,
    "op3_license_scan": op3_license_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_html_text": op8_html_text,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": run,
}

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": EMBEDDING_DEDUP,
    "op7_line_dedup": LINE_DEDUP,
    "op11_importance_resampling": IMPORTANCE,
    "op12_exact_dedup": EXACT_DEDUP,
}

if ORACLE_SQL:
    ORACLES["pipeline"] = ORACLE_SQL
