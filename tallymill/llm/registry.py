"""The queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from .chat import OP8_SQL, op8_chat_format
from .divergence import OP11_SQL, op11_source_divergence
from .fingerprints import op2_fingerprints
from .lm_scoring import op5_lm_scoring
from .mixing import OP10_SQL, op10_mixing
from .packing import op9_packing
from .pii import op7_pii
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality_classifier import op3_quality_classifier
from .quality_rules import OP4_SQL, op4_quality_rules
from .secrets import op1_secret_scan
from .sentencepieces import op12_sentencepiece
from .simhash import op6_simhash
from .spans_sql import OP1_SQL, OP7_SQL

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_fingerprints, op3_quality_classifier, op4_quality_rules, op5_lm_scoring, op6_simhash, op7_pii, op8_chat_format, op9_packing, op10_mixing, op11_source_divergence, op12_sentencepiece, op13_prefix_trie)}
SQL = {"op1_secret_scan": OP1_SQL, "op4_quality_rules": OP4_SQL, "op7_pii": OP7_SQL, "op8_chat_format": OP8_SQL, "op10_mixing": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_prefix_trie": OP13_SQL}
