"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import op4_chat
from .decontaminate import op5_decontaminate
from .languages import op10_languages, op10_page_languages
from .near_dups import op9_near_dups
from .oracles import OP5, OP8, OP9
from .pieces import op2_sentencepiece
from .substrings import op8_substrings
from .token_counts import op6_token_counts
from .token_files import op1_token_files
from .toxicity import op3_toxicity
from .winnowing import op7_winnowing

QUERIES = {f.__name__: f for f in (op1_token_files, op2_sentencepiece, op3_toxicity, op4_chat, op5_decontaminate, op6_token_counts, op7_winnowing, op8_substrings, op9_near_dups, op10_languages, op10_page_languages)}
ORACLE_SQL: dict[str, str] = {"op5_decontaminate": OP5, "op8_substrings": OP8, "op9_near_dups": OP9}
