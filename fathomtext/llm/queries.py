"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .byte_bpe import op8_byte_bpe
from .centroids import OP12_SQL, op12_centroids
from .decontaminate import OP10_SQL, op10_decontaminate
from .dominance import OP11_SQL, op11_dominance
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .html_text import op3_html_text
from .line_dedup import OP5_SQL, op5_line_dedup
from .mixing import op13_mixing
from .pii import op9_pii
from .simhash import op7_simhash
from .substring_dedup import op6_substring_dedup
from .token_counts import op4_token_counts
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_html_text": op3_html_text,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash": op7_simhash,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_pii": op9_pii,
    "op10_decontaminate": op10_decontaminate,
    "op11_dominance": op11_dominance,
    "op12_centroids": op12_centroids,
    "op13_mixing": op13_mixing,
}
#: Operators that SQL cannot express, or only too slowly, are tested against brute force instead.
SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_dominance": OP11_SQL,
    "op12_centroids": OP12_SQL,
}
