"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from lattica.llm.alignment import op11_alignment
from lattica.llm.decontaminate import op1_decontaminate
from lattica.llm.html_text import op8_html_text
from lattica.llm.idstream import op9_idstream
from lattica.llm.line_dedup import op6_line_dedup
from lattica.llm.media import op5_media
from lattica.llm.pii import op4_pii
from lattica.llm.repeats import op13_repeats
from lattica.llm.secrets import op10_secrets
from lattica.llm.simhash import op3_simhash
from lattica.llm.sketches import SQL as SKETCH_SQL
from lattica.llm.sketches import op12_sketch_search
from lattica.llm.toxicity import op2_toxicity
from lattica.llm.wordpieces import op7_sentencepiece

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_media": op5_media,
    "op6_line_dedup": op6_line_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_html_text": op8_html_text,
    "op9_idstream": op9_idstream,
    "op10_secrets": op10_secrets,
    "op11_alignment": op11_alignment,
    "op12_sketch_search": op12_sketch_search,
    "op13_repeats": op13_repeats,
}
ORACLES: dict[str, str] = {"op12_sketch_search": SKETCH_SQL}
