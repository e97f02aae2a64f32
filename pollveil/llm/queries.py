"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pollveil.llm.decontaminate import op4_qgram_decontamination
from pollveil.llm.hmm import op6_hmm_language_model
from pollveil.llm.htmltext import op5_html_main_text
from pollveil.llm.infill import op13_fill_in_middle
from pollveil.llm.infill import oracle as op13_oracle
from pollveil.llm.isomedia import op3_iso_media
from pollveil.llm.langid import op8_ecoc_language_id
from pollveil.llm.licenses import op10_license_scan
from pollveil.llm.licenses import oracle as op10_oracle
from pollveil.llm.linededup import op11_line_dedup
from pollveil.llm.linededup import oracle as op11_oracle
from pollveil.llm.packing import op9_mixture_packing
from pollveil.llm.repeats import op12_periodic_runs
from pollveil.llm.simhash import op1_simhash_near_dedup
from pollveil.llm.token_spans import op2_section_token_counts
from pollveil.llm.urlfilter import op7_bloom_url_filter
from pollveil.llm.urlfilter import oracle as op7_oracle

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_section_token_counts": op2_section_token_counts,
    "op3_iso_media": op3_iso_media,
    "op4_qgram_decontamination": op4_qgram_decontamination,
    "op5_html_main_text": op5_html_main_text,
    "op6_hmm_language_model": op6_hmm_language_model,
    "op7_bloom_url_filter": op7_bloom_url_filter,
    "op8_ecoc_language_id": op8_ecoc_language_id,
    "op9_mixture_packing": op9_mixture_packing,
    "op10_license_scan": op10_license_scan,
    "op11_line_dedup": op11_line_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL: dict[str, str] = {"op7_bloom_url_filter": op7_oracle(), "op10_license_scan": op10_oracle(), "op11_line_dedup": op11_oracle(), "op13_fill_in_middle": op13_oracle()}
