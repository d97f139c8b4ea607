"""The numbered operators as queries of (spark, sf_dir), and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm.bpe import op8_pair_index_bpe
from tidemark.llm.chat import op11_template_compiler
from tidemark.llm.decontaminate import op6_prefix_decontaminate
from tidemark.llm.html import op10_tag_path_html
from tidemark.llm.idfiles import op4_ranked_id_files
from tidemark.llm.jaccard import op9_token_group_jaccard
from tidemark.llm.oracles import CONVERSATIONS, DECONTAMINATION, JACCARD, PHRASES, REPEATS, SPELLING
from tidemark.llm.phrases import op12_phrase_collocations
from tidemark.llm.quality import op5_risk_controlled_quality
from tidemark.llm.repeats import op2_automata_repeats
from tidemark.llm.shared import bounded
from tidemark.llm.sharding import op3_hypergeometric_shards
from tidemark.llm.spelling import op13_spelling_variants
from tidemark.llm.toxicity import op1_boosted_toxicity
from tidemark.llm.urls import op7_markov_url_filter

_RAW = {
    "op1_boosted_toxicity": op1_boosted_toxicity,
    "op2_automata_repeats": op2_automata_repeats,
    "op3_hypergeometric_shards": op3_hypergeometric_shards,
    "op4_ranked_id_files": op4_ranked_id_files,
    "op5_risk_controlled_quality": op5_risk_controlled_quality,
    "op6_prefix_decontaminate": op6_prefix_decontaminate,
    "op7_markov_url_filter": op7_markov_url_filter,
    "op8_pair_index_bpe": op8_pair_index_bpe,
    "op9_token_group_jaccard": op9_token_group_jaccard,
    "op10_tag_path_html": op10_tag_path_html,
    "op11_template_compiler": op11_template_compiler,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_spelling_variants": op13_spelling_variants,
}
QUERIES = {name: bounded(f) for name, f in _RAW.items()}

ORACLES = {
    "op2_automata_repeats": REPEATS,
    "op6_prefix_decontaminate": DECONTAMINATION,
    "op9_token_group_jaccard": JACCARD,
    "op11_template_compiler": CONVERSATIONS,
    "op12_phrase_collocations": PHRASES,
    "op13_spelling_variants": SPELLING,
}
