"""Each operator bound to the shared tables with production parameters."""

from __future__ import annotations

from . import collocations, conversations, decontaminate, exact_dedup, html_text, line_dedup, near_dup, packing, private, suffix_dedup, topk, toxicity, warc

QUERIES = {
    "op1_cover_tree_topk": topk.op1_query,
    "op2_html_text": html_text.op2_query,
    "op3_suffix_dedup": suffix_dedup.op3_query,
    "op4_decontaminate": decontaminate.op4_query,
    "op5_line_dedup": line_dedup.op5_query,
    "op6_toxicity": toxicity.op6_query,
    "op7_best_fit": packing.op7_query,
    "op8_private_data": private.op8_query,
    "op9_warc": warc.op9_query,
    "op10_near_dup": near_dup.op10_query,
    "op11_exact_dedup": exact_dedup.op11_query,
    "op12_collocations": collocations.op12_query,
    "op13_conversations": conversations.op13_query,
}

#: SQL of those that SQL can express.
ORACLES = {
    "op1_cover_tree_topk": topk.OP1_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_conversations": conversations.OP13_SQL,
}
