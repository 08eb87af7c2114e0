"""Queries of this subpackage and their SQL, for the driver's entry point."""

from __future__ import annotations

from almanac.llm import fim, html, langid, media, mixing, neargraph, negatives, pieces, pii, repeats, simhash, suffixtree, tokenids

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mixing": mixing.op2_mixing,
    "op3_media": media.op3_media,
    "op4_langid": langid.op4_langid,
    "op5_lm": suffixtree.op5_lm,
    "op6_embeddings": neargraph.op6_embeddings,
    "op7_pii": pii.op7_pii,
    "op8_html": html.op8_html,
    "op9_tokens": tokenids.op9_tokens,
    "op10_pieces": pieces.op10_pieces,
    "op11_repeats": repeats.op11_repeats,
    "op12_negatives": negatives.op12_negatives,
    "op13_fim": fim.op13_fim,
}

ORACLE_SQL = {
    "op2_mixing": mixing.ORACLE,
    "op11_repeats": repeats.ORACLE,
    "op12_negatives": negatives.ORACLE,
    "op13_fim": fim.ORACLE,
}
