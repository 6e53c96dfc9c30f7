"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import chat, decontamination, html, lengths, lexical, licenses, pieces, quality, repair, simhash, topk, toxicity, warc

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_simhash": simhash.op2_simhash,
    "op3_html": html.op3_html,
    "op4_pieces": pieces.op4_pieces,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_licenses": licenses.op7_licenses,
    "op8_chat": chat.op8_chat,
    "op9_warc": warc.op9_warc,
    "op10_lengths": lengths.op10_lengths,
    "op11_lexical": lexical.op11_lexical,
    "op12_repair": repair.op12_repair,
    "op13_quality": quality.op13_quality,
}
SQL = {"op1_topk": topk.ORACLE_SQL, "op8_chat": chat.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL, "op11_lexical": lexical.ORACLE_SQL, "op12_repair": repair.ORACLE_SQL, "op13_quality": quality.ORACLE_SQL}
