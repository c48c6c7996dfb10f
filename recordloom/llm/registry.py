"""Queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, chat, collocation, decontaminate, html_text, line_dedup, quality, sharding, simhash, spelling, top_k, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_html_text": html_text.op4_html_text,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_top_k": top_k.op6_top_k,
    "op7_warc": warc.op7_warc,
    "op8_chat": chat.op8_chat,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality": quality.op10_quality,
    "op11_collocations": collocation.op11_collocations,
    "op12_spelling": spelling.op12_spelling,
    "op13_sharding": sharding.op13_sharding,  # [native]: built-in functions alone
}

SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op6_top_k": top_k.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_chat": chat.OP8_SQL,
    "op11_collocations": collocation.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_sharding": sharding.OP13_SQL,
}
