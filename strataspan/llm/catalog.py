"""Queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from strataspan.llm import decontaminate, exact_dedup, language_id, line_dedup, merkle, minhash, packing, quality, spelling, spotsigs, suffix_dedup, toxicity, warc

QUERIES = {
    "op4_spotsigs": spotsigs.op4_spotsigs,
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op5_minhash": minhash.op5_minhash,
    "op9_language_id": language_id.op9_language_id,
    "op6_quality": quality.op6_quality,
    "op10_toxicity": toxicity.op10_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_warc": warc.op8_warc,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op11_merkle": merkle.op11_merkle,
    "op12_spelling": spelling.op12_spelling,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
    "spot_classes": spotsigs.spot_classes,
}
ORACLES = {
    "op4_spotsigs": spotsigs.OP4_SQL,
    "op8_warc": warc.OP8_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_exact_dedup": exact_dedup.OP13_SQL,
}
