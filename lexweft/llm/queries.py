"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from . import chunks, decontaminate, html, media, mixing, neardup, quality, sharding, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1,
    "op2_quality": quality.op2,
    "op3_substring": chunks.op3,
    "op4_neardup": neardup.op4,
    "op5_decontaminate": decontaminate.op5,
    "op6_media": media.op6,
    "op7_toxicity": toxicity.op7,
    "op8_mixing": mixing.op8,
    "op9_html": html.op9,
    "op10_sharding": sharding.op10,
}

ORACLES = {
    "op1_warc": warc.ORACLE_OP1,
    "op4_neardup": neardup.ORACLE_OP4,
    "op5_decontaminate": decontaminate.ORACLE_OP5,
}
