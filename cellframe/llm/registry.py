"""The registered queries of this subpackage."""

from __future__ import annotations

from . import bpe, chat, decontaminate, license, minhash, nearest, tokenids, toxicity, urlfilter, warc


def queries() -> dict:
    return {
        "op1_chat_collapse": chat.op1_query,
        "op2_toxicity": toxicity.op2_query,
        "op3_token_files": tokenids.op3_query,
        "op4_byte_bpe": bpe.op4_query,
        "op5_minhash_dedup": minhash.op5_query,
        "op6_decontaminate": decontaminate.op6_query,
        "op7_url_filter": urlfilter.op7_query,
        "op8_additive_ann": nearest.op8_query,
        "op9_license_scan": license.op9_query,
        "op10_arc_to_warc": warc.op10_query,
    }


def oracle_sql() -> dict:
    """op2, op7 and op9 rest on trained or corpus-wide choices, op3, op4 and op8 on coders and codes: tests hold those."""
    return {"op1_chat_collapse": chat.OP1_SQL, "op5_minhash_dedup": minhash.OP5_SQL, "op6_decontaminate": decontaminate.OP6_SQL,
            "op10_arc_to_warc": warc.OP10_SQL}
