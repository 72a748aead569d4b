"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import blockjoin, bpe, langid, mixing, pii, quality, secrets, sharding, simhash, warc

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_mcd_quality,
        secrets.op2_randomness_battery,
        blockjoin.op3_block_join,
        warc.op4_warc_revisits,
        bpe.op5_byte_bpe,
        simhash.op6_simhash,
        pii.op7_pii_disclosure,
        mixing.op8_soft_mixing,
        sharding.op9_sampled_splitters,
        langid.op10_cross_parsing,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_block_join": blockjoin.OP3_SQL, "op4_warc_revisits": warc.OP4_SQL}
