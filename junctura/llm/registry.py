"""The queries of the training-data part and the SQL twins of those that SQL can express."""

from __future__ import annotations

from junctura.llm import ann, bpe, lexical, media, mixing, neardup, quality, sharding, tokenfile, toxicity, urls, warc, whitening
from junctura.session import shipping


def queries() -> dict:
    found = [sharding.op1_kd_shards, neardup.op2_near_duplicates, bpe.op3_bpe, urls.op4_url_filter, ann.op5_prefix_forest, toxicity.op6_toxicity, warc.op7_warc_derivatives, mixing.op8_mixing, quality.op9_quality_classifier, media.op10_media, lexical.op11_block_max, whitening.op12_whitening, tokenfile.op13_bit_planes]
    return {q.__name__: shipping(q) for q in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": neardup.reference_sql(), "op4_url_filter": urls.reference_sql(), "op7_warc_derivatives": warc.reference_sql(), "op8_mixing": mixing.reference_sql(), "op11_block_max": lexical.reference_sql()}
