"""The queries of this subpackage, by name: (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

from folio.llm import chat, decontam, fim, jaccard, langid, mixing, pq, sharding, suffixes, tokens, topk, toxicity, warczip


def queries():
    return {
        "op1_topk": topk.op1_topk,
        "op2_mixing": mixing.op2_mixing,
        "op9_chat": chat.op9_chat,
        "op3_tokens": tokens.op3_tokens,
        "op8_langid": langid.op8_langid,
        "op10_toxicity": toxicity.op10_toxicity,
        "op4_suffixes": suffixes.op4_suffixes,
        "op5_jaccard": jaccard.op5_jaccard,
        "op6_decontaminate": decontam.op6_decontaminate,
        "op7_sharding": lambda spark, d: sharding.op7_sharding(spark.read.parquet(f"{d}/documents.parquet")),
        "op11_codes": pq.op11_codes,
        "op12_warc": warczip.op12_warc,
        "op13_fim": fim.op13_fim,
    }


def oracle_sql():
    return {"op1_topk": topk.OP1_SQL, "op9_chat": chat.OP9_SQL, "op11_codes": pq.OP11_SQL, "op12_warc": warczip.OP12_SQL, "op13_fim": fim.OP13_SQL}
