"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from dossier.llm import alignment, chat, credentials, embedding_dedup, minhash, mixing, repair, topk, url_rules, warc
from dossier.llm.langid import op6_language_id
from dossier.llm.packing import op8_packing
from dossier.llm.toxicity import op5_toxicity

QUERIES = (embedding_dedup.op1_embedding_near_dedup, chat.op2_chat_format, warc.op3_warc, topk.op4_top_k, op5_toxicity, op6_language_id, minhash.op7_minhash_near_dedup, op8_packing, mixing.op9_mixing, url_rules.op10_url_rules, repair.op11_conversation_repair, credentials.op12_secret_scan, alignment.op13_tokenizer_alignment)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": embedding_dedup.ORACLE, "op2_chat_format": chat.ORACLE, "op3_warc": warc.ORACLE, "op4_top_k": topk.ORACLE, "op7_minhash_near_dedup": minhash.ORACLE, "op9_mixing": mixing.ORACLE, "op10_url_rules": url_rules.ORACLE, "op11_conversation_repair": repair.ORACLE, "op12_secret_scan": credentials.ORACLE}
