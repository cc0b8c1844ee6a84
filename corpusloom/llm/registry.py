"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from corpusloom.llm import bpe, chat, exact_dedup, hard_negatives, hmm_lm, media, mixing, quality, repair, simhash, substring_dedup, token_counts, warc
from corpusloom.llm.common import table


def queries():
    return {
        "op1_mixing": lambda spark, sf: mixing.words_taken(table(spark, sf, "documents")),
        "op2_warc": warc.op2,
        "op3_media": media.op3,
        "op10_hmm_lm": hmm_lm.op10,
        "op4_substring_dedup": lambda spark, sf: substring_dedup.without_repeats(table(spark, sf, "documents")),
        "op5_bpe": lambda spark, sf: bpe.encode_documents(table(spark, sf, "documents"), ids=False),
        "op6_simhash": lambda spark, sf: simhash.near_duplicates(table(spark, sf, "documents")),
        "op7_exact_dedup": lambda spark, sf: exact_dedup.exact_dedup(table(spark, sf, "documents")),
        "op8_quality": quality.op8,
        "op11_repair": repair.op11,
        "op12_token_counts": token_counts.op12,
        "op13_hard_negatives": hard_negatives.op13,
        "op9_chat": lambda spark, sf: chat.chat_texts(table(spark, sf, "conversations")),
    }


def oracle_sql():
    return {"op1_mixing": mixing.OP1_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op9_chat": chat.OP9_SQL, "op11_repair": repair.OP11_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}
