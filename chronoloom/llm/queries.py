"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import ann, chat, embed_dedup, jaccard_join, licenses, line_dedup, mixing, toxicity
from .bpe import encode_documents
from .common import table
from .token_counts import prefix_token_counts


def op1_mixing(spark, sf_dir):
    return mixing.query(spark, sf_dir)


def op2_embedding_dedup(spark, sf_dir):
    return embed_dedup.query(spark, sf_dir)


def op3_license_scan(spark, sf_dir):
    return licenses.query(spark, sf_dir)


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op5_bpe(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"))


def op6_chat_format(spark, sf_dir):
    return chat.query(spark, sf_dir)


def op7_token_counts(spark, sf_dir):
    return prefix_token_counts(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark, sf_dir):
    return ann.query(spark, sf_dir)


def op9_toxicity(spark, sf_dir):
    return toxicity.query(spark, sf_dir)


def op10_line_dedup(spark, sf_dir):
    return line_dedup.query(spark, sf_dir)


def queries():
    named = [op1_mixing, op2_embedding_dedup, op3_license_scan, op4_jaccard_join, op5_bpe, op6_chat_format, op7_token_counts, op8_nearest_neighbours, op9_toxicity, op10_line_dedup]
    return {f.__name__: f for f in named}


def oracle_sql():
    return {
        "op1_mixing": mixing.ORACLE_SQL, "op2_embedding_dedup": embed_dedup.ORACLE_SQL, "op3_license_scan": licenses.ORACLE_SQL,
        "op4_jaccard_join": jaccard_join.ORACLE_SQL, "op6_chat_format": chat.ORACLE_SQL, "op10_line_dedup": line_dedup.ORACLE_SQL,
    }
