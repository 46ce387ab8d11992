"""The queries of this subpackage, each over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumaria.llm import bpe, chat, decontam, gru, idfile, jaccard, lines, pii, quality, substrings
from plumaria.llm.common import table


def op1_chat_windows(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema)
    return chat.digests(chat.chat_windows(turns.unionByName(extra)))


def op2_gru_lm(spark, sf_dir):
    return gru.lm_scores(table(spark, sf_dir, "documents"))


def op3_pii_anchors(spark, sf_dir):
    return pii.digests(pii.pii_spans(table(spark, sf_dir, "documents")))


def op4_quality_forest(spark, sf_dir):
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_chunks(spark, sf_dir):
    docs = lines.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True, runs=True)
    return docs.select("doc_id", "n_lines", "n_chunks", "n_dropped", "dropped_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_compact_windows(spark, sf_dir):
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op8_bpe_merge_rounds(spark, sf_dir):
    return bpe.bpe_digests(table(spark, sf_dir, "documents"))


def op9_range_coder(spark, sf_dir):
    return idfile.read_ids(spark, idfile.write_ids(table(spark, sf_dir, "documents")))


def op10_chosen_path(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


QUERIES = {f.__name__: f for f in (op1_chat_windows, op2_gru_lm, op3_pii_anchors, op4_quality_forest, op5_decontaminate, op6_line_chunks, op7_compact_windows, op8_bpe_merge_rounds, op9_range_coder, op10_chosen_path)}
ORACLE_SQL = {"op1_chat_windows": chat.ORACLE_SQL}
