"""Queries of the text problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.runtime import read_table
from . import lookalike, mixing, pii, sentences, splitting, tokenizing
from .records import records


def _records(spark: SparkSession, d: str) -> DataFrame:
    return records(read_table(spark, d, "cues"), read_table(spark, d, "segments"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_spans(_records(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(_records(spark, d))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_forms(_records(spark, d)).distinct()


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_classes(_records(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.oversized_pieces(_records(spark, d), read_table(spark, d, "split_limits"))
    return pieces.where("piece = 1").select("record_kind", "media_id", "record_idx")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_pieces(_records(spark, d), read_table(spark, d, "split_limits"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizing.token_ids(read_table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_spans(read_table(spark, d, "documents"), read_table(spark, d, "contributors"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(read_table(spark, d, "documents"), read_table(spark, d, "contributors"))


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p4_forms, p4_classes, p5_found, p5_pieces, p6_ids, p7_mix, p7_shares, p8_found, p8_redacted)}

_RECORDS = """(SELECT 'cue' AS record_kind, media_id, cue_index AS record_idx, text FROM cues
 UNION ALL SELECT 'segment', media_id, seg_idx, text FROM segments)"""
ORACLES = {
    "p5_found": f"SELECT DISTINCT r.record_kind, r.media_id, r.record_idx FROM {_RECORDS} r JOIN split_limits l USING (record_kind) WHERE length(r.text) > l.max_chars",
}
