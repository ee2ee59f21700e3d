"""Queries of the corpus operators over the whole tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import clustered_search, collocations, decontamination, discriminant, language_id, line_dedup, ngram_join, piece_codec, quality, sentence_spans, shards, sql, tag_paths, token_counts
from .common import table


def op1_tag_path_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return tag_paths.extract(table(spark, sf_dir, "pages"))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the encoded and decoded text of every document."""
    return piece_codec.digest_texts(table(spark, sf_dir, "documents"))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that lie in a repeated span."""
    return sentence_spans.dedup_spans(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, and whether they pass 1024."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier line, or nearly."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies of every document."""
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rules and the verdict of the outlier test."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labels outside the held-out fold."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, equal texts together."""
    return shards.shard_by_bytes(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that every document holds."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels outside the held-out fold."""
    return discriminant.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_clustered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return clustered_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 highest-scoring phrases of each language of all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_tag_path_extraction, op2_piece_codec, op3_sentence_spans, op4_token_counts, op5_line_dedup, op6_ngram_jaccard_join, op7_robust_outliers, op8_language_id, op9_lpt_shards, op10_decontamination, op11_quadratic_discriminant, op12_clustered_search, op13_phrase_collocations)
}
ORACLE_SQL: dict[str, str] = {"op12_clustered_search": sql.RANKED_SEARCH, "op13_phrase_collocations": sql.COLLOCATIONS}
