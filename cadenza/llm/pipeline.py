"""The corpus pipeline: language ID, line dedup, near-duplicate documents, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All stages take tables with nulls in any column, empty and very long texts, repeated rows, no rows, and further columns of
any name; all but the last return the columns they were given. What a stage drops is said below; nothing else goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, line_dedup, ngram_join, piece_codec
from .common import carried, release, restored, stored, table

#: No SQL: language ID, random walks and encoding are not expressible; tests hold run() against brute force.
ORACLE_SQL = None
#: A document is rejected below this score, or where no language can be told.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; trained on the given documents' labels outside the held-out fold.

    Null texts and texts without letters go. Equal scores take the first language by name. Repeated rows stay.
    """
    return language_id.told(docs, LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line; n_chars, where there is one, follows the text.

    Every document stays, also one that lost all its lines. See ``line_dedup.dedup_lines`` for nulls, ties and repeats.
    """
    out = line_dedup.dedup_lines(docs)
    size = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    same = carried(out, text=F.col("text"))
    return restored(same, docs, size)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), the one of the smallest id.

    Rows that repeat both id and text are one document to this stage and stay or go together; null ids stay.
    """
    return ngram_join.one_of_each(docs, n=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows with a null id stay, as they cannot be told apart."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of the documents left; a null text is encoded as the empty one."""
    ids = piece_codec.encode_texts(docs)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("SentencePiece encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows of the documents under ``sf_dir``; tables between stages go once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
            if k:
                release(before)
    return docs
