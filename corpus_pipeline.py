"""The corpus pipeline: documents in, the places of their tokens in packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on everything that the stage before has kept, and is written
and read again before the next. A stage changes no document but where it says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm import decontamination, jaccard_join, packing, quality, secrets
from firnline.llm.scratch import settle, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled ones outside its held-out fold.

    Null and empty texts are judged as empty ones; rows without doc_id and repeated rows each by their own text; without labels all stay
    or none, by the share of label 1. An empty table stays empty; further columns stay.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicate links the document with the least id.

    Null and empty texts are linked with nothing and stay, and so do rows without doc_id; rows that repeat entirely
    are one document and stay as they are. An empty table stays empty; further columns stay.
    """
    return jaccard_join.representatives(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark.

    Null and empty texts share none; repeated rows and rows without doc_id are judged each. Without items all stay. Further columns stay.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts; n_chars follows the text.

    A null text stays null, with a null n_chars; repeated rows and rows without doc_id are masked each. An empty table stays empty; further columns stay.
    """
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences. A null or empty text is one piece, its end; repeated rows are packed each. Further columns are dropped."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_alike),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]
#: The classifier and the packer can't be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, f"stage{i}")
    return docs
