"""A training-data pipeline over documents: language ID, line dedup, near-dedup, source mix, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideloom.llm.bag_minhash import near_deduped
from strideloom.llm.common import stage, table
from strideloom.llm.language_crf import UNKNOWN, fitted, label
from strideloom.llm.line_dedup import dedup_lines
from strideloom.llm.mixing import mixed_documents
from strideloom.llm.piece_codec import coded, default_model

#: Least mean probability of the likeliest language of each of a document's words.
LEAST_CERTAINTY = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in languages that the model knows: those without letters go, and those whose words' languages are uncertain (LEAST_CERTAINTY).

    A document in several languages stays if its words' languages are plain. Null text counts as without letters; repeated
    rows fare alike; an empty table gives no rows.
    """
    others = F.struct(*(c for c in docs.columns if c != "text")).alias("row")
    t = label(docs.select("text", others), fitted(docs)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("certainty") >= LEAST_CERTAINTY))
    return t.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id has, with n_chars of the text that is left.

    Null texts become empty; nulls, ties, repeated rows and other columns as in ``dedup_lines``; an empty table gives no rows.
    """
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of least doc_id; rows that share that doc_id, and rows without one, all stay.

    Texts without words, null ones among them, are a class of their equals. An empty table gives no rows; other columns stay.
    """
    return near_deduped(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it does.

    Null and blank texts stay, once; a null source is a source of its own; repeated rows count one by one; an empty table gives no rows.
    """
    return mixed_documents(docs)


def piece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of their decoded text: doc_id, source, n_tokens, ids, decoded_sha256.

    Null text has no ids; repeated rows stay; an empty table gives no rows.
    """
    t = coded(docs.select("doc_id", "source", "text"), default_model())
    return t.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("piece_codec", piece_codec)]
#: A random field and a signature scheme are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
