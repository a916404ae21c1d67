"""The training-data pipeline: toxic documents go, one of each group of near duplicates stays, secrets are masked, sources are mixed, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelytics.llm import mixing, ngram_jaccard, pieces, queries, secrets, toxicity
from parcelytics.session import freeze

#: No SQL for the whole: the classifier and the tokens have none. The tests hold it against a plain form.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose score stays below the cut; the model learns from the labels of the documents that came in."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.toxicity(docs, labels).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of every class of near duplicates."""
    return ngram_jaccard.first_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars counted anew where something was."""
    found = secrets.scan(docs, out="__secrets")
    masked = found.withColumn("text", secrets.redact(F.col("text"), F.col("__secrets")))
    count = F.when(F.size("__secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", count).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, lang, source, ids (little-endian unsigned 32-bit integers), n_tokens, and whether decoding gives the text back."""
    done = pieces.encode_decode(docs, queries.piece_model_path())
    return done.select(
        "doc_id", "lang", "source", "ids", pieces.n_tokens().alias("n_tokens"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip")
    )


STAGES = [
    ("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix_sources), ("tokens", tokens),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder; each but the last is written to the checkpoint folder before the next."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        docs = freeze(docs) if k + 1 < len(STAGES) else docs
    return docs
