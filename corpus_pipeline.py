"""From raw documents to token ids: language, near-duplicates, benchmark passages, encoding.

Each stage gets what the stage before it kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurevote.llm import bpe, decontam, langid, neardup
from featurevote.llm.common import text_key, written
from featurevote.llm.queries import BYTE_BPE, PIECES

MIN_LANGUAGE_SCORE = 0.4


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents under a key that is never missing: the id, smallest first and missing ones last, and
    the text's hash, which tells documents with one id apart."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", text_key("text").alias("text_key"))
    return docs.withColumn("_key", key)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose language is recognised; the models learn from the labels of
    all documents of the stage. Documents that no model favours, or without text, go."""
    model = langid.train(docs, public_tokenizers.path(PIECES))
    found = docs.withColumn("_found", langid.judgement(spark, F.col("text"), model))
    known = (F.col("_found.lang_pred") != "und") & (F.col("_found.score") >= MIN_LANGUAGE_SCORE)
    return found.where(known).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the smallest id."""
    keyed = _keyed(docs)
    found = neardup.near_duplicates(keyed, shingle_words=5, percent=80, id_col="_key")
    kept = found.where("kept").groupBy("_key").agg(F.count("*").alias("_copies"))
    joined = keyed.join(kept, "_key")
    alone = joined.where("_copies = 1").select(*docs.columns)
    repeated = joined.where("_copies > 1").dropDuplicates(["_key"]).select(*docs.columns)
    return alone.union(repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of ten words of a benchmark item occurs."""
    keyed = _keyed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontam.benchmark_hits(keyed, benchmark, id_col="_key")
    return keyed.join(hits.where("contaminated").select("_key"), "_key", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives its text again."""
    found = docs.withColumn("_found", bpe.tokens_of(F.col("text"), public_tokenizers.path(BYTE_BPE)))
    return found.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.size("_found.ids").cast("long").alias("n_tokens"),
        "_found.ids",
        "_found.round_trip",
    )


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

# Sketches, likelihoods and merges are not SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
