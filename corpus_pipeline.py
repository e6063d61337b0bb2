"""A training corpus from raw documents: quality, lines, near copies, mix, ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``. n_chars
follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartermill.llm import line_dedup, mixing, quality_fm, sentencepiece_fst, similar_sets
from quartermill.llm.common import shared_dir, table

#: Words in a block of the mix, and blocks in one of its shards.
MIX_BLOCK, MIX_SLOTS = 1024, 256


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under its threshold go."""
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that a document with a smaller doc_id holds."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    SimHash tiles find pairs of fingerprints of five-word shingles, an exact way those out of
    their radius; similarity 0.8 at least is confirmed exactly for both.
    """
    return similar_sets.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; a row is what a slot of the mix takes of a document, in the order of shards and slots.

    Blocks of ``MIX_BLOCK`` words leave most documents whole.
    """
    return mixing.mix_documents(docs, mixing.Mix(docs, block=MIX_BLOCK, shard_slots=MIX_SLOTS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the check that they decode to it."""
    return sentencepiece_fst.encode_documents(docs).select("doc_id", "lang", "source", "n_chars", F.size("ids").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("mix_sources", mix),
    ("sentencepiece", encode),
]

#: The stages rest on a trained model and pseudorandom draws, which SQL can't state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
