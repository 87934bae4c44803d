"""A training-data pipeline: each stage's result is written as Parquet and read by the next.

Toxic documents go; of each group of near copies one document stays; personal data and secrets are
replaced; sources are mixed to target weights (documents may repeat, and end where the budget
does); and the result is encoded. Every stage works on all that the one before kept.

Documents have doc_id, text, lang and source; the last stage needs these four, and returns doc_id, lang and
source with the ids. The stages before it pass all columns on, whatever their names.

Edge cases: null texts are not toxic, have no near copies and stay as they are; they have no words, so they end at the mixing stage,
as empty ones do. Texts of any length are read whole; the mix may end within one. Rows of a null doc_id have no
near copies. Of rows repeated with their id and text the mix takes each for itself; of equal texts with several ids one stays, that of the
smallest id, and ties elsewhere are settled by hashes of ids and texts. An empty table gives no rows.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import minhash, mixing, pii, sentencepiece_codec, toxicity
from quire.operators.lineage import discard, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = sentencepiece_codec.encode(docs, ["doc_id", "lang", "source"], with_decoded=False)
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "parity", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("personal data", redact),
    ("mixing", mix),
    ("encoding", encode),
]

#: SQL can't express the learned stages; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over documents. What a stage leaves is written to the cluster's shared folder, and discarded once the next is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
            if number:
                discard(spark, f"{folder}/{number - 1}")
    return docs
