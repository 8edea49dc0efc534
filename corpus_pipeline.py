"""From raw documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a
DataFrame; ``run`` writes every result as Parquet in the shared folder and reads it
back for the next stage. All stages but the last return the columns of ``documents``.

Rows that share an id share their fate in the stages that decide by id: an id with
several texts goes when one of them is contaminated, and stays when one of them is
kept; the same id with the same text stays once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import decontaminate, minhash, pii, toxicity
from pairforge.llm.common import ship, table
from pairforge.llm.queries import packed_pieces
from pairforge.runtime import durable


BATCH_ROWS = 1000
CACHED_WORDS = 200_000  # in a worker that other stages use as well


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches for texts of a few thousand bytes: each lies in memory on both sides of a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(BATCH_ROWS, int(spark.conf.get(key)))))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the lexicon scores below one half; null and empty texts stay."""
    _small_batches(spark)
    labels = toxicity.learned_from(table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep_below=0.5)
    return scored.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    _small_batches(spark)
    ship(spark)
    kept = (
        minhash.near_copies(docs)
        .filter("kept")
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumnRenamed("doc_id", "_kept_id")
    )
    stay = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]))
    once = stay.filter("_copies = 1").select(*docs.columns)
    again = stay.filter("_copies > 1").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in twenty lie in benchmark windows."""
    _small_batches(spark)
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    gone = found.filter(decontaminate.contaminated()).select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind."""
    _small_batches(spark)
    ship(spark)
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of power-of-two lengths, each a sequence, with a digest of its ids."""
    _small_batches(spark)
    ship(spark)
    return packed_pieces(docs, CACHED_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

# A learned lexicon, a trained tagger and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
