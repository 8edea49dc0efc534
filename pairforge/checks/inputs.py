"""Adapters from the generated test tables to the shapes the operators take.

``Dirt`` is what the generated texts lack: the marks the cleaners act on, put
around every text by a rule both engines can follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.runtime import spread

# (before, after), chosen by (conv_id + turn) % 8 for sources and by the next one for targets.
DIRT = (
    (" (riso) ", ""),
    ("(riso) ", "\t "),
    ("[a) - ", " d’água"),
    ("“", "”"),
    ("‘‘a’’ ``b`` ", " ''c''"),
    ("--\t", "  　"),
    ('"', ""),
    ("- ", ' "" ‘x'),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right after it.

    A join on the unique (conversation, turn), so one long conversation is no hot key.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    answers = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target")
    )
    return asked.join(answers, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 2**32 + F.col("turn")).alias("pair_id"),
        "conv_id",
        "turn",
        "source",
        "target",
    )


def _dirty(text: str, shift: int) -> Column:
    case = (F.col("conv_id") + F.col("turn") + shift) % len(DIRT)

    def pick(side: int) -> Column:
        return F.get(F.array(*[F.lit(d[side]) for d in DIRT]), case.cast("int"))

    return F.concat(pick(0), F.col(text), pick(1))


def dirty_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_pairs(spark, sf_dir).withColumns(
        {"source": _dirty("source", 0), "target": _dirty("target", 1)}
    )


def predicted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation pairs with a prediction: the target without every fifth word."""
    words = F.split("target", " ")
    kept = F.filter(words, lambda _, i: (i + 1) % 5 != 0)
    return conversation_pairs(spark, sf_dir).withColumn("prediction", F.array_join(kept, " "))


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents 2k and 2k+1 as source and target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    even = docs.filter("doc_id % 2 = 0").select(
        F.col("doc_id").alias("source_id"), F.col("text").alias("source")
    )
    odd = docs.filter("doc_id % 2 = 1").select(
        (F.col("doc_id") - 1).alias("source_id"),
        F.col("doc_id").alias("target_id"),
        F.col("text").alias("target"),
    )
    return even.join(odd, "source_id").select("source_id", "target_id", "source", "target")


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors 2k and 2k+1 with a gold similarity: 5 when the labels agree, else 1."""
    vectors = table(spark, sf_dir, "embeddings")
    even = vectors.filter("vec_id % 2 = 0").select(
        F.col("vec_id").alias("pair_id"),
        F.col("embedding").alias("source_vec"),
        F.col("label").alias("_label"),
    )
    odd = vectors.filter("vec_id % 2 = 1").select(
        (F.col("vec_id") - 1).alias("pair_id"),
        F.col("embedding").alias("target_vec"),
        F.col("label").alias("_other"),
    )
    gold = F.when(F.col("_label") == F.col("_other"), 5.0).otherwise(1.0)
    return even.join(odd, "pair_id").select(
        "pair_id", "source_vec", "target_vec", gold.alias("similarity")
    )
