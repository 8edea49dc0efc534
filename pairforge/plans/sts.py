"""Score sentence vectors against annotated similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators.inference import infer
from pairforge.operators.metrics import evaluate
from pairforge.sources.readers import read_xml


def evaluate_sts(
    pairs: DataFrame, load: Callable[[], Callable[[list[str]], list]], batch_size: int = 64
) -> DataFrame:
    """One row (pearson, mse) for annotated pairs ``t``, ``h``, ``similarity``."""

    def load_pairs():
        embed = load()
        return lambda h, t: [list(v) for v in zip(embed(h), embed(t))]

    labelled = pairs.select("similarity", "t", "h")
    embedded = infer(labelled, ["h", "t"], "_vecs", "array<array<float>>", load_pairs, batch_size)
    vectors = embedded.select(
        "similarity",
        F.get("_vecs", F.lit(0)).alias("source_vec"),
        F.get("_vecs", F.lit(1)).alias("target_vec"),
    )
    return evaluate(vectors, "sts")


def run(
    spark: SparkSession, xml_path: str, load: Callable[[], Callable[[list[str]], list]]
) -> DataFrame:
    return evaluate_sts(read_xml(spark, xml_path, need_labels=False), load)
