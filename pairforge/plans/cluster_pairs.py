"""A table of clustered sentences to pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairforge.operators.clusters import pair_neighbours
from pairforge.operators.prune import keep_equal
from pairforge.operators.ranking import SEED
from pairforge.sources.readers import read_named
from pairforge.sources.writers import write_jsonl


def cluster_pairs(clusters: DataFrame, language: str = "pt", seed: int = SEED) -> DataFrame:
    """Pairs within the clusters of one language. Unused columns are never read."""
    chosen = keep_equal(clusters, "language", language)
    return pair_neighbours(
        chosen.select("paraphrase_set_id", "sentence_id", "paraphrase"), seed=seed
    )


def run(spark: SparkSession, name: str, output_path: str, language: str = "pt") -> None:
    pairs = cluster_pairs(read_named(spark, name), language)
    write_jsonl(pairs.select("source", "target"), output_path)
