"""Pairs to exact train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from pairforge.operators.ranking import SEED, split_80_10_10
from pairforge.runtime import finished, write_whole
from pairforge.sources.readers import read_jsonl, with_row_number
from pairforge.sources.writers import write_splits


def run(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    num_samples: int | None = 300_000,
    seed: int = SEED,
    schema: T.StructType | str | None = None,
) -> None:
    """Writes one folder per split, with all columns of the input.

    Nothing is done when the output is finished already; one cut short is written anew. Rows are keyed by their number in
    the input, so the splits are the same however the files are cut.
    """
    if finished(spark, output_path):
        return
    pairs = with_row_number(read_jsonl(spark, input_path, schema))
    split = split_80_10_10(pairs, num_samples, seed=seed, unique=True)
    write_whole(split.drop("pair_id"), output_path, write_splits)
