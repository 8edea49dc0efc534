"""Two line-aligned text files to translated pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators.align import drop_last, zip_lines
from pairforge.operators.inference import infer
from pairforge.operators.prune import min_words
from pairforge.operators.ranking import SEED, in_sample
from pairforge.runtime import finished, scratch, write_whole
from pairforge.sources.readers import read_stripped_lines
from pairforge.sources.writers import write_jsonl


def select_pairs(
    foreign: DataFrame,
    native: DataFrame,
    num_examples: int | None = None,
    trim_word_count: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Aligned lines as (line_no, source, target), sampled first and trimmed after.

    The last line of each side is noise. Sampling comes first, so trimming may
    leave fewer than ``num_examples`` rows. Words are counted on the native side.
    Line numbers run from 0 without gaps, so the lines both sides have are known
    without a join, and each side is thinned out before the only one there is.
    """
    foreign, native = drop_last(foreign), drop_last(native)
    if num_examples:
        end = native.agg(F.max("line_no")).scalar()
        chosen = in_sample(foreign.filter(F.col("line_no") <= end), num_examples, "line_no", seed)
        foreign, native = foreign.filter(chosen), native.filter(chosen)
    return min_words(zip_lines(foreign, native), "target", trim_word_count)


def translate(
    pairs: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], batch_size: int = 32
) -> DataFrame:
    """Replace the foreign source by its translation."""
    translated = infer(pairs, ["source"], "_translation", "string", load, batch_size)
    return translated.withColumn("source", F.col("_translation")).drop("_translation")


def run(
    spark: SparkSession,
    foreign_path: str,
    native_path: str,
    output_path: str,
    load: Callable[[], Callable[[list[str]], list[str]]],
    num_examples: int | None = None,
    trim_word_count: int | None = None,
) -> None:
    """Nothing is done when the output is finished already; one cut short is written anew."""
    if finished(spark, output_path):
        return
    with scratch(spark):
        pairs = select_pairs(
            read_stripped_lines(spark, foreign_path),
            read_stripped_lines(spark, native_path),
            num_examples,
            trim_word_count,
        )
        write_whole(translate(pairs, load).select("source", "target"), output_path, write_jsonl)
