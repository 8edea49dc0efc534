"""Length and similarity profiles of one or several corpora."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.tokens import Tokenizer, with_word_counts, word_tokens
from pairforge.operators.align import stack
from pairforge.operators.prune import keep_equal
from pairforge.operators.ranking import sample_n
from pairforge.operators.stats import length_histogram, profile, score_histogram
from pairforge.sources.writers import write_jsonl


def positive_pairs(
    df: DataFrame,
    source: str,
    target: str,
    label: str = "label",
    value: int = 1,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The positive class of a labelled pair table, as source and target."""
    return keep_equal(df, label, value).select(
        *keep, F.col(source).alias("source"), F.col(target).alias("target")
    )


def profile_corpora(
    corpora: Mapping[str, DataFrame],
    tokenizers: Mapping[str, Tokenizer] | None = None,
) -> DataFrame:
    """Mean word counts per corpus, one row each. A corpus may have its own tokenizer."""
    counted = {
        name: with_word_counts(df.select("source", "target"), (tokenizers or {}).get(name, word_tokens))
        .select("src_len", "tgt_len")
        for name, df in corpora.items()
    }
    return profile(stack(counted), by="corpus")


def histograms(
    df: DataFrame, sample: int | None = None, key: str = "pair_id"
) -> dict[str, DataFrame]:
    """Length histograms of both sides and, if scored, of ``sem_sim``; on a sample if asked.

    Needs ``src_len`` and ``tgt_len``.
    """
    df = sample_n(df, sample, key)
    tables = {name: length_histogram(df, name) for name in ("src_len", "tgt_len")}
    if "sem_sim" in df.columns:
        tables["sem_sim"] = score_histogram(df, "sem_sim")
    return tables


def run(
    spark: SparkSession,
    corpora: Mapping[str, DataFrame],
    output_path: str,
    sample: int | None = None,
    key: str = "pair_id",
    tokenizers: Mapping[str, Tokenizer] | None = None,
) -> None:
    """Write the profile of several corpora: ``means``, ``lengths`` and ``scores`` as JSON lines.

    Every bin is written. ``sample`` cuts each corpus first; counts that a corpus
    brings along are kept, otherwise words are counted.
    """
    counted = {}
    for name, df in corpora.items():
        df = sample_n(df, sample, key)
        if not {"src_len", "tgt_len"} <= set(df.columns):
            df = with_word_counts(df, (tokenizers or {}).get(name, word_tokens))
        counted[name] = df
    lengths, scores = [], []
    for name, df in counted.items():
        for measure, table in histograms(df).items():
            named = table.select(F.lit(name).alias("corpus"), F.lit(measure).alias("measure"), "*")
            (scores if measure == "sem_sim" else lengths).append(named)
    means = profile(stack({n: df.select("src_len", "tgt_len") for n, df in counted.items()}), by="corpus")
    write_jsonl(means, f"{output_path}/means")
    for part, tables in (("lengths", lengths), ("scores", scores)):
        if tables:
            write_jsonl(reduce(DataFrame.unionByName, tables), f"{output_path}/{part}")
