"""Raw pairs to a clean, scored and pruned corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.compute import compute_once
from pairforge.functions.text import clean_pairs_a
from pairforge.functions.tokens import Tokenizer, with_word_counts, word_tokens
from pairforge.functions.vectors import unit_cosine
from pairforge.operators.align import attach_vectors
from pairforge.operators.counts import Counts
from pairforge.operators.inference import embed
from pairforge.operators.prune import above_similarity, drop_identical, prune_length_ratio
from pairforge.runtime import write_whole
from pairforge.sources.readers import read_jsonl
from pairforge.sources.writers import write_jsonl

Scorer = Callable[[DataFrame], DataFrame]


def clean_and_prune(
    df: DataFrame,
    prune_threshold: float = 0.5,
    tokenizer: Tokenizer = word_tokens,
    counts: Counts | None = None,
) -> DataFrame:
    """The cheap part: clean, count words, prune by length ratio and identity.

    The identity test needs no counts, so it runs on cleaned text before any
    tokenising; the two filters commute. ``counts`` gets the rows ``in`` and those left
    by each filter.
    """
    at = counts.at if counts else lambda _, df: df
    df = at("not_identical", drop_identical(clean_pairs_a(at("in", df))))
    return at("length_ratio", prune_length_ratio(with_word_counts(df, tokenizer), prune_threshold))


def score_with_vectors(df: DataFrame, vectors: DataFrame, **ids: str) -> DataFrame:
    """``sem_sim`` from stored sentence vectors."""
    joined = attach_vectors(df, vectors, **ids)
    score = unit_cosine(F.col("source_vec"), F.col("target_vec"))
    return compute_once(joined, {"sem_sim": score}).drop("source_vec", "target_vec")


def score_with_model(
    df: DataFrame, load: Callable[[], Callable[[list[str]], list]], batch_size: int = 64
) -> DataFrame:
    """``sem_sim`` from a user's embedding model, a function of a list of texts."""

    embedded = embed(df, {"_source": "source", "_target": "target"}, load, "array<float>", 2 * batch_size)
    score = unit_cosine(F.col("_source"), F.col("_target"))
    return compute_once(embedded, {"sem_sim": score}).drop("_source", "_target")


def filter_pairs(
    df: DataFrame,
    score: Scorer,
    prune_threshold: float = 0.5,
    semantic_threshold: float = 0.8,
    tokenizer: Tokenizer = word_tokens,
    counts: Counts | None = None,
) -> DataFrame:
    """Everything: ``score`` adds ``sem_sim`` and only sees pairs that passed the cheap filters.

    With ``counts``, the rows that come to each step are counted in the same pass: those
    that ``scored`` lacks of ``length_ratio`` had no vector.
    """
    at = counts.at if counts else lambda _, df: df
    scored = at("scored", score(clean_and_prune(df, prune_threshold, tokenizer, counts)))
    return at("out", above_similarity(scored, semantic_threshold))


def run(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    load: Callable[[], Callable[[list[str]], list]],
    prune_threshold: float = 0.5,
    semantic_threshold: float = 0.8,
) -> dict[str, int]:
    """Write the pairs that pass, and return how many rows came to each step.

    Nothing is done, and nothing returned, when the output is finished already.
    """
    counts = Counts()
    pairs = filter_pairs(
        read_jsonl(spark, input_path),
        lambda df: score_with_model(df, load),
        prune_threshold,
        semantic_threshold,
        counts=counts,
    )
    return counts.result() if write_whole(pairs, output_path, write_jsonl) else {}
