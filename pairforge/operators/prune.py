"""Row filters over pair tables. All are narrow and stateless, so they also run on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.tokens import Tokenizer, word_count, word_tokens
from pairforge.operators.expressions import checked


def keep_equal(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def drop_identical(df: DataFrame) -> DataFrame:
    """Case-sensitive; a pair with a null side is dropped."""
    return df.filter(F.col("source") != F.col("target"))


def length_ratio(src_len: Column, tgt_len: Column) -> Column:
    """Length difference over the longer length; null when both are 0."""
    return F.try_divide(F.abs(src_len - tgt_len), F.greatest(src_len, tgt_len))


def prune_length_ratio(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Keep pairs strictly below the threshold. Needs src_len and tgt_len."""
    return df.filter(length_ratio(F.col("src_len"), F.col("tgt_len")) < threshold)


def above_similarity(
    df: DataFrame, threshold: float = 0.8, column: str = "sem_sim"
) -> DataFrame:
    """Keep pairs strictly above the threshold. NaN sorts highest in Spark, so it is excluded."""
    score = F.col(column)
    return df.filter((score > threshold) & ~F.isnan(score))


def min_words(
    df: DataFrame, column: str, threshold: int | None, tokenizer: Tokenizer = word_tokens
) -> DataFrame:
    """Keep rows with strictly more words than the threshold; 0 or None keeps all."""
    if not threshold:
        return df
    return df.filter(word_count(F.col(column), tokenizer) > threshold)


def filter_rows(df: DataFrame, predicate: str | None) -> DataFrame:
    """A user's SQL predicate, checked; Catalyst pushes it down like any other filter."""
    return df.filter(checked(df, predicate)) if predicate else df


def _unlabelled() -> Column:
    return F.col("entailment").isNull() & F.col("similarity").isNull()


def require_labels(df: DataFrame) -> DataFrame:
    """Fail the job at the first annotated pair that has neither label."""
    message = F.concat(
        F.lit("a pair carries no label at all, its id is "), F.coalesce(F.col("id"), F.lit("null"))
    )
    return df.filter(F.when(_unlabelled(), F.raise_error(message)).otherwise(F.lit(True)))


def split_by_labels(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The softer form: (pairs with a label, pairs with none)."""
    return df.filter(~_unlabelled()), df.filter(_unlabelled())
