"""Profiles, histograms, correlation and error as aggregate plans.

Each is one map-side-combined aggregation, plus at most one for the bounds.
Bounds arrive through scalar subqueries, never through a window over the table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.compute import compute_once
from pairforge.functions.arrays import count_tokens

BIN_BLOCK = 4096  # bins made at once


def profile(
    df: DataFrame, by: str | None = None, ignore: Iterable[str] = (), digits: int = 3
) -> DataFrame:
    """Mean of every numeric column, rounded half-even; per group when ``by`` is given."""
    skip = {by, *ignore}
    numeric = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
    means = [F.bround(F.avg(c), digits).alias(c) for c in numeric]
    return df.groupBy(by).agg(*means) if by else df.agg(*means)


def extremes(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def _bounds(df: DataFrame, column: str) -> Column:
    """Minimum, maximum and count of the non-null values, as one scalar."""
    values = df.agg(
        F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"))
    )
    return values.scalar()


def length_histogram(df: DataFrame, column: str) -> DataFrame:
    """Unit-width density histogram of an integer column.

    Edges run from the minimum to the maximum, so the last bin holds the two
    largest values. Empty bins are kept. One distinct value gives no bins.
    """
    bounds = _bounds(df, column)
    top = bounds["hi"] - 1
    counts = (
        df.filter(F.col(column).isNotNull())
        .select(F.least(F.col(column), top).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # When all values are equal the sequence would count down: no bins instead. Bins are
    # made in blocks, so that no array is as long as the widest range of values.
    step = F.lit(BIN_BLOCK)
    blocks = F.when(top >= bounds["lo"], F.sequence(bounds["lo"], F.greatest(top, bounds["lo"]), step))
    block = df.sparkSession.range(1).select(F.explode(blocks).alias("block"), top.alias("top"))
    bins = block.select(
        F.explode(F.sequence("block", F.least(F.col("block") + step - 1, F.col("top")))).alias("bin")
    )
    n = F.coalesce("n", F.lit(0))
    return bins.join(counts, "bin", "left").select(
        "bin", (F.col("bin") + 1).alias("hi"), n.alias("n"), (n / bounds["n"]).alias("density")
    )


def score_histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Equal-width histogram with bin edges, centres and proportions; empty bins are kept.

    The index is computed by division and then checked against the edges, so a
    value on an edge goes to the bin it opens, and the maximum to the last bin.
    """
    bounds = {"bounds": _bounds(df, column)}
    low, high = F.col("bounds.lo").cast("double"), F.col("bounds.hi").cast("double")
    flat = low == high
    limits = {
        "lo": F.when(flat, low - 0.5).otherwise(low),
        "hi": F.when(flat, high + 0.5).otherwise(high),
        "rows": F.col("bounds.n"),
    }
    lo, hi = F.col("lo"), F.col("hi")

    def edge(i: Column) -> Column:
        return F.when(i == bins, hi).otherwise(lo + i * ((hi - lo) / bins))

    value, guess = F.col("value"), F.col("guess")
    shift = (
        F.when(value < edge(guess), -1)
        .when((value >= edge(guess + 1)) & (guess < bins - 1), 1)
        .otherwise(0)
    )
    values = df.select(F.col(column).cast("double").alias("value")).filter("value is not null")
    counts = (
        compute_once(values, bounds)
        .withColumns(limits)
        .withColumn("guess", F.least(F.floor((value - lo) * bins / (hi - lo)), F.lit(bins - 1)))
        .select((guess + shift).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bin_, n = F.col("bin"), F.coalesce("n", F.lit(0))
    return (
        compute_once(df.sparkSession.range(bins).withColumnRenamed("id", "bin"), bounds)
        .withColumns(limits)
        .join(counts, "bin", "left")
        .select(
            "bin",
            edge(bin_).alias("lo"),
            edge(bin_ + 1).alias("hi"),
            ((edge(bin_) + edge(bin_ + 1)) * 0.5).alias("centre"),
            n.alias("n"),
            F.try_divide(n, F.col("rows")).alias("proportion"),
        )
    )


def min_max_normalise(df: DataFrame, column: str, name: str = "normalised") -> DataFrame:
    """Score moved to 0..1 over the table; null when all scores are equal."""
    bounds = _bounds(df, column)
    return df.withColumn(
        name, F.try_divide(F.col(column) - bounds["lo"], bounds["hi"] - bounds["lo"])
    )


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation; null for a constant side or a single row, where corr would fail."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def mean_squared_error(x: Column, y: Column) -> Column:
    return F.avg((x - y) * (x - y))


def mean_length(df: DataFrame, ids: str, pad_id: int) -> DataFrame:
    """One row: mean number of non-padding ids, rounded to 4."""
    return df.agg(F.bround(F.avg(count_tokens(F.col(ids), pad_id)), 4).alias("gen_len"))
