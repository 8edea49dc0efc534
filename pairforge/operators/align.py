"""Key joins that stand in for alignment by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_last(lines: DataFrame, key: str = "line_no") -> DataFrame:
    """All lines but the last one."""
    return lines.filter(F.col(key) < lines.agg(F.max(key)).scalar())


def zip_lines(source: DataFrame, target: DataFrame, key: str = "line_no") -> DataFrame:
    """Pair two line tables by line number; the longer one is cut to the shorter."""
    return source.select(key, F.col("text").alias("source")).join(
        target.select(key, F.col("text").alias("target")), key
    )


def attach_outputs(df: DataFrame, outputs: DataFrame, key: str = "pair_id") -> DataFrame:
    """Attach stored model outputs to their inputs."""
    return df.join(outputs, key)


def remainder(df: DataFrame, taken: DataFrame, key: str = "pair_id") -> DataFrame:
    """Rows whose key was not taken."""
    return df.join(taken.select(key), key, "left_anti")


def attach_vectors(
    pairs: DataFrame,
    vectors: DataFrame,
    source_id: str = "source_id",
    target_id: str = "target_id",
    vector_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Add ``source_vec`` and ``target_vec``; a pair with a missing vector is dropped.

    ``vector_id`` is unique, so no join multiplies rows. Which side is broadcast,
    and whether a hot sentence id is split, is left to adaptive execution, which
    knows the sizes.
    """

    def side(name: str, out: str) -> DataFrame:
        return vectors.select(F.col(vector_id).alias(name), F.col(vector).alias(out))

    return pairs.join(side(source_id, "source_vec"), source_id).join(
        side(target_id, "target_vec"), target_id
    )


def missing_vectors(
    pairs: DataFrame,
    vectors: DataFrame,
    source_id: str = "source_id",
    target_id: str = "target_id",
    vector_id: str = "vec_id",
) -> DataFrame:
    """Ids that ``attach_vectors`` would not find, with the pair sides that use them."""
    ids = pairs.select(
        F.explode(F.array(F.col(source_id), F.col(target_id))).alias(vector_id)
    )
    uses = ids.groupBy(vector_id).agg(F.count(F.lit(1)).alias("uses"))
    return uses.join(vectors.select(vector_id), vector_id, "left_anti")


def stack(corpora: dict[str, DataFrame]) -> DataFrame:
    """Several corpora in one table, told apart by ``corpus``."""
    named = [df.withColumn("corpus", F.lit(name)) for name, df in corpora.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out


def used_samples(df: DataFrame, limit: int | None) -> DataFrame:
    """One row: how many rows a cap of ``limit`` leaves."""
    n: Column = F.count(F.lit(1))
    return df.agg((F.least(F.lit(limit), n) if limit is not None else n).alias("samples"))
