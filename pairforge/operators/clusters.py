"""From sentence clusters to pairs and arrays, safe for clusters of any size.

A cluster can hold a large share of the table, so no operator hands a whole cluster
to one task. What a cluster gives does not depend on how it is cut: members have one
order, pieces are ranges of that order, and ranks run on from piece to piece.

A task gets about ``HOT_ROWS`` rows of a cluster, or one ``PARTS``-th of the table if
that is more. Fewer than ``PARTS`` clusters can be above one ``PARTS``-th of the rows,
which bounds the tables of hot clusters and of their pieces that are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.operators.ranking import SEED, shuffle_hash
from pairforge.runtime import durable

PARTS = 65_536
HOT_ROWS = 100_000  # clusters up to this size are one piece
PART_ROWS = 10_000  # members per array

_HASH_SPACE = 16**8  # values of the leading hash digits that place a row in a piece


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS, parts: int = PARTS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and more than 1/``parts`` of all rows,
    and the number of ``buckets`` to cut each into.

    Fewer than ``parts`` rows come back, whatever the input is.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    limit = F.greatest(F.lit(hot_rows), df.agg(F.count(F.lit(1))).scalar() / parts)
    return counts.filter(F.col("n") > limit).select(
        key, F.ceil(F.col("n") / limit).cast("int").alias("buckets")
    )


def _hot(df: DataFrame, cluster: str, hot_rows: int) -> DataFrame:
    return hot_keys(df, cluster, hot_rows).select(
        F.col(cluster).alias("_hot"), F.col("buckets").alias("_n"), F.lit(True).alias("_cut")
    )


def _in_pieces(df: DataFrame, cluster: str, hash_: Column, hot_rows: int) -> DataFrame:
    """Adds ``_hash``, ``_bucket`` (a range of hashes) and ``_before``, the rows of the
    cluster in the buckets before it."""
    hot = _hot(df, cluster, hot_rows)
    place = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")

    def bucketed(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("_hash", hash_)
            .join(F.broadcast(hot), F.col(cluster).eqNullSafe(F.col("_hot")), "left")
            .withColumn("_bucket", F.coalesce(F.floor(place * F.col("_n") / _HASH_SPACE), F.lit(0)))
        )

    upto = Window.partitionBy("_of").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed(df)
        .filter("_cut")
        .groupBy(F.col(cluster).alias("_of"), F.col("_bucket").alias("_piece"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(upto))
        .drop("_rows")
    )
    same = F.col(cluster).eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_piece"))
    return (
        bucketed(df)
        .join(F.broadcast(offsets), same, "left")
        .withColumn("_before", F.coalesce("_before", F.lit(0)))
        .drop("_hot", "_n", "_cut", "_of", "_piece")
    )


def pair_neighbours(
    df: DataFrame,
    cluster: str = "paraphrase_set_id",
    text: str = "paraphrase",
    key: str = "sentence_id",
    seed: int = SEED,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Shuffle each cluster and pair members 1-2, 3-4, ...; an odd one out is dropped.

    The order is that of a seeded hash of the key, so the pairs are the same for any
    ``hot_rows`` and a cluster of k gives exactly k // 2 of them. A pair whose two
    members lie in neighbouring pieces is put together from the ends of the pieces,
    which are two rows a piece at most.
    """
    row = F.struct(F.col(key).alias("key"), F.col(text).alias("text"))
    pieces = _in_pieces(df, cluster, shuffle_hash(key, seed), hot_rows).select(
        cluster, "_bucket", "_before", "_hash", row.alias("_row")
    )
    order = Window.partitionBy(cluster, "_bucket").orderBy("_hash", "_row")
    ranked = pieces.select(
        cluster,
        "_row",
        (F.col("_before") + F.row_number().over(order)).alias("_rank"),
        F.lead("_row").over(order).alias("_next"),
        F.row_number().over(order).alias("_place"),
    )
    odd = F.col("_rank") % 2 == 1
    found = ranked.filter(odd & F.col("_next").isNotNull()).select(cluster, "_row", "_next")
    # Left over: an odd rank at the end of a piece, an even one at the start of a piece.
    loose = ranked.filter(F.when(odd, F.col("_next").isNull()).otherwise(F.col("_place") == 1))
    across = Window.partitionBy(cluster).orderBy("_rank")
    stitched = (
        loose.select(cluster, "_row", "_rank", F.lead("_row").over(across).alias("_next"))
        .filter(odd & F.col("_next").isNotNull())
        .select(cluster, "_row", "_next")
    )
    return found.unionByName(stitched).select(
        cluster,
        F.col("_row.key").alias("source_id"),
        F.col("_next.key").alias("target_id"),
        F.col("_row.text").alias("source"),
        F.col("_next.text").alias("target"),
    )


def _ranked_by_key(df: DataFrame, cluster: str, key: str, hot_rows: int) -> DataFrame:
    """Adds ``_rank``, 0-based in key order within the cluster.

    Hot clusters are range-partitioned by (cluster, key), which cuts them wherever a
    partition is full, and frozen; each partition then knows how many rows of the
    cluster lie before it.
    """
    hot = _hot(df, cluster, hot_rows)
    marked = df.join(F.broadcast(hot), F.col(cluster).eqNullSafe(F.col("_hot")), "left").drop("_hot", "_n")
    whole = marked.filter("_cut IS NULL").drop("_cut").withColumn(
        "_rank", F.row_number().over(Window.partitionBy(cluster).orderBy(key)) - 1
    )
    if hot.isEmpty():
        return whole
    cut = durable(
        marked.filter("_cut")
        .drop("_cut")
        .repartitionByRange(cluster, key)
        .sortWithinPartitions(cluster, key)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id()),
        "clusters",
    )
    upto = Window.partitionBy("_of").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition and hot cluster in it: both are few.
    starts = (
        cut.groupBy(F.col(cluster).alias("_of"), F.col("_part").alias("_p"))
        .agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(upto), F.lit(0)))
    )
    same = F.col(cluster).eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_p"))
    ranked = (
        cut.join(F.broadcast(starts), same)
        .withColumn("_rank", F.col("_before") + F.col("_seq") - F.col("_first"))
        .select(*whole.columns)
    )
    return whole.unionByName(ranked)


def collect_clusters(
    df: DataFrame,
    cluster: str = "paraphrase_set_id",
    text: str = "paraphrase",
    key: str = "sentence_id",
    hot_rows: int = HOT_ROWS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Members of each cluster as arrays of (key, text) in key order, with ``n``.

    Part p holds the members with ranks p * ``part_rows`` and on, in key order, at any
    size of the cluster and for any ``hot_rows``; one array cannot hold an unbounded
    cluster, so one of more than ``part_rows`` members takes several rows.
    """
    ranked = _ranked_by_key(df.select(cluster, key, text), cluster, key, hot_rows)
    member = F.struct(F.col(key).alias("key"), F.col(text).alias("text"))
    return (
        ranked.withColumn("part", F.floor(F.col("_rank") / part_rows))
        .groupBy(cluster, "part")
        .agg(F.sort_array(F.collect_list(member)).alias("members"))
        .select(cluster, "part", F.size("members").alias("n"), "members")
    )
