"""Batches of rows of about the same length, as a collator pads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.arrays import attention_mask, pad
from pairforge.operators.ranking import with_key_rank

MULTIPLE = 8


def padded_width(ids: Column, multiple: int = MULTIPLE) -> Column:
    """Length of an array rounded up to a multiple, at least one multiple; null counts as empty."""
    n = F.coalesce(F.size(ids), F.lit(0))
    return F.greatest(F.lit(multiple), n + F.pmod(-n, F.lit(multiple))).cast("long")


def padded_batches(
    df: DataFrame,
    ids: str,
    key: str,
    budget: int,
    pad_id: int,
    multiple: int = MULTIPLE,
) -> DataFrame:
    """``batch_id``, ``pos``, ``width``, and ``ids`` padded to the width with ``attention_mask``.

    Rows are ordered by padded width and unique ``key``. A batch holds rows of one width, as
    many as ``budget`` ids have room for and one at least, so padding is below ``multiple``
    for every row. Ranks come from a range-partitioned sort and prefix sums over its
    partitions; a width of any number of rows is spread over tasks. Null arrays count as
    empty ones. The table of widths has a row for each multiple up to the longest array.
    """
    if budget < 1 or multiple < 1:
        raise ValueError("the budget and the multiple must be positive")
    wide = df.withColumn("width", padded_width(F.col(ids), multiple))
    ranked = with_key_rank(wide.withColumn("_order", F.struct("width", key)), "_order", "_rank")
    widths = wide.groupBy("width").agg(F.count(F.lit(1)).alias("_n"))
    room = F.greatest(F.lit(1).cast("long"), F.expr(f"{int(budget)}L div width"))
    before = Window.orderBy("width").rowsBetween(Window.unboundedPreceding, -1)
    batches = F.ceil(F.col("_n") / F.col("_room"))
    starts = widths.withColumn("_room", room).select(
        "width",
        "_room",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum(batches).over(before), F.lit(0)).alias("_batches"),
    )
    place = F.col("_rank") - F.col("_rows")
    own = F.coalesce(F.col(ids), F.array().cast(df.schema[ids].dataType))
    rest = [F.col(c) for c in df.columns if c != ids]
    return ranked.join(F.broadcast(starts), "width").select(
        *rest,
        F.expr("_batches + (_rank - _rows) div _room").alias("batch_id"),
        (place % F.col("_room")).alias("pos"),
        "width",
        pad(own, F.col("width").cast("int"), pad_id).alias(ids),
        attention_mask(own, F.col("width").cast("int")).alias("attention_mask"),
    )


def padding_share(batches: DataFrame, mask: str = "attention_mask") -> DataFrame:
    """Ids, and the share of them that is padding, over all batches."""
    real = F.aggregate(mask, F.lit(0), lambda total, m: total + m)
    total, own = F.sum(F.size(mask)), F.sum(real)
    return batches.agg(total.alias("n_ids"), F.try_divide(total - own, total).alias("padding"))
