"""The cleaning and pruning of pairs on an unbounded input.

Every step is stateless, so the batch functions are used as they are: no
watermark, no state store, and append output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pairforge.plans.filter_pairs import clean_and_prune
from pairforge.schema import KEYED_PAIRS


def read_pair_stream(
    spark: SparkSession, path: str, schema: T.StructType = KEYED_PAIRS
) -> DataFrame:
    """JSON-lines files as they arrive in a folder."""
    return spark.readStream.schema(schema).json(path)


def write_clean_stream(
    pairs: DataFrame,
    output_path: str,
    checkpoint_path: str,
    prune_threshold: float = 0.5,
    **trigger,
) -> StreamingQuery:
    """Clean, count, prune, append. ``trigger`` is passed on (``availableNow=True`` to drain)."""
    writer = (
        clean_and_prune(pairs, prune_threshold)
        .writeStream.format("json")
        .outputMode("append")
        .option("path", output_path)
        .option("checkpointLocation", checkpoint_path)
        .option("ignoreNullFields", "false")
    )
    return (writer.trigger(**trigger) if trigger else writer).start()
