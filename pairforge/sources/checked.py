"""JSON lines of which some may be no good: one scan that keeps the good ones and tells about the rest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.operators.expressions import checked
from pairforge.runtime import write_whole
from pairforge.schema import PAIRS
from pairforge.sources.offsets import SPLIT_BYTES
from pairforge.sources.readers import read_offset_lines

NO_JSON = "no JSON of this form"
PLACE = ("file", "offset", "text", "reason")


def read_checked_jsonl(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str = PAIRS,
    checks: Mapping[str, str] | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """The columns of ``schema``, and where a row stands and why it is rejected.

    ``checks`` are SQL conditions by their names, which a good row meets; the first one that
    is false or null is the ``reason``. A line that is no JSON object of the schema has
    null columns and ``NO_JSON``. Good rows have a null ``reason``. ``text`` is the line of a
    rejected row, ``file`` and ``offset`` say where it begins. Blank lines are no rows.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    taken = {f.name.lower() for f in schema.fields} & {*PLACE}
    if taken:
        raise ValueError(f"these names are used for the place and reason: {', '.join(sorted(taken))}")
    lines = read_offset_lines(spark, path, split_bytes).filter(r"text RLIKE '\\S'")
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    row = F.from_json("text", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.select("file", "offset", "text", row.alias("_row")).select(
        "_row.*", "file", "offset", "text"
    )
    reason = F.when(F.col("_corrupt").isNotNull(), F.lit(NO_JSON))
    for name, condition in (checks or {}).items():
        reason = reason.when(~F.coalesce(checked(parsed, condition), F.lit(False)), F.lit(name))
    found = parsed.withColumn("reason", reason)
    return found.select(
        # Spark may keep the fields before a fault; a line that is no good gives none.
        *[F.when(F.col("_corrupt").isNull(), F.col(f"`{f.name}`")).alias(f.name) for f in schema.fields],
        "file",
        "offset",
        F.when(F.col("reason").isNotNull(), F.col("text")).alias("text"),
        "reason",
    )


def write_checked(df: DataFrame, path: str) -> bool:
    """Good and rejected rows in two folders, ``rejected=false`` and ``rejected=true``, in one pass."""
    marked = df.withColumn("rejected", F.col("reason").isNotNull())
    return write_whole(marked, path, lambda d, p: d.write.partitionBy("rejected").json(p))
