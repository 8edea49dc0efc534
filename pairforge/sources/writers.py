"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.sources.readers import escape_lines

ROLES = ("source", "target", "prediction")
# Spark trims fields on write unless told not to.
PREDICTION_FORMAT = {
    "sep": "\t",
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _mode(skip_existing: bool) -> str:
    """Either leave an existing output alone, or fail rather than overwrite it."""
    return "ignore" if skip_existing else "errorifexists"


def write_jsonl(df: DataFrame, path: str, skip_existing: bool = False) -> None:
    """JSON lines in raw UTF-8; nulls are written, not left out."""
    df.write.mode(_mode(skip_existing)).option("ignoreNullFields", "false").json(path)


def write_predictions(
    df: DataFrame, path: str, skip_existing: bool = False, one_line: bool = False
) -> None:
    """Source, target and prediction as tab-separated text with a header.

    With ``one_line`` line ends inside a text are escaped, so that a large file can be
    read by many tasks; ``read_delimited`` has the same switch.
    """
    roles = df.select(*ROLES)
    if one_line:
        roles = roles.select(*[escape_lines(F.col(c)).alias(c) for c in ROLES])
    roles.write.mode(_mode(skip_existing)).options(**PREDICTION_FORMAT).csv(path)


def write_lines(
    df: DataFrame,
    path: str,
    column: str = "prediction",
    order: str | None = None,
    skip_existing: bool = False,
) -> None:
    """One text per line, in key order over the part files when ``order`` is given."""
    if order is not None:
        df = df.orderBy(order)
    df.select(column).write.mode(_mode(skip_existing)).text(path)


def write_splits(df: DataFrame, path: str, skip_existing: bool = False) -> None:
    """One folder per value of ``split``, in one pass over the table."""
    (
        df.write.mode(_mode(skip_existing))
        .option("ignoreNullFields", "false")
        .partitionBy("split")
        .json(path)
    )


def write_report(report: DataFrame, path: str) -> None:
    """A metric report as CSV, in place of an older one. A handful of rows, so one file."""
    report.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
