"""Evaluate expensive columns once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns that are evaluated once per row, whoever reads them.

    With a plain projection Catalyst moves later filters below it by copying the
    expressions, so a filter on a cleaned text cleans it twice, and one on a
    count of its words tokenises it again. A one-element ``inline`` stops that:
    filters on its output stay above it, filters on other columns still pass.
    """
    rest = [c for c in df.columns if c not in columns]
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    new = [c for c in columns if c not in df.columns]
    return df.select(*rest, F.inline(F.array(row))).select(*df.columns, *new)
