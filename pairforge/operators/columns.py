"""Projections: roles, renames, prefixes and user mappings."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators.expressions import checked

ROLES = ("source", "target", "prediction")


def resolve_column(df: DataFrame, name: str | None, position: int) -> str:
    """The named column, or the one at ``position`` when no name is given."""
    if name is None:
        return df.columns[position]
    if name not in df.columns:
        raise ValueError(f"no column '{name}' here, only {', '.join(df.columns)}")
    return name


def select_roles(df: DataFrame, *names: str | None, keep: Iterable[str] = ()) -> DataFrame:
    """Source, target and, when a third name is given, prediction; by name or by position.

    One column may play two roles, as when sources are scored as predictions.
    """
    chosen = [
        F.col(resolve_column(df, name, i)).alias(role)
        for i, (role, name) in enumerate(zip(ROLES, names))
    ]
    return df.select(*keep, *chosen)


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def rename_roles(
    df: DataFrame,
    premise: str = "premise",
    hypothesis: str = "hypothesis",
    keep: Iterable[str] = (),
) -> DataFrame:
    """Premise and hypothesis become source and target and the rest is dropped but
    for ``keep``, unless the roles are already there."""
    if {"source", "target"} <= set(df.columns):
        return df
    return df.select(*keep, F.col(premise).alias("source"), F.col(hypothesis).alias("target"))


def roles_first(df: DataFrame, roles=("source", "target")) -> DataFrame:
    return df.select(*roles, *[c for c in df.columns if c not in roles])


def map_columns(df: DataFrame, assignments: str) -> DataFrame:
    """Apply ``a = expr; b = expr`` from left to right; later ones see earlier ones.

    Expressions are Spark SQL, checked. A semicolon inside quotes does not separate.
    """
    parts = re.findall(r"""(?:[^;'"]|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")+|;""", assignments)
    if "".join(parts) != assignments:
        raise ValueError(f"a quote is not closed: {assignments!r}")
    parts = [part for part in parts if part != ";"]
    for part in filter(None, map(str.strip, parts)):
        name, equals, expression = part.partition("=")
        if not equals or not name.strip() or not expression.strip():
            raise ValueError(f"not an assignment: {part!r}")
        df = df.withColumn(name.strip(), checked(df, expression.strip()))
    return df


def prefix_column(df: DataFrame, prefix: str, column: str = "source") -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(prefix), F.col(column)))
