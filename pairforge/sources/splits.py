"""Load train / validation / test and prepare them for a model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pairforge.functions.text import clean_pairs_b
from pairforge.operators.columns import map_columns
from pairforge.operators.prune import filter_rows
from pairforge.operators.ranking import first_n
from pairforge.sources.readers import read_delimited, read_jsonl, with_row_number


def file_format(name: str) -> str | None:
    """``csv`` or ``json`` from a file name, looking through a ``.gz``; None if neither."""
    suffix = name.rstrip("/").removesuffix(".gz").rpartition(".")[2]
    return {"csv": "csv", "json": "json", "jsonl": "json"}.get(suffix)


def load_splits(
    spark: SparkSession,
    files: Mapping[str, str],
    schema: T.StructType | str | None = None,
    delimiter: str | None = None,
) -> dict[str, DataFrame]:
    """One table per split. The format is taken from each file's own suffix.

    All columns are kept, as the header or the JSON fields name them; a ``schema``
    narrows them. Columns of csv files are text.
    """
    if not files:
        raise ValueError("need at least one split")
    tables = {}
    for split, path in files.items():
        kind = file_format(path)
        if kind is None:
            raise ValueError(f"cannot tell the format of {path} ({split}): neither csv nor json")
        if kind == "csv":
            tables[split] = read_delimited(spark, path, schema, delimiter or ",")
        else:
            tables[split] = read_jsonl(spark, path, schema)
    return tables


def prepare(
    splits: Mapping[str, DataFrame],
    remove_bad_chars: bool = False,
    max_rows: Mapping[str, int] | None = None,
    predicate: str | None = None,
    mapping: str | None = None,
    key: str = "pair_id",
) -> dict[str, DataFrame]:
    """Clean, cut to the first rows per split, filter, map; in that order.

    The first rows are those with the smallest keys. Tables straight from files
    need no key: they get row numbers in file order when a split is to be cut.
    """
    prepared = {}
    for name, df in splits.items():
        # Cutting first reads the same rows: cleaning does not touch the key.
        limit = (max_rows or {}).get(name)
        if limit is not None:
            own = key in df.columns
            df = first_n(df if own else with_row_number(df, key), limit, key, unique=not own)
        df = clean_pairs_b(df, remove_bad_chars=remove_bad_chars)
        df = filter_rows(df, predicate)
        prepared[name] = map_columns(df, mapping) if mapping else df
    return prepared
