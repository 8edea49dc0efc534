"""Texts to subword ids by a vocabulary file."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairforge.runtime import ship

_KEPT: dict[str, object] = {}


def _tokenizer(path: str):
    """The tokenizer of a file, kept for later tasks of the same worker."""
    if path not in _KEPT:
        from tokenizers import Tokenizer

        _KEPT.clear()  # one at a time: a vocabulary takes tens of megabytes
        _KEPT[path] = Tokenizer.from_file(path)
        _KEPT[path].encode_special_tokens = True  # their strings in a text are ordinary text
        _KEPT[path].no_truncation()
        _KEPT[path].no_padding()
    return _KEPT[path]


def encode_texts(
    df: DataFrame,
    columns: dict[str, str],
    vocabulary: str,
    begin: int | None = None,
    end: int | None = None,
    batch_size: int = 256,
) -> DataFrame:
    """Add arrays of ids ({new column: text column}), in one pass for all columns.

    ``vocabulary`` is the path of a ``tokenizers`` file that every executor can read.
    ``begin`` and ``end`` are put around every text's ids. Null texts give null. Truncating,
    padding and masks are left to ``functions.arrays`` and ``operators.batching``.
    """
    ship(df.sparkSession)
    kind = pa.list_(pa.int32())
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in columns])
    places = [df.columns.index(c) for c in columns.values()]
    before, after = ([] if i is None else [i] for i in (begin, end))

    def run(batches):
        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            made = []
            for place in places:
                texts = batch.column(place).to_pylist()
                ids: list = [None] * len(texts)
                rows = [i for i, t in enumerate(texts) if t is not None]
                for start in range(0, len(rows), batch_size):
                    part = rows[start : start + batch_size]
                    found = tokenizer.encode_batch([texts[i] for i in part], add_special_tokens=False)
                    for i, encoding in zip(part, found, strict=True):
                        ids[i] = before + encoding.ids + after
                made.append(pa.array(ids, kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema.names)

    return df.mapInArrow(run, schema)
