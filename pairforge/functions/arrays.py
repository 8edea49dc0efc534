"""Token-id arrays: truncation, padding, masks and label masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED_LABEL = -100


def truncate(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def _missing(ids: Column, length: int | Column) -> Column:
    length = length if isinstance(length, Column) else F.lit(length)
    return F.greatest(length - F.size(ids), F.lit(0))


def pad(ids: Column, length: int | Column, pad_id: int) -> Column:
    """Pad on the right to ``length``; longer arrays are left as they are."""
    return F.concat(ids, F.array_repeat(F.lit(pad_id), _missing(ids, length)))


def attention_mask(ids: Column, length: int | Column) -> Column:
    """1 for each real token of the unpadded ``ids``, then 0 up to ``length``."""
    return F.concat(
        F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), _missing(ids, length))
    )


def mask_labels(ids: Column, pad_id: int) -> Column:
    """Padding becomes the ignored label."""
    return F.transform(ids, lambda x: F.when(x == pad_id, F.lit(IGNORED_LABEL)).otherwise(x))


def unmask_labels(ids: Column, pad_id: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == IGNORED_LABEL, F.lit(pad_id)).otherwise(x))


def count_tokens(ids: Column, pad_id: int) -> Column:
    """Number of entries that are not padding."""
    return F.size(F.filter(ids, lambda x: x != pad_id))


def encode(
    ids: Column,
    max_length: int,
    pad_id: int | None = None,
) -> Column:
    """Model inputs for one column of ids: truncated, and padded when ``pad_id`` is given."""
    ids = truncate(ids, max_length)
    if pad_id is None:
        return F.struct(
            ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask")
        )
    return F.struct(
        pad(ids, max_length, pad_id).alias("input_ids"),
        attention_mask(ids, max_length).alias("attention_mask"),
    )


def encode_labels(
    ids: Column,
    max_length: int,
    pad_id: int | None = None,
    ignore_pad: bool = True,
) -> Column:
    """Label ids: truncated; with fixed padding, padding is ignored unless told otherwise."""
    ids = truncate(ids, max_length)
    if pad_id is None:
        return ids
    padded = pad(ids, max_length, pad_id)
    return mask_labels(padded, pad_id) if ignore_pad else padded
