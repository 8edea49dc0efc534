"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.runtime import ship

SLICE_BYTES = 4 << 20  # text one numpy step works on; a longer text is a step of its own

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null keys give null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def is_fold(key: str, folds: int, fold: int) -> Column:
    """Whether a row belongs to a fold. A null key always does, so it is never learned from."""
    return F.coalesce(fold_of(key, folds) == fold, F.lit(True))


def bounded_sample(labels: DataFrame, label: str, per_class: int, classes: Iterable) -> DataFrame:
    """At most ``per_class`` rows of each class, those with the smallest hash of ``doc_id``."""
    parts = [
        labels.filter(F.col(label) == value)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(per_class)
        for value in classes
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def utf8(column: pa.Array) -> pa.Array:
    """A string column as its UTF-8 bytes, without copying; null becomes empty."""
    return column.cast(pa.binary()).fill_null(b"")


def slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``SLICE_BYTES`` of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.asarray(pc.binary_length(column).fill_null(0))
        steps = np.cumsum(lengths, dtype=np.int64) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:], strict=False):
            yield batch.slice(start, stop - start)
    # Workers live on after the task; what they do not use goes back.
    pa.default_memory_pool().release_unused()


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added, or replaced where the name is taken."""
    arrays = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in new}
    return pa.RecordBatch.from_arrays([*arrays.values(), *new.values()], [*arrays, *new])


def added(df: DataFrame, ddl: str) -> str:
    """Schema of ``df`` with the columns of ``ddl`` added, or replaced where a name is taken."""
    names = {part.strip().split(" ")[0] for part in ddl.split(",")}
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in names]
    return ", ".join([*kept, ddl])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (bias last) of an L2 logistic regression by Newton steps on a few features."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], l2 * max(1, len(y)))
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(a @ w)
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
