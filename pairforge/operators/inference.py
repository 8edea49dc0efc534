"""A user's model over columns, in Arrow batches."""

from __future__ import annotations

import hashlib
import sys
import types
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pairforge.runtime import ship

MODELS = 2  # models a worker keeps; the one that was not used for longest goes first


def _kept_model(name: str, load: Callable[[], Callable[..., list]]) -> Callable[..., list]:
    """The model of this name in this worker, loaded when it is not there."""
    # A module of its own outlives the task but not the worker.
    home = vars(sys.modules.setdefault("pairforge_models", types.ModuleType("pairforge_models")))
    models: OrderedDict = home.setdefault("models", OrderedDict())
    if name not in models:
        while len(models) >= MODELS:
            models.popitem(last=False)
        models[name] = load()
    models.move_to_end(name)
    return models[name]


def _size(value: object) -> int:
    return len(value) if hasattr(value, "__len__") else 0


def infer(
    df: DataFrame,
    inputs: list[str],
    output: str,
    output_type: T.DataType | str,
    load: Callable[[], Callable[..., list]],
    batch_size: int = 64,
    name: str | None = None,
    profile=None,
) -> DataFrame:
    """Append ``output`` = model(inputs).

    ``load`` returns the model, a function of one list per input column giving
    one value per row; a null input is None. A worker keeps it under ``name``, by default
    a digest of ``load`` and what it holds on to, so that several calls, stages and jobs
    with the same ``load`` share it; ``MODELS`` of them stay. The model sees at most
    ``batch_size`` rows at a time, cut from Arrow batches of
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows in order of their lengths, so
    that rows of a batch need about the same padding; results are in the order of the
    input. Lower that setting for very long texts.

    Runs as ``mapInArrow``: only the inputs become Python values, all other columns
    pass through as they are, and a filter on the output never runs the model twice.
    Catalyst does not move filters below it: apply cheap ones first. ``profile``, a
    ``ResourceProfile``, says what the tasks of this stage need (a GPU, say).
    """
    if isinstance(output_type, str):
        output_type = T.DataType.fromDDL(output_type)
    schema = T.StructType(df.schema.fields + [T.StructField(output, output_type)])
    kind = to_arrow_type(output_type)
    names = schema.names
    places = [df.columns.index(c) for c in inputs]
    ship(df.sparkSession)
    key = name or hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _kept_model(key, load)
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in places]
            order = sorted(range(batch.num_rows), key=lambda i: sum(_size(c[i]) for c in columns))
            values: list = [None] * batch.num_rows
            for start in range(0, batch.num_rows, batch_size):
                rows = order[start : start + batch_size]
                given = list(model(*[[column[i] for i in rows] for column in columns]))
                if len(given) != len(rows):
                    raise ValueError(f"model gave {len(given)} values for {len(rows)} rows")
                for i, value in zip(rows, given, strict=True):
                    values[i] = value
            made = pa.array(values, kind, from_pandas=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names)

    return df.mapInArrow(run, schema, profile=profile) if profile else df.mapInArrow(run, schema)


def embed(
    df: DataFrame,
    columns: dict[str, str],
    load: Callable[[], Callable[[list], list]],
    kind: str = "array<double>",
    batch_size: int = 64,
) -> DataFrame:
    """Vectors of several text columns ({new column: text column}) by one model in one pass.

    Two calls of ``infer`` would be two Python workers a task, each with the model.
    """
    texts = list(columns.values())

    def load_all():
        model = load()

        def run(*lists):
            flat = list(model([text for texts in lists for text in texts]))
            n = len(lists[0])
            return [list(v) for v in zip(*[flat[i : i + n] for i in range(0, n * len(lists), n)], strict=True)]

        return run

    each = max(1, batch_size // len(texts))
    made = infer(df, texts, "_vectors", f"array<{kind}>", load_all, each)
    return made.withColumns({new: made["_vectors"][i] for i, new in enumerate(columns)}).drop("_vectors")
