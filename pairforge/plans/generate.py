"""Model inputs, generated predictions and their scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.arrays import encode, encode_labels
from pairforge.functions.text import lower_columns, strip
from pairforge.operators.columns import prefix_column, rename_roles, resolve_column, select_roles
from pairforge.operators.inference import embed, infer
from pairforge.operators.metrics import evaluate, report
from pairforge.operators.ranking import SEED, shuffle_batches
from pairforge.runtime import finished, scratch, write_whole
from pairforge.sources.readers import read_delimited, read_named
from pairforge.sources.splits import load_splits, prepare
from pairforge.sources.writers import write_predictions, write_report


def encode_rows(
    df: DataFrame,
    source_ids: str,
    target_ids: str,
    max_source_length: int = 1024,
    max_target_length: int = 128,
    pad_id: int | None = None,
    ignore_pad: bool = True,
) -> DataFrame:
    """input_ids, attention_mask and labels from two columns of token ids.

    ``pad_id`` turns on padding to the maximum lengths; without it batches are
    padded by whoever forms them.
    """
    return df.select(
        encode(F.col(source_ids), max_source_length, pad_id).alias("x"),
        encode_labels(F.col(target_ids), max_target_length, pad_id, ignore_pad).alias("labels"),
    ).select("x.*", "labels")


def generate(
    df: DataFrame,
    load: Callable[[], Callable[[list[str]], list[str]]],
    source: str | None = None,
    target: str | None = None,
    prefix: str = "",
    keep: tuple[str, ...] = (),
    batch_size: int = 16,
) -> DataFrame:
    """source, target and the stripped prediction of a user's model for prefix + source."""
    source, target = resolve_column(df, source, 0), resolve_column(df, target, 1)
    rows = df.select(
        *keep,
        F.col(source).alias("source"),
        F.col(target).alias("target"),
        F.col(source).alias("_input"),
    )
    out = infer(
        prefix_column(rows, prefix, "_input"), ["_input"], "_raw", "string", load, batch_size
    )
    return out.select(*keep, "source", "target", strip(F.col("_raw")).alias("prediction"))


VECTORS = ("prediction_vec", "reference_vec")


def score(
    df: DataFrame,
    metric: str = "generation",
    source: str | None = None,
    target: str | None = None,
    prediction: str | None = None,
    lower_case: bool = False,
    load: Callable[[], Callable[[list[str]], list]] | None = None,
    batch_size: int = 64,
) -> DataFrame:
    """One metric over a prediction table. Lower-casing leaves predictions alone.

    Vectors of predictions and references, for the mean cosine, are taken from columns
    of the table or made by the model that ``load`` returns.
    """
    held = [v for v in VECTORS if v in df.columns and load is None]
    roles = select_roles(df, source, target, prediction, keep=held)
    if lower_case:
        roles = lower_columns(roles)
    if load is not None:
        # A null counts as empty here, as it does in the other values of the record.
        texts = {f"_{c}": F.coalesce(F.col(c), F.lit("")) for c in ("prediction", "target")}
        given = roles.withColumns(texts)
        roles = embed(given, dict(zip(VECTORS, texts, strict=True)), load, batch_size=batch_size).drop(*texts)
    return evaluate(roles, metric, reference="target")


def run_generate(
    spark: SparkSession, df: DataFrame, load: Callable, output_path: str, **options
) -> None:
    write_whole(generate(df, load, **options), output_path, write_predictions)


def prepare_and_generate(
    spark: SparkSession,
    output_path: str,
    load: Callable,
    file: str | None = None,
    dataset: str | None = None,
    config: str | None = None,
    split: str | None = None,
    delimiter: str | None = None,
    remove_bad_chars: bool = False,
    max_samples: int | None = None,
    predicate: str | None = None,
    mapping: str | None = None,
    **options,
) -> None:
    """Load a csv or JSON file or a named dataset, prepare it, generate, write.

    Preparing cleans the texts, keeps the first ``max_samples`` rows, and applies the
    user's filter and mapping, in this order. Nothing is done when the output is finished;
    one cut short is written anew.
    """
    if (file is None) == (dataset is None):
        raise ValueError("give either a file or a dataset")
    if finished(spark, output_path):
        return
    with scratch(spark):
        if file is not None:
            rows = load_splits(spark, {"test": file}, delimiter=delimiter)["test"]
        else:
            rows = read_named(spark, dataset, config, split)
        limits = {"test": max_samples} if max_samples is not None else None
        ready = prepare({"test": rows}, remove_bad_chars, limits, predicate, mapping)["test"]
        run_generate(spark, ready, load, output_path, **options)


def run_score(
    spark: SparkSession, input_path: str, output_path: str, delimiter: str = "\t", **options
) -> DataFrame:
    """Score a prediction file, write the report (values times 100) and return it as written.

    An older report is replaced, so that it never stands for newer predictions.
    """
    table = report(score(read_delimited(spark, input_path, delimiter=delimiter), **options))
    write_report(table, output_path)
    return spark.read.schema(table.schema).option("header", "true").csv(output_path)


def sts_batches(
    df: DataFrame, size: int = 64, key: str = "pair_id", seed: int = SEED
) -> DataFrame:
    """Shuffled training batches of source and target, from either naming of the roles."""
    named = rename_roles(df, keep=(key,)).select(key, "source", "target")
    return shuffle_batches(named, size, key, seed)
