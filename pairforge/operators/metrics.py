"""Named metrics with declared inputs; each is an aggregate plan over a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.labels import unit_similarity
from pairforge.functions.vectors import cosine, paired_cosine_similarity, unit_cosine
from pairforge.operators import bleu
from pairforge.operators.stats import mean_squared_error, pearson


@dataclass(frozen=True)
class Metric:
    """Roles a metric reads, roles it reads when given, and the plan."""

    roles: tuple[str, ...]
    compute: Callable[..., DataFrame]
    optional: tuple[str, ...] = ()


_METRICS: dict[str, Metric] = {}


def register(
    name: str, roles: tuple[str, ...], optional: tuple[str, ...] = ()
) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Decorator: make ``compute(df) -> DataFrame`` available under ``name``.

    ``compute`` gets a table whose columns are named after the roles.
    """

    def add(compute: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _METRICS[name] = Metric(roles, compute, optional)
        return compute

    return add


def metric_names() -> list[str]:
    return sorted(_METRICS)


def evaluate(df: DataFrame, name: str, **columns: str) -> DataFrame:
    """Run a metric; ``columns`` maps roles to column names, same name by default."""
    if name not in _METRICS:
        raise ValueError(f"unknown metric '{name}', have: {', '.join(metric_names())}")
    metric = _METRICS[name]
    unknown = set(columns) - {*metric.roles, *metric.optional}
    if unknown:
        raise ValueError(f"metric '{name}' has no role {sorted(unknown)}")
    chosen = {role: columns.get(role, role) for role in metric.roles}
    for role in metric.optional:
        column = columns.get(role, role)
        if role in columns or column in df.columns:
            chosen[role] = column
    missing = [c for c in chosen.values() if c not in df.columns]
    if missing:
        raise ValueError(f"metric '{name}' needs column(s) {', '.join(missing)}")
    return metric.compute(df.select(*[F.col(c).alias(role) for role, c in chosen.items()]))


@register("similarity_scores", ("prediction_vec", "reference_vec"))
def similarity_scores(df: DataFrame) -> DataFrame:
    """One score in 0..1 per row."""
    return df.select(unit_cosine(F.col("prediction_vec"), F.col("reference_vec")).alias("scores"))


@register(
    "generation", ("source", "prediction", "reference"), ("prediction_vec", "reference_vec")
)
def generation(df: DataFrame) -> DataFrame:
    """One row: bleu, self_bleu, ibleu and, when vectors are given, sbert. One pass."""
    references = {"ref": F.col("reference"), "src": F.col("source")}
    vectors = {"prediction_vec", "reference_vec"} <= set(df.columns)
    keep = {"cosine": cosine(F.col("prediction_vec"), F.col("reference_vec"))} if vectors else {}
    sums = bleu.match_counts(df, "prediction", references, keep).agg(
        *bleu.total_counts(references), *([F.avg("cosine").alias("sbert")] if vectors else [])
    )
    scored = sums.withColumn("bleu", bleu.bleu_score("ref")).withColumn(
        "self_bleu", bleu.bleu_score("src")
    )
    return scored.select(
        "bleu",
        "self_bleu",
        bleu.ibleu_score(F.col("bleu"), F.col("self_bleu")).alias("ibleu"),
        *(["sbert"] if vectors else []),
    )


@register("bleu", ("prediction", "reference"))
def corpus_bleu(df: DataFrame) -> DataFrame:
    return bleu.corpus_bleu(df, "prediction", "reference")


@register("smoothed_bleu", ("prediction", "reference"))
def smoothed_bleu(df: DataFrame) -> DataFrame:
    return bleu.smoothed_bleu(df, "prediction", "reference")


@register("sts", ("similarity", "source_vec", "target_vec"))
def sts(df: DataFrame) -> DataFrame:
    """One row: Pearson correlation and squared error of vector similarity against
    annotated 0..5 similarity."""
    scored = df.select(
        unit_similarity(F.col("similarity")).alias("gold"),
        paired_cosine_similarity(F.col("source_vec"), F.col("target_vec")).alias("score"),
    )
    gold, score = F.col("gold"), F.col("score")
    return scored.agg(
        pearson(gold, score).alias("pearson"), mean_squared_error(gold, score).alias("mse")
    )


def report(scores: DataFrame) -> DataFrame:
    """A one-row metric table as (metric, value) rows, values times 100 rounded to 3."""
    names = [f.name for f in scores.schema.fields if isinstance(f.dataType, T.NumericType)]
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"), F.bround(F.col(name) * 100, 3).alias("value")
            )
            for name in names
        ]
    )
    return scores.select(F.inline(pairs))
