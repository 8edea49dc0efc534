"""Corpus BLEU, self-BLEU and iBLEU with no shuffle of texts or n-grams.

Everything BLEU needs from a pair is in one row, so clipped matches are counted
in Arrow batches of rows, by numbers of their n-grams, and only about ten sums per partition travel.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.text import strip
from pairforge.functions.tokens import bleu_words
from pairforge.runtime import ship

ORDERS = (1, 2, 3, 4)
ALPHA = 0.7
SLICE_BYTES = 4 << 20  # text counted at once; a longer row is counted alone


def _row_counts(sides: list[list[list[str]]]) -> list[np.ndarray]:
    """Lengths of every side, then matches of each order with the first side, by reference.

    A side is a list of rows of tokens. N-grams of all rows get numbers of their own, a number for an
    n-gram of one row whichever side it is on, so clipped matches are least counts by number.
    """
    rows = len(sides[0])
    lengths = [np.fromiter(map(len, side), np.int64, rows) for side in sides]
    words = pa.array([t for side in sides for row in side for t in row], pa.string()).dictionary_encode().indices
    words = words.to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.concatenate([np.repeat(np.arange(rows), n) for n in lengths])
    ends = np.cumsum(np.concatenate(lengths))
    left = np.repeat(ends, np.concatenate(lengths)) - np.arange(len(words))  # tokens from here to the end of the text
    side_of = np.repeat(np.arange(len(sides)), [int(n.sum()) for n in lengths])
    most = int(words.max()) + 1 if len(words) else 1
    grams, at = of, np.arange(len(words))
    matches = []
    for n in ORDERS:
        whole = left[at] >= n
        at, grams = at[whole], grams[whole]
        distinct, grams = np.unique(grams * most + words[at + n - 1], return_inverse=True)
        row = np.zeros(len(distinct), np.int64)
        row[grams] = of[at]
        counts = [np.bincount(grams[side_of[at] == s], minlength=len(distinct)) for s in range(len(sides))]
        matches.append([np.bincount(row, np.minimum(counts[0], c), rows).astype(np.int64) for c in counts[1:]])
    return [*lengths, *(matches[i][r] for r in range(len(sides) - 1) for i in range(len(ORDERS)))]


def match_counts(
    df: DataFrame,
    prediction: str,
    references: Mapping[str, Column],
    keep: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per row: ``pred_len`` and, per named reference, its length and matches of each order.

    A null text counts as empty. Rows are counted some at a time, so a batch never holds more than
    a few megabytes of tokens, or those of one row.
    """
    keep = keep or {}
    texts = {"pred": F.col(prediction), **references}
    rows = df.select(
        *[c.alias(name) for name, c in keep.items()],
        *[F.coalesce(c.cast("string"), F.lit("")).alias(f"{s}_text") for s, c in texts.items()],
    )
    names = [f"{s}_len" for s in texts] + [f"{r}_match_{n}" for r in references for n in ORDERS]
    schema = T.StructType([*rows.schema.fields[: len(keep)], *(T.StructField(n, T.IntegerType()) for n in names)])

    kept, first, stop_at = list(keep), len(keep), len(keep) + len(texts)

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(i).cast(pa.binary()).to_pylist() for i in range(first, stop_at)]
        numbers = _row_counts([[bleu_words(t.decode("utf-8", "replace")) for t in c] for c in columns])
        arrays = [*(batch.column(i) for i in range(first)), *(pa.array(x, pa.int32()) for x in numbers)]
        return pa.RecordBatch.from_arrays(arrays, [*kept, *names])

    def run(batches):
        for batch in batches:
            sizes = sum(np.asarray(pc.binary_length(batch.column(i))).astype(np.int64) for i in range(first, stop_at))
            steps = np.cumsum(sizes) // SLICE_BYTES
            edges = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:], strict=False):
                if stop > start:
                    yield counted(batch.slice(start, stop - start))

    ship(df.sparkSession)
    return rows.mapInArrow(run, schema)


def total_counts(references: Mapping[str, Column]) -> list[Column]:
    """The sums over ``match_counts`` rows that every BLEU variant is made of."""

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    possible = [
        total(F.greatest(F.col("pred_len") - (n - 1), F.lit(0))).alias(f"possible_{n}")
        for n in ORDERS
    ]
    lengths = [total(F.col(f"{s}_len")).alias(f"{s}_len") for s in ("pred", *references)]
    matches = [
        total(F.col(f"{r}_match_{n}")).alias(f"{r}_match_{n}") for r in references for n in ORDERS
    ]
    return possible + lengths + matches


def _brevity(reference: str) -> Column:
    pred, ref = F.col("pred_len"), F.col(f"{reference}_len")
    return F.when(pred > ref, F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(ref, pred)))


def bleu_score(reference: str) -> Column:
    """Unsmoothed BLEU, 0..1, over summed counts; 0 when any order has no match."""
    matched = reduce(Column.__and__, [F.col(f"{reference}_match_{n}") > 0 for n in ORDERS])
    logs = [F.ln(F.try_divide(F.col(f"{reference}_match_{n}"), F.col(f"possible_{n}"))) for n in ORDERS]
    mean = reduce(Column.__add__, logs) / len(ORDERS)
    return F.when(matched, _brevity(reference) * F.exp(mean)).otherwise(F.lit(0.0))


def smoothed_bleu_score(reference: str) -> Column:
    """BLEU on 0..100 with exponential smoothing of orders that have no match.

    The k-th order without a match counts as 1/2^k of one match; no match at all,
    or an order that no prediction is long enough for, gives 0.
    """
    usable = reduce(Column.__and__, [F.col(f"possible_{n}") > 0 for n in ORDERS])
    any_match = reduce(Column.__or__, [F.col(f"{reference}_match_{n}") > 0 for n in ORDERS])
    misses = F.lit(0)
    logs = F.lit(0.0)
    for n in ORDERS:
        match = F.col(f"{reference}_match_{n}")
        misses = misses + F.when(match == 0, 1).otherwise(0)
        effective = F.when(match > 0, match.cast("double")).otherwise(F.pow(F.lit(2.0), -misses))
        logs = logs + F.ln(F.try_divide(effective * 100, F.col(f"possible_{n}")))
    return F.when(usable & any_match, _brevity(reference) * F.exp(logs / len(ORDERS))).otherwise(
        F.lit(0.0)
    )


def ibleu_score(bleu: Column, self_bleu: Column, alpha: float = ALPHA) -> Column:
    """Reward for matching the reference less a penalty for copying the source."""
    return F.bround(F.lit(alpha) * bleu - F.lit(1 - alpha) * self_bleu, 3)


def corpus_bleu(
    df: DataFrame, prediction: str = "prediction", reference: str = "target", name: str = "bleu"
) -> DataFrame:
    """One row: BLEU of the predictions against one reference column."""
    references = {"ref": F.col(reference)}
    return (
        match_counts(df, prediction, references)
        .agg(*total_counts(references))
        .select(bleu_score("ref").alias(name))
    )


def smoothed_bleu(
    df: DataFrame, prediction: str = "prediction", reference: str = "target"
) -> DataFrame:
    """One row: smoothed BLEU (0..100) of stripped texts, rounded to 4."""
    stripped = df.select(
        strip(F.col(prediction)).alias("prediction"), strip(F.col(reference)).alias("target")
    )
    references = {"ref": F.col("target")}
    return (
        match_counts(stripped, "prediction", references)
        .agg(*total_counts(references))
        .select(F.bround(smoothed_bleu_score("ref"), 4).alias("bleu"))
    )
