"""A new order for every epoch, computed from row numbers alone.

A keyed permutation of 0..n-1 gives each row its place in an epoch, so batches of any
number of epochs follow from one scan, without a shuffle and without storing an order.
The number is split into two halves of almost equal range, which are mixed in turn by rounds
of a Feistel network; a result of n or more goes through the network again (cycle
walking), which keeps the whole a permutation. How often that may happen is computed beforehand
from the fewer than sqrt(n) results concerned, so the plan has exactly as many steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.operators.ranking import SEED

ROUNDS = 6
PRIME = 2**31 - 1


@dataclass(frozen=True)
class Permutation:
    """Of 0..n-1. ``keys`` are a factor and a summand for each round."""

    n: int
    left: int
    right: int
    keys: tuple[tuple[int, int], ...]

    @classmethod
    def of(cls, n: int, epoch: int, seed: int = SEED) -> Permutation:
        if not 0 <= n < 2**62:
            raise ValueError("row numbers must fit 62 bits")
        left = isqrt(max(n, 1) - 1) + 1
        right = -(-max(n, 1) // left)
        keys = []
        for i in range(ROUNDS):
            digest = hashlib.blake2b(f"{seed}:{epoch}:{i}".encode(), digest_size=16).digest()
            factor, summand = (int.from_bytes(part, "big") for part in (digest[:8], digest[8:]))
            keys.append((1 + factor % (PRIME - 1), summand % PRIME))
        return cls(n, left, right, tuple(keys))

    def once(self, x: np.ndarray) -> np.ndarray:
        """One pass through the network, over 0..left*right-1."""
        l, r = x // self.right, x % self.right
        for i, (factor, summand) in enumerate(self.keys):
            if i % 2:
                r = (r + (l * factor + summand) % PRIME) % self.right
            else:
                l = (l + (r * factor + summand) % PRIME) % self.left
        return l * self.right + r

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self.once(np.asarray(x, np.int64))
        while (outside := out >= self.n).any():
            out[outside] = self.once(out[outside])
        return out

    def passes(self) -> int:
        """Passes after which every number that started below n is there again."""
        outside = np.arange(self.n, self.left * self.right, dtype=np.int64)
        # What no number outside leads to, one below n does; the rest follows, or goes round outside for good.
        x = np.setdiff1d(outside, self.once(outside))
        count = 1
        while len(x):
            count += 1
            x = self.once(x)
            x = x[x >= self.n]
        return count


def epoch_places(
    df: DataFrame, n: int, epochs: Iterable[int], number: str = "row", seed: int = SEED
) -> DataFrame:
    """Every row once for each epoch, with ``epoch`` and its ``place`` there.

    ``number`` holds 0..n-1; another one fails the job. All in whole-stage code: one
    small projection a round.
    """
    orders = {epoch: Permutation.of(n, epoch, seed) for epoch in epochs}
    if not orders:
        raise ValueError("need at least one epoch")
    first = next(iter(orders.values()))
    left, right = F.lit(first.left).cast("long"), F.lit(first.right).cast("long")
    rows = F.array(
        *[
            F.struct(
                F.lit(epoch).alias("epoch"),
                *[F.lit(v).cast("long").alias(f"_{part}{i}") for i, key in enumerate(p.keys) for part, v in zip("fs", key, strict=True)],
            )
            for epoch, p in orders.items()
        ]
    )
    key = F.col(number)
    inside = key.isNotNull() & (key >= 0) & (key < n)
    start = F.when(inside, key).otherwise(F.raise_error(F.lit("a row number is not below n")).cast("long")).cast("long")
    out = df.select(*df.columns, start.alias("place"), F.inline(rows))

    def mixed(half: str, other: str, i: int, size: Column) -> Column:
        return (F.col(half) + (F.col(other) * F.col(f"_f{i}") + F.col(f"_s{i}")) % PRIME) % size

    for step in range(max(p.passes() for p in orders.values())):
        # Spark's ``div`` keeps whole numbers whole; ``/`` would go through doubles.
        out = out.withColumns({"_l": F.expr(f"place div {first.right}L"), "_r": F.col("place") % right})
        for i in range(ROUNDS):
            half, other, size = ("_r", "_l", right) if i % 2 else ("_l", "_r", left)
            out = out.withColumn(half, mixed(half, other, i, size))
        through = F.col("_l") * right + F.col("_r")
        out = out.withColumn("place", through if not step else F.when(F.col("place") < n, F.col("place")).otherwise(through))
    return out.select(*df.columns, "epoch", "place")


def epoch_batches(
    df: DataFrame, n: int, size: int, epochs: Iterable[int], number: str = "row", seed: int = SEED
) -> DataFrame:
    """``epoch``, ``batch_id`` and ``pos`` of every row: batches of ``size`` in the epoch's order."""
    placed = epoch_places(df, n, epochs, number, seed)
    return placed.select(
        *df.columns, "epoch", F.expr(f"place div {int(size)}L").alias("batch_id"), (F.col("place") % size).alias("pos")
    )
