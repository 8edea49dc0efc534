"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages: its lines, long ones cut every ``PASSAGE_WORDS``
words. Each passage is described by its characters, words and repetition, encoded by
a layer, and weighted by gated attention; the weighted sum of the encodings gives the
score. Labels are known for documents only, so the weights that single out telling
passages are learned with the rest, on a bounded sample.

Null and empty texts are one empty passage. Without labelled rows of both classes
every score is the share of ones, or 0.5.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import added, bounded_sample, sigmoid, slices, with_columns
from pairforge.runtime import durable

SAMPLE_PER_CLASS = 3_000  # labelled documents a fit uses, for each label
SAMPLE_PASSAGES = 400_000  # and passages of them that are kept in memory at most
SAMPLE_OF_ONE = 20_000  # passages of one document in it, evenly spaced
PASSAGE_WORDS = 150
HIDDEN, GATES = 24, 12
EPOCHS = 40
HASHED = 24  # buckets of hashed words

_KINDS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"!", b"?", b".", b",",
    b"\"'();:-", b"#$%&*", b"@^~|<>{}[]\\/=+_`",
]
_KIND_OF = bytes(next((k for k, some in enumerate(_KINDS) if c in some), 11 if c < 128 else 12) for c in range(256))
WIDTH = 13 + 9 + HASHED


def passages(text: str | None) -> list[str]:
    """Lines of a text; longer ones in steps of ``PASSAGE_WORDS`` words."""
    out = []
    for line in (text or "").split("\n"):
        words = line.split(" ")
        if len(words) <= PASSAGE_WORDS:
            if line.strip():
                out.append(line)
        else:
            out += [" ".join(words[i : i + PASSAGE_WORDS]) for i in range(0, len(words), PASSAGE_WORDS)]
    return out or [""]


def describe(text: str | None) -> np.ndarray:
    """One row of numbers for each passage."""
    parts = passages(text)
    seen: set[str] = set()
    rows = np.zeros((len(parts), WIDTH), np.float32)
    for row, part in zip(rows, parts, strict=True):
        raw = part.encode()
        kinds = np.bincount(np.frombuffer(raw.translate(_KIND_OF), np.uint8), minlength=13)
        row[:13] = kinds / max(1, len(raw))
        words = part.lower().split()
        n = len(words)
        if n:
            distinct = set(words)
            numbers = [zlib.crc32(w.encode()) for w in words]
            hashed = np.array(numbers, np.uint32)
            row[13] = np.log1p(n) / 5
            row[14] = len(raw) / n / 10
            row[15] = len(distinct) / n
            row[16] = (hashed[1:] == hashed[:-1]).mean() if n > 1 else 0.0
            row[17] = np.bincount(hashed % 97).max() / n
            row[18] = part in seen
            row[19] = (len({*zip(numbers, numbers[1:], strict=False)}) / (n - 1)) if n > 1 else 1.0
            buckets = np.bincount((hashed >> 8) % HASHED, minlength=HASHED)
            row[22:] = buckets / n
        row[20] = np.log1p(len(parts)) / 5
        seen.add(part)
    rows[:, 21] = len(seen) / len(parts)
    return rows


@dataclass
class Model:
    """Parameters by name; ``mean`` and ``scale`` standardise the passages."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    fixed: float | None = None

    def attend(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Forward pass over passages of several bags that begin at ``starts``."""
        p = self.p
        h = np.maximum(x @ p["E"] + p["e"], 0)
        t, g = np.tanh(h @ p["V"] + p["v"]), sigmoid(h @ p["U"] + p["u"])
        a = (t * g) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        bag = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "bag": bag, "sizes": sizes, "y": sigmoid(bag @ p["c"] + p["b"])}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(bags), self.fixed)
        x = (np.concatenate(bags) - self.mean) / self.scale
        starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
        return self.attend(x, starts)["y"]


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 5e-3, l2: float = 1e-4, seed: int = 1) -> Model:
    """Adam on the log loss of whole bags."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate(bags)
    model = Model(
        {
            "E": rng.standard_normal((WIDTH, HIDDEN)) / np.sqrt(WIDTH), "e": np.zeros(HIDDEN),
            "V": rng.standard_normal((HIDDEN, GATES)) / np.sqrt(HIDDEN), "v": np.zeros(GATES),
            "U": rng.standard_normal((HIDDEN, GATES)) / np.sqrt(HIDDEN), "u": np.zeros(GATES),
            "w": rng.standard_normal(GATES) / np.sqrt(GATES), "c": rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN),
            "b": np.zeros(()),
        },
        flat.mean(axis=0), flat.std(axis=0) + 1e-3,
    )
    p = model.p
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            x = (np.concatenate([bags[i] for i in some]) - model.mean) / model.scale
            starts = np.cumsum([0, *(len(bags[i]) for i in some[:-1])])
            f = model.attend(x, starts)
            wrong = (f["y"] - labels[some]) / len(some)
            grad = {"c": f["bag"].T @ wrong, "b": wrong.sum()}
            to_bag = np.repeat(wrong, f["sizes"])[:, None] * p["c"]
            along = (to_bag * f["h"]).sum(axis=1)
            inside = f["a"] * along
            to_a = inside - f["a"] * np.repeat(np.add.reduceat(inside, starts), f["sizes"])
            grad["w"] = (f["t"] * f["g"]).T @ to_a
            to_t = to_a[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
            to_g = to_a[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
            grad |= {"V": f["h"].T @ to_t, "v": to_t.sum(axis=0), "U": f["h"].T @ to_g, "u": to_g.sum(axis=0)}
            to_h = (f["a"][:, None] * to_bag + to_t @ p["V"].T + to_g @ p["U"].T) * (f["h"] > 0)
            grad |= {"E": x.T @ to_h, "e": to_h.sum(axis=0)}
            step += 1
            for k in p:
                g = grad[k] + (l2 * p[k] if p[k].ndim == 2 else 0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _described(batches):
    for batch in slices(batches, "text"):
        bags = [describe(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array([b.tobytes() for b in bags], pa.binary()), pa.array([len(b) for b in bags], pa.int64())],
            ["y", "place", "bag", "n"],
        )


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from ``labels`` (doc_id, quality) of ``docs`` (doc_id, text)."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()
    )
    prior = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = Model({}, np.zeros(WIDTH), np.ones(WIDTH), float(1 in prior) if prior else 0.5)
    if len(prior) < 2:
        return nothing
    chosen = bounded_sample(known, "y", per_class, (0, 1)).dropDuplicates(["doc_id"])
    sample = durable(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("text", "y", F.xxhash64("doc_id").alias("place"))
        .mapInArrow(_described, "y int, place long, bag binary, n long"),
        "quality-sample",
    )
    bags, ys, held = [], [], 0
    for r in sample.orderBy("place").toLocalIterator():  # the bounded sample
        bag = np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH)
        bag = bag[:: max(1, -(-len(bag) // SAMPLE_OF_ONE))]
        if held + len(bag) > SAMPLE_PASSAGES:
            continue
        held += len(bag)
        bags.append(bag)
        ys.append(r["y"])
    y = np.array(ys, float)
    if len(set(ys)) < 2:
        return nothing
    model = train(bags, y)
    # The sample is even over classes, the corpus is not.
    model.p["b"] = model.p["b"] + np.log(prior[1] / prior[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds ``score`` and ``predicted``, which replace columns of those names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of parameters

    def run(batches):
        for batch in slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = shared.value.scores([describe(t) for t in texts])
            yield with_columns(
                batch,
                {"score": pa.array(found), "predicted": pa.array((found >= threshold).astype(np.int32))},
            )

    return docs.mapInArrow(run, added(docs, "score double, predicted int"))
