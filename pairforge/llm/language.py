"""Language identification by sparse multinomial logistic regression.

Features are character 1- to 3-grams of the letters of a text, hashed to ``BUCKETS``
and weighted by TF-IDF. Document frequencies come from all documents that may be
learned from; the classifier from a bounded sample of them, by follow-the-regularised-
leader steps with an elastic net, so most weights are zero. A temperature fitted on
held-back sample rows turns its margins into probabilities.

Texts that are null or without a letter are ``und`` with score 0. If there is nothing
to learn from, all texts are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import added, slices, with_columns
from pairforge.runtime import durable

BUCKETS = 1 << 15
SAMPLE = 4_000  # documents the classifier is fitted on, over all languages
EPOCHS = 3
UNKNOWN = "und"

_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)
# Code points below this that are no letters count as spaces; so do the punctuation blocks.
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def _codes(text: str) -> np.ndarray:
    """Code points of a lower-cased text, every run of others than letters as one space."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = np.where(x < len(_LETTER), _LETTER[np.minimum(x, len(_LETTER) - 1)], x >= 0x3040)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first space after letters stays
    keep[0] = True
    return np.where(letter, x, 32)[keep].astype(np.uint64)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and how often each occurs."""
    x = _codes(text)
    found = []
    h = np.zeros(len(x), np.uint64)
    for n in range(3):
        if len(x) <= n:
            break
        h = (h[: len(x) - n] * np.uint64(31) + x[n:]) if n else x
        found.append(((h * _PRIMES[n]) ^ (h >> np.uint64(7))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(49))
    seen = np.bincount(np.concatenate(found).astype(np.int64), minlength=BUCKETS)
    where = np.flatnonzero(seen)
    return where.astype(np.int32), seen[where]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Weights (buckets x languages), bias, inverse document frequencies and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        where, seen = counts(text)
        x = (1.0 + np.log(seen)) * self.idf[where]
        return where, x / max(np.linalg.norm(x), 1e-12)

    def margins(self, text: str) -> np.ndarray:
        where, x = self.vector(text)
        return x @ self.weights[where] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.margins(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    epochs: int = EPOCHS,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 2e-3,
    l2: float = 1e-3,
    seed: int = 3,
) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, per coordinate; the bias is not regularised."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    l1s = np.full((BUCKETS + 1, 1), l1)
    l1s[-1] = 0.0

    def solved(zs: np.ndarray, ns: np.ndarray, l: np.ndarray) -> np.ndarray:
        return -np.sign(zs) * np.maximum(np.abs(zs) - l, 0) / ((beta + np.sqrt(ns)) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            where, x, y = rows[i]
            at, values = np.append(where, BUCKETS), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            w = solved(zs, ns, l1s[at])
            p = softmax(values @ w)
            p[y] -= 1.0
            g = values[:, None] * p
            g2 = g * g
            z[at] = zs + g - (np.sqrt(ns + g2) - np.sqrt(ns)) / alpha * w
            n[at] = ns + g2
    w = solved(z, n, l1s)
    return w[:-1], w[-1]


def _temperature(margins: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by a search over a logarithmic grid."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(5.0), 100))
    losses = [-np.log(softmax(margins / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def _document_frequencies(batches):
    total, docs = np.zeros(BUCKETS, np.int64), 0
    for batch in slices(batches, "text"):
        for text in batch.column(0).to_pylist():
            if has_letter(text):
                total[counts(text)[0]] += 1
                docs += 1
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(seen, -1).astype(np.int32)), pa.array(np.append(total[seen], docs))], ["gram", "n"]
    )


def _features(batches):
    for batch in slices(batches, "text"):
        found = [counts(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(1),
                batch.column(2),
                pa.array([w.tobytes() for w, _ in found], pa.binary()),
                pa.array([s.astype(np.int32).tobytes() for _, s in found], pa.binary()),
            ],
            ["lang", "held", "grams", "counts"],
        )


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) with a text and a language."""
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    languages = sorted(sizes)
    # About sample / languages rows of each language, chosen by a hash of the id.
    share = F.create_map(
        *[F.lit(v) for lang in languages for v in (lang, min(1.0, sample / len(languages) / sizes[lang]))]
    )
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = known.filter(place < share[F.col("lang")])
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    features = durable(
        chosen.select("text", "lang", held.alias("held")).mapInArrow(
            _features, "lang string, held boolean, grams binary, counts binary"
        ),
        "language-sample",
    )
    frequency = known.select("text").mapInArrow(_document_frequencies, "gram int, n long").groupBy("gram").agg(
        F.sum("n").alias("n")
    )
    seen = np.zeros(BUCKETS + 1, np.int64)
    for r in frequency.collect():  # one row a bucket
        seen[r["gram"]] = r["n"]
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1.0
    model = Model(languages, idf, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)))
    train, test = [], []
    for r in features.collect():  # the bounded sample
        where = np.frombuffer(r["grams"], np.int32)
        x = (1.0 + np.log(np.frombuffer(r["counts"], np.int32))) * idf[where]
        row = (where, x / max(np.linalg.norm(x), 1e-12), languages.index(r["lang"]))
        (test if r["held"] else train).append(row)
    if not train:
        train = test
    model.weights, model.bias = ftrl(train, len(languages))
    # The sample is even over languages, the corpus is not.
    drawn = np.bincount([y for *_, y in train], minlength=len(languages)) + 1.0
    prior = np.array([sizes[lang] for lang in languages], float)
    shift = np.log(prior / prior.sum()) - np.log(drawn / drawn.sum())
    if test:
        margins = np.array([x @ model.weights[w] + model.bias for w, x, _ in test])
        model.temperature = _temperature(margins, np.array([y for *_, y in test]))
    model.bias = model.bias + shift * model.temperature
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, which replace columns of those names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed by buckets and languages

    def run(batches):
        for batch in slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [shared.value.predict(t) for t in texts]
            yield with_columns(
                batch,
                {
                    "lang_pred": pa.array([f[0] for f in found], pa.string()),
                    "score": pa.array([f[1] for f in found], pa.float64()),
                },
            )

    return docs.mapInArrow(run, added(docs, "lang_pred string, score double"))
