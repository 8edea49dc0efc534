"""Toxicity by a weighted lexicon.

A text is folded (case, accents, look-alike letters, digits that stand for
letters, invisible characters), matched against the lexicon by one Aho-Corasick
automaton, and its weighted hits are set against its length. Hits inside an
exception phrase do not count. Weights are log-odds from a bounded sample of
labelled rows; entries are whole words or beginnings of words (``stem*``).

Null and empty texts have no hits and get the score of a text without any.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import added, bounded_sample, fit_logistic, is_fold, sigmoid, slices, with_columns
from pairforge.runtime import durable

SAMPLE_PER_CLASS = 6_000  # labelled documents a fit uses, for each label
ENTRIES = 300  # lexicon entries kept at most
STEMS = (4, 5, 6)  # lengths of the word beginnings that may become entries
LEAST_DOCS = 4  # toxic sample documents that must hold an entry
SUREST = 1.8  # log-odds an entry must reach after 1.5 standard errors are taken off

# Look-alike letters of other scripts, digits and signs read as letters, and
# characters nobody sees. Extend per call through ``Folding``.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝвкмнтαεορτυνικ", "aeopcyxijshdqwbkmhtaeoptyvik", strict=True))
DIGITS = dict(zip("013457@$", "oieastas", strict=True))
INVISIBLE = "­​‌‍⁠﻿"

# Phrases in which an entry is harmless.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "white trash bag", "trash bin", "stupid simple")

_TABLE = {ord(k): v for k, v in {**LOOKALIKES, **DIGITS}.items()} | {ord(c): None for c in INVISIBLE}
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents, look-alikes and digit spellings."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join([c for c in text if not unicodedata.combining(c)]) if not text.isascii() else text
    return text.translate(_TABLE)


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, ...] = (1.0, 1.0, -4.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            built = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                stem = entry.endswith("*")
                word = entry.removesuffix("*")
                kinds = dict(built.get(word, (len(word), {}))[1])
                kinds["stem" if stem else "word"] = weight
                built.add_word(word, (len(word), kinds))
            for phrase in self.exceptions:
                phrase = fold(phrase)
                kinds = dict(built.get(phrase, (len(phrase), {}))[1])
                kinds["exception"] = 0.0
                built.add_word(phrase, (len(phrase), kinds))
            built.make_automaton()
            self._automaton = built
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) in the folded text; of hits on one place the heaviest counts."""
        found, spared = {}, []
        if not self.weights:
            return []
        for last, (size, kinds) in self.automaton().iter(folded):
            start, end = last + 1 - size, last + 1
            if start and folded[start - 1].isalnum():
                continue
            whole = end == len(folded) or not folded[end].isalnum()
            if "exception" in kinds and whole:
                spared.append((start, end))
            weight = max(kinds.get("stem", 0.0), kinds.get("word", 0.0) if whole else 0.0)
            if weight > found.get(start, (0, 0.0))[1]:
                found[start] = (end, weight)
        return [
            (start, end, weight)
            for start, (end, weight) in found.items()
            if not any(a <= start and end <= b for a, b in spared)
        ]

    def features(self, text: str | None) -> tuple[float, float]:
        """Weight of all hits, and the same per 1,000 words; both as log(1 + x)."""
        if not text:
            return 0.0, 0.0
        total = sum(h[2] for h in self.hits(fold(text)))
        words = len(text.split())
        return float(np.log1p(total)), float(np.log1p(1000.0 * total / max(20, words)))


def _pattern_counts(batches):
    """Documents of each label that hold a word or a beginning of one."""
    counts: Counter = Counter()
    for batch in batches:
        for text, y in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            words = set(_WORD.findall(fold(text or "")))
            seen = {w for w in words if 3 <= len(w) <= 40}
            seen |= {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
            for entry in seen:
                counts[entry, y] += 1
    keys = list(counts)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([counts[k] for k in keys], pa.int64()),
        ],
        ["entry", "y", "n"],
    )


def _choose(rows: list, totals: dict[int, int], entries: int) -> dict[str, float]:
    """Entries with the surest log-odds: a stem goes where one longer entry has nearly all
    its documents, and an entry where a stem of it is about as sure."""
    weights = {}
    for r in rows:
        weights[r["entry"]] = float(
            np.log((r["n1"] + 0.5) / (totals[1] + 1)) - np.log((r["n0"] + 0.5) / (totals[0] + 1))
        )
    docs = {r["entry"]: r["n1"] for r in rows}
    longest: dict[str, int] = {}
    for entry, n in docs.items():
        word = entry.removesuffix("*")
        for stem in (word[:k] + "*" for k in STEMS if k < len(word)):
            longest[stem] = max(longest.get(stem, 0), n)
    stems = {
        e: w for e, w in weights.items() if e.endswith("*") and longest.get(e, 0) < 0.9 * docs[e]
    }
    kept = {}
    for entry, weight in weights.items():
        word = entry.removesuffix("*")
        shorter = [word[:k] + "*" for k in STEMS if k < len(word)]
        if entry.endswith("*") and entry not in stems:
            continue
        if not any(stems.get(s, -1.0) >= weight - 0.7 for s in shorter):
            kept[entry] = weight
    return dict(sorted(kept.items(), key=lambda kv: (-kv[1], kv[0]))[:entries])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = SAMPLE_PER_CLASS,
    entries: int = ENTRIES,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """Learn a lexicon from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text).

    One half of a bounded sample gives the entries and their weights, the other
    half the two coefficients and the bias that turn hits into a probability.
    Rows with another label than 0 or 1 are not used. Without labelled rows of
    both classes the lexicon is empty.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()
    )
    prior = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(prior) < 2:
        return Lexicon({}, exceptions)
    chosen = bounded_sample(known, "y", per_class, (0, 1)).dropDuplicates(["doc_id"])
    sample = durable(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("text", "y", (F.xxhash64("doc_id", F.lit(7)) % 2 == 0).alias("half")),
        "toxicity-sample",
    )
    part = sample.filter("half").select("text", "y")
    totals = {0: 0, 1: 0} | {
        r["y"]: r["n"] for r in part.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    counts = (
        part.mapInArrow(_pattern_counts, "entry string, y int, n long")
        .groupBy("entry")
        .agg(
            F.sum(F.expr("CASE WHEN y = 1 THEN n ELSE 0 END")).alias("n1"),
            F.sum(F.expr("CASE WHEN y = 0 THEN n ELSE 0 END")).alias("n0"),
        )
    )
    odds = F.log((F.col("n1") + 0.5) / (totals[1] + 1)) - F.log((F.col("n0") + 0.5) / (totals[0] + 1))
    doubt = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    sure = (
        counts.filter(F.col("n1") >= LEAST_DOCS)
        .withColumn("sure", odds - 1.5 * doubt)
        .filter(F.col("sure") > SUREST)
        .orderBy(F.desc("sure"), "entry")
        .limit(8 * entries)
    )
    lexicon = Lexicon(_choose(sure.collect(), totals, entries), exceptions)

    def measure(batches):
        for batch in batches:
            x = np.array([lexicon.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], ["a", "b", "y"]
            )

    other = sample.filter("NOT half").select("text", "y").mapInArrow(measure, "a double, b double, y int")
    rows = other.toPandas()  # at most the sample
    if rows["y"].nunique() < 2:
        return lexicon
    w = fit_logistic(rows[["a", "b"]].to_numpy(), rows["y"].to_numpy(), l2=1e-4)
    # The sample is even over classes, the corpus is not.
    n1, n0 = int((rows["y"] == 1).sum()), int((rows["y"] == 0).sum())
    w[-1] += np.log(prior[1] / prior[0]) - np.log(n1 / n0)
    lexicon.coefficients = tuple(float(v) for v in w)
    return lexicon


def score(
    docs: DataFrame, lexicon: Lexicon, text: str = "text", keep_below: float | None = None
) -> DataFrame:
    """Adds ``score``, ``predicted`` and ``n_hits``, which replace columns of those names.

    With ``keep_below`` the columns stay as they are, and rows scored that high or
    higher are left out.
    """
    ddl = "score double, predicted int, n_hits long"

    def run(batches):
        wa, wb, bias = lexicon.coefficients
        for batch in slices(batches, text):
            index = batch.schema.get_field_index(text)
            n = batch.num_rows
            a, b, found = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            for i, value in enumerate(batch.column(index).to_pylist()):
                if value:
                    hits = lexicon.hits(fold(value))
                    if hits:
                        total = sum(h[2] for h in hits)
                        a[i] = np.log1p(total)
                        b[i] = np.log1p(1000.0 * total / max(20, len(value.split())))
                        found[i] = len(hits)
            p = sigmoid(wa * a + wb * b + bias)
            if keep_below is not None:
                yield batch.filter(pa.array(p < keep_below))
                continue
            yield with_columns(
                batch,
                {
                    "score": pa.array(p),
                    "predicted": pa.array((p >= 0.5).astype(np.int32)),
                    "n_hits": pa.array(found),
                },
            )

    return docs.mapInArrow(run, docs.schema if keep_below is not None else added(docs, ddl))


def learned_from(labels: DataFrame) -> DataFrame:
    """The labelled rows a fit may see: all but fold 0 of 5."""
    return labels.filter(~is_fold("doc_id", 5, 0))
