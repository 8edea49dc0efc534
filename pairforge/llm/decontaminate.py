"""Benchmark passages in documents, by a positional inverted index.

The words of the benchmark are the terms. A first pass over the documents counts
how often each term occurs; every window of 13 benchmark words is then filed
under its rarest term. A second pass stores the postings of those rare terms: the
row, the position, and the terms at the 12 positions before and after it, which
are the entries of the other lists that a match through this posting can use. A
window is found where the lists agree after adjusting for their offsets, so a
posting list that is hot in the documents is never shuffled against another one.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words. Only one block
is broadcast at a time, and its size is known before it is collected.

Nulls and texts without words have no hits. Rows are told apart by their place in
the stored index, so repeated ids give one result each. Benchmark rows without an
id mark words, but count as no item.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.common import slices, utf8
from pairforge.runtime import durable

WINDOW = 13
BLOCK_WORDS = 1_000_000  # benchmark words matched, and broadcast, at a time
OUTSIDE, NO_TERM = -2, -1

# Words are runs of a-z (A-Z folded), 0-9 and every byte of a non-ASCII character.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)

INDEX = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("term", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("near", T.ArrayType(T.IntegerType())),
        T.StructField("n_words", T.LongType()),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass
class Queries:
    """Windows of one block of benchmark items as term numbers."""

    terms: dict[bytes, int]
    windows: list[tuple[int, ...]]
    items: list[tuple[int, int]]  # (window, item_id)
    size: int

    @classmethod
    def of(cls, rows: list, size: int) -> Queries:
        terms: dict[bytes, int] = {}
        numbers: dict[tuple[int, ...], int] = {}
        items = set()
        for r in rows:
            ids = [terms.setdefault(w, len(terms)) for w in words_of((r["text"] or "").encode())]
            for start in range(max(1, len(ids) - size + 1) if ids else 0):
                window = numbers.setdefault(tuple(ids[start : start + size]), len(numbers))
                if r["item_id"] is not None:
                    items.add((window, int(r["item_id"])))
        return cls(terms, list(numbers), sorted(items), size)


def _term_ids(column: pa.Array, terms: dict[bytes, int]) -> list[np.ndarray]:
    get = terms.get
    out = []
    for text in utf8(column).to_pylist():
        words = words_of(text)
        out.append(np.fromiter([get(w, NO_TERM) for w in words], np.int32, len(words)))
    return out


def term_counts(docs: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """Occurrences of every term over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        total = np.zeros(len(shared.value) + 1, np.int64)
        for batch in slices(batches, "text"):
            for ids in _term_ids(batch.column(0), shared.value):
                total += np.bincount(ids + 1, minlength=len(total))
        seen = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(total[1:][seen])], ["term", "n"]
        )

    counts = np.zeros(len(terms), np.int64)
    rows = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most one row a term
        counts[r["term"]] = r["n"]
    return counts


def build_index(docs: DataFrame, terms: dict[bytes, int], filed: np.ndarray, size: int = WINDOW) -> DataFrame:
    """Postings of the terms marked in ``filed``, and one row per document with ``n_words``.

    Written to the shared folder, so numbers of rows stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast((terms, filed))
    reach = size - 1
    around = np.arange(-reach, reach + 1)

    def run(batches):
        terms, filed = shared.value
        wanted = np.concatenate([[False, False], filed])
        row = TaskContext.get().partitionId() << 40
        gap = np.full(reach, OUTSIDE, np.int32)
        for batch in slices(batches, "text"):
            texts = _term_ids(batch.column(1), terms)
            lengths = np.array([len(t) for t in texts], np.int64)
            line = np.concatenate([gap, *[x for t in texts for x in (t, gap)]])
            starts = reach + np.concatenate([[0], np.cumsum(lengths + reach)[:-1]])
            place = np.flatnonzero(wanted[line + 2])
            owner = np.searchsorted(starts, place, side="right") - 1
            rows = row + np.arange(len(texts))
            row += len(texts)
            near = line[place[:, None] + around].ravel()
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows),
                    ids,
                    pa.nulls(len(texts), pa.int32()),
                    pa.nulls(len(texts), pa.int32()),
                    pa.nulls(len(texts), pa.list_(pa.int32())),
                    pa.array(lengths),
                ],
                INDEX.names,
            )
            if len(place):
                offsets = np.arange(0, len(near) + 1, len(around), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[owner]),
                        ids.take(pa.array(owner)),
                        pa.array(line[place]),
                        pa.array((place - starts[owner]).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(near)),
                        pa.nulls(len(place), pa.int64()),
                    ],
                    INDEX.names,
                )

    built = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)
    return durable(built, "postings")


def _filed(queries: Queries, counts: np.ndarray) -> list[tuple[int, int, int, list[int]]]:
    """(window, rarest term, its offset, words) for every window."""
    out = []
    for number, window in enumerate(queries.windows):
        offset = min(range(len(window)), key=lambda j: (counts[window[j]], window[j], j))
        out.append((number, window[offset], offset, list(window)))
    return out


def phrase_matches(index: DataFrame, windows: DataFrame, size: int = WINDOW) -> DataFrame:
    """(row, doc_id, window, start, length) of every exact occurrence.

    ``windows`` is one block of (window, term, offset, words), of bounded size.
    """
    here = F.slice("near", F.lit(size) - F.col("offset"), F.size("words"))
    return (
        index.filter("term IS NOT NULL")
        .join(F.broadcast(windows), "term")
        .filter(here == F.col("words"))
        .select("row", "doc_id", "window", (F.col("pos") - F.col("offset")).alias("start"),
                F.size("words").alias("length"))
    )


def proximity_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, doc_id, window, pos): all words of a window around one place, in any order."""
    return (
        index.filter("term IS NOT NULL")
        .join(F.broadcast(windows), "term")
        .filter(F.size(F.array_except("words", "near")) == 0)
        .select("row", "doc_id", "window", "pos")
    )


def _blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    size = F.size(F.split("text", r"\s+")).cast("long") + F.length("text") / 8
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    n = int(total // block_words) + 1
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    if n == 1:
        return [items]
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.filter(place == b) for b in range(n)]


WINDOWS = "window int, term int, offset int, words array<int>"


def find(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``n_words``, ``n_hit``, ``n_items``, ``items``."""
    spark = docs.sparkSession
    hits, items, stats = [], [], None
    for block in _blocks(benchmark, block_words):
        queries = Queries.of(block.collect(), size)  # a block is bounded
        counts = term_counts(docs, queries.terms) if queries.terms else np.zeros(0, np.int64)
        filed = _filed(queries, counts)
        marked = np.zeros(len(queries.terms), bool)
        marked[[f[1] for f in filed]] = True
        index = build_index(docs, queries.terms, marked, size)
        if stats is None:
            stats = index.filter("term IS NULL").select("row", "doc_id", "n_words")
        if not filed:
            continue
        found = durable(phrase_matches(index, spark.createDataFrame(filed, WINDOWS), size), "phrases")
        places = F.sequence("start", F.col("start") + F.col("length") - 1)
        hits.append(found.select("row", F.explode(places).alias("pos")))
        of = spark.createDataFrame(queries.items, "window int, item_id long")
        items.append(found.select("row", "window").distinct().join(F.broadcast(of), "window").select("row", "item_id"))
    if not hits:
        return stats.select(
            "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
            F.array().cast("array<bigint>").alias("items"),
        )
    every_hit, every_item = hits[0], items[0]
    for more in hits[1:]:
        every_hit = every_hit.unionByName(more)
    for more in items[1:]:
        every_item = every_item.unionByName(more)
    n_hit = every_hit.distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    listed = every_item.groupBy("row").agg(F.collect_set("item_id").alias("items"))
    return (
        stats.join(n_hit, "row", "left")
        .join(listed, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        )
    )


def contaminated() -> Column:
    """The rule: some word is hit, and one in twenty words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
