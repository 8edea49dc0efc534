"""Ranked lexical search: exact largest inner products by trees of balls.

A document is a sparse vector of integer impacts, one for each term of the queries that it
holds; a query is a sparse vector of integer weights; the score is their inner product.

1. One pass over the texts counts terms and lengths (``count_terms``). It is written, since
   document frequencies, the number of documents and their total length must be known
   before an impact can be computed.
2. Every split of the counts is made into trees of at most ``TREE_ROWS`` different
   vectors (``build_trees``), and these are written: they are the index. Equal vectors,
   as copies have, are one vector with a list of ids. A node is halved between two vectors
   that lie far apart; it keeps the centroid of its vectors and the largest distance to
   it. Axes are stretched by the root of a term's weight, so common terms count less.
3. A query visits nodes best-first. No vector of a node scores more than its centroid does,
   plus the radius times the norm of the query over the terms that the node holds. All of
   that is computed in doubles and rounded up by more than the possible error, so no
   subtree is left out that could hold a result. At leaves scores are exact 64-bit integers.
   A first round visits the best leaf of every tree only. The k-th score found is a
   lower bound from which the second, full round starts.

Nothing but results meets: at most k rows for each query and task. Queries are taken, and
sent to the tasks, in blocks of at most ``BLOCK_WORDS`` words, as many as there are.

Null texts and texts without terms are in no result and do not count as documents. Every
row is a document and every row of the items a query, whatever its id; among equal scores
the smaller ``doc_id`` comes first and null ids last. Items without terms have no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.common import slices, utf8
from pairforge.llm.decontaminate import words_of
from pairforge.llm.token_grammar import ragged
from pairforge.runtime import durable

BLOCK_WORDS = 200_000  # query words that are searched, and broadcast, at a time
TREE_ROWS = 1 << 13
LEAF_ROWS = 24
K = 10

COUNTS = "doc_id long, n long, terms array<int>, counts array<int>"


# --- counts -------------------------------------------------------------------------------


def count_terms(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): all terms of a document, and those in ``terms`` with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        get, width = shared.value.get, np.int64(len(shared.value))
        for batch in slices(batches, "text"):
            lengths, hits = [], []
            for i, text in enumerate(utf8(batch.column(1)).to_pylist()):
                words = words_of(text)
                lengths.append(len(words))
                mine = [t for t in map(get, words) if t is not None]
                hits.append(np.array(mine, np.int64) + i * width)
            keys, counts = np.unique(np.concatenate(hits), return_counts=True)
            cuts = np.searchsorted(keys, np.arange(batch.num_rows + 1) * width).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(v.astype(np.int32))) for v in (keys % max(width, 1), counts)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTS)


def document_frequencies(counts: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term, summed in the tasks first."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column(0).flatten()), minlength=n_terms)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["term", "n"])

    out = np.zeros(n_terms, np.int64)
    found = counts.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in found.collect():  # a row for a term of the block at most
        out[r["term"]] = r["n"]
    return out


@dataclass
class Collection:
    """What scores need to know of all documents."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, terms: int) -> Collection:
        n_docs, total = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = document_frequencies(counts, terms)
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in frequency.tolist()]
        return cls(n_docs, total, np.array(weights, np.int64))

    def impacts(self, tf: np.ndarray, n: list[int], rows: np.ndarray) -> np.ndarray:
        """Impacts of counts; ``rows`` says whose, ``n`` how many terms each row has."""
        # In Python's integers: a long document in a large collection passes 64 bits here.
        m = np.array([100 - 90 + 90 * k * self.n_docs // self.n_terms for k in n], np.int64)
        tf = tf.astype(np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 8 * m[rows])


# --- trees --------------------------------------------------------------------------------

TREE = T.StructType(
    [
        T.StructField(name, T.BinaryType())
        for name in ("terms", "edges", "cols", "impacts", "member_edges", "members", "nameless",
                     "children", "ranges", "radii", "centre_edges", "centre_nodes", "centre_values")
    ]
)
TYPES = dict(
    zip(TREE.names, ("<i4", "<i4", "<i4", "<i4", "<i4", "<i8", "?", "<i4", "<i4", "<f8", "<i4", "<i4", "<f8"), strict=True)
)
# Sums of up to 10^5 products of doubles are off by less than 10^-10 of their terms' size.
SAFE = 1e-10


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums over the rows between ``edges``, none of which is empty."""
    return np.add.reduceat(values, edges[:-1]) if len(edges) > 1 else np.zeros(0, values.dtype)


class _Grower:
    """Halves sets of vectors until they fit a leaf."""

    def __init__(self, edges: np.ndarray, cols: np.ndarray, values: np.ndarray, width: int) -> None:
        self.edges, self.cols, self.values, self.width = edges, cols, values, width
        self.norms = _sums(values * values, edges)
        self.children: list[tuple[int, int]] = []
        self.ranges: list[tuple[int, int]] = []
        self.radii: list[float] = []
        self.centres: list[tuple[np.ndarray, np.ndarray]] = []
        self.order = np.arange(len(edges) - 1)

    def rows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = self.edges[of + 1] - self.edges[of]
        at = ragged(self.edges[of], sizes)
        return np.concatenate([[0], np.cumsum(sizes)]), self.cols[at], self.values[at]

    def grow(self) -> None:
        """Nodes in the order in which they are met: a node comes before its children."""
        waiting = [(0, len(self.order), -1, 0)]
        while waiting:
            begin, end, parent, side = waiting.pop()
            number = len(self.ranges)
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = number
                self.children[parent] = (pair[0], pair[1])
            of = self.order[begin:end]
            edges, cols, values = self.rows(of)
            sums = np.bincount(cols, weights=values, minlength=self.width)
            centre = sums / len(of)
            norm = float(centre @ centre)
            squares = self.norms[of] - 2 * _sums(values * centre[cols], edges) + norm
            slack = SAFE * (self.norms[of] + norm)
            self.radii.append(float(np.sqrt(np.maximum(squares, 0) + slack).max()) * (1 + SAFE))
            held = np.flatnonzero(sums)
            self.centres.append((held, centre[held]))
            self.ranges.append((begin, end))
            self.children.append((-1, -1))
            if len(of) > LEAF_ROWS:
                far = self._dense(of[int(np.argmax(squares))])
                other = self._dense(of[int(np.argmax(self.norms[of] - 2 * _sums(values * far[cols], edges)))])
                along = _sums(values * (other - far)[cols], edges)
                middle = len(of) // 2
                self.order[begin:end] = of[np.argsort(along, kind="stable")]
                waiting += [(begin + middle, end, number, 1), (begin, begin + middle, number, 0)]

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        a, b = self.edges[row], self.edges[row + 1]
        out[self.cols[a:b]] = self.values[a:b]
        return out


def _tree(rows: list[tuple[int | None, bytes, bytes]], weights: np.ndarray) -> tuple[bytes, ...]:
    """One tree from (doc_id, terms, impacts); equal vectors become one."""
    members: dict[tuple[bytes, bytes], list] = {}
    for doc_id, terms, impacts in rows:
        members.setdefault((terms, impacts), []).append(doc_id)
    edges = np.concatenate([[0], np.cumsum([len(t) // 4 for t, _ in members])])
    cols = np.frombuffer(b"".join(t for t, _ in members), "<i4")
    impacts = np.frombuffer(b"".join(i for _, i in members), "<i4")
    terms, cols = np.unique(cols, return_inverse=True)
    # A weight of 0 stretches nothing; what it would hide from the centre scores nothing either.
    stretch = np.sqrt(np.maximum(weights[terms], 0))
    grower = _Grower(edges, cols, impacts * stretch[cols], len(terms))
    grower.grow()
    sizes = np.diff(edges)[grower.order]
    at = ragged(edges[grower.order], sizes)
    listed = list(members.values())
    ids = [sorted(listed[i], key=lambda x: (x is None, x or 0)) for i in grower.order.tolist()]
    flat = [x for group in ids for x in group]
    # Centres by term: the nodes that hold it, and its mean there.
    node = np.repeat(np.arange(len(grower.centres)), [len(c) for c, _ in grower.centres])
    held, value = (np.concatenate([c[i] for c in grower.centres]) for i in (0, 1))
    by = np.argsort(held, kind="stable")
    columns = {
        "terms": terms,
        "edges": np.concatenate([[0], np.cumsum(sizes)]),
        "cols": cols[at],
        "impacts": impacts[at],
        "member_edges": np.concatenate([[0], np.cumsum([len(g) for g in ids])]),
        "members": np.array([x or 0 for x in flat], np.int64),
        "nameless": np.array([x is None for x in flat], bool),
        "children": np.array(grower.children),
        "ranges": np.array(grower.ranges),
        "radii": np.array(grower.radii),
        "centre_edges": np.concatenate([[0], np.cumsum(np.bincount(held, minlength=len(terms)))]),
        "centre_nodes": node[by],
        "centre_values": value[by],
    }
    return tuple(np.ascontiguousarray(columns[n].astype(TYPES[n])).tobytes() for n in TREE.names)


def build_trees(counts: DataFrame, collection: Collection, tree_rows: int = TREE_ROWS) -> DataFrame:
    """One row for each tree. Documents without any of the terms are in none."""
    shared = counts.sparkSession.sparkContext.broadcast(collection)

    def run(batches):
        known = shared.value
        held: list[tuple] = []
        different: set[tuple[bytes, bytes]] = set()

        def grown() -> pa.RecordBatch:
            values = _tree(held, known.weights)
            held.clear()
            different.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], TREE.names)

        for batch in batches:
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes = np.asarray(batch.column(2).value_lengths())
            terms = np.asarray(batch.column(2).flatten()).astype("<i4")
            owner = np.repeat(np.arange(len(ids)), sizes)
            impacts = known.impacts(np.asarray(batch.column(3).flatten()), n, owner).astype("<i4")
            edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if a < b:
                    vector = terms[a:b].tobytes(), impacts[a:b].tobytes()
                    held.append((ids[i], *vector))
                    different.add(vector)
                    # Copies cost little: the bound on rows is one on memory only.
                    if len(different) >= tree_rows or len(held) >= 64 * tree_rows:
                        yield grown()
        if held:
            yield grown()

    return counts.mapInArrow(run, TREE)


class Tree:
    """A stored tree, opened for search."""

    def __init__(self, row: dict[str, bytes]) -> None:
        for name, data in row.items():
            setattr(self, name, np.frombuffer(data, TYPES[name]))
        self.children = self.children.reshape(-1, 2).tolist()
        self.ranges = self.ranges.reshape(-1, 2).tolist()
        self.dense = np.zeros(len(self.terms), np.int64)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> list[float]:
        """For every node, what none of its vectors scores more than. ``terms`` are places in ``self.terms``."""
        sizes = (self.centre_edges[terms + 1] - self.centre_edges[terms]).astype(np.int64)
        at = ragged(self.centre_edges[terms].astype(np.int64), sizes)
        nodes = self.centre_nodes[at]
        weight = np.repeat(weights.astype(np.float64), sizes)
        n = len(self.radii)
        centre = np.bincount(nodes, np.sqrt(weight) * self.centre_values[at], n)
        norm = np.sqrt(np.bincount(nodes, weight, n))
        return ((centre + norm * self.radii) * (1 + SAFE) + 1).tolist()

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int, k: int, leaves: int | None) -> list[tuple[int, bool, int]]:
        """The ``k`` best (score, nameless, doc_id) of ``least`` or more; of ``leaves`` leaves only, if given."""
        place = np.searchsorted(self.terms, terms)
        place[place == len(self.terms)] = 0
        mine = (self.terms[place] == terms) & (weights > 0)
        place, weights = place[mine], weights[mine]
        if not len(place):
            return []
        bound = self.bounds(place, weights)
        self.dense[place] = weights
        best: list[tuple[int, int, int]] = []  # a heap of (score, -nameless, -doc_id): the worst is first
        waiting = [(-bound[0], 0)]
        seen = 0
        while waiting:
            above, node = heapq.heappop(waiting)
            if -above < least:
                break
            left, right = self.children[node]
            if left >= 0:
                for child in (left, right):
                    # A child is bounded by what bounds its parent, too.
                    heapq.heappush(waiting, (max(above, -bound[child]), child))
                continue
            self._score(node, least, k, best)
            if len(best) == k:
                least = max(least, best[0][0])
            seen += 1
            if leaves is not None and seen >= leaves:
                break
        self.dense[place] = 0
        return [(s, bool(-a), -b) for s, a, b in best]

    def _score(self, leaf: int, least: int, k: int, best: list[tuple[int, int, int]]) -> None:
        begin, end = self.ranges[leaf]
        edges = self.edges[begin : end + 1]
        a, b = edges[0], edges[-1]
        scores = np.add.reduceat(self.impacts[a:b] * self.dense[self.cols[a:b]], edges[:-1] - a)
        for i in np.flatnonzero(scores >= max(1, least)).tolist():
            score = int(scores[i])
            first, last = self.member_edges[begin + i], self.member_edges[begin + i + 1]
            for j in range(first, min(last, first + k)):  # in order, so that the first k are enough
                entry = (score, -int(self.nameless[j]), -int(self.members[j]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


# --- search -------------------------------------------------------------------------------


@dataclass
class Queries:
    """Different terms of each item, as numbers."""

    items: list
    terms: dict[bytes, int]
    lists: list[np.ndarray]

    @classmethod
    def of(cls, rows: list) -> Queries:
        terms: dict[bytes, int] = {}
        lists = [
            np.unique(np.array([terms.setdefault(w, len(terms)) for w in words_of((r["text"] or "").encode())], np.int64))
            for r in rows
        ]
        return cls([r["item_id"] for r in rows], terms, lists)


FOUND = "query int, doc_id long, score long"


def _visit(trees: DataFrame, queries: Queries, weights: np.ndarray, least: list[int], k: int, leaves: int | None) -> DataFrame:
    """At most ``k`` rows (query, doc_id, score) for each query and task."""
    shared = trees.sparkSession.sparkContext.broadcast((queries.lists, weights, least))

    def run(batches):
        lists, weights, least = shared.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in lists]
        bar = list(least)
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree({n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)})
                for number, terms in enumerate(lists):
                    more = tree.search(terms, weights[terms], bar[number], k, leaves)
                    if more:
                        mine = sorted([*best[number], *more], key=lambda r: (-r[0], r[1], r[2]))[:k]
                        best[number] = mine
                        if len(mine) == k:
                            bar[number] = max(bar[number], mine[-1][0])
        rows = [(q, None if nameless else doc_id, score) for q, mine in enumerate(best) for score, nameless, doc_id in mine]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["query", "doc_id", "score"]
        )

    return trees.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(items: DataFrame, block_words: int) -> Iterator[list]:
    """The items in blocks of some ``block_words`` words, a block at a time."""
    size = F.length(F.coalesce("text", F.lit(""))).cast("long") / 2 + 1  # no term is shorter than that
    total = items.agg(F.coalesce(F.sum(size), F.lit(0.0))).first()[0]
    n = int(total // block_words) + 1
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        yield items.filter(place == b).collect()


def build_index(docs: DataFrame, terms: dict[bytes, int], tree_rows: int = TREE_ROWS) -> tuple[DataFrame, Collection]:
    """The stored trees over ``docs`` (doc_id, text) for queries of ``terms``, and the collection's figures."""
    counts = durable(count_terms(docs, terms), "term_counts")
    collection = Collection.of(counts, len(terms))
    return durable(build_trees(counts.filter(F.size("terms") > 0), collection, tree_rows), "trees"), collection


def search(spark: SparkSession, trees: DataFrame, collection: Collection, queries: Queries, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every query, with scores above 0."""
    least = [1] * len(queries.lists)
    for r in _ranked(_visit(trees, queries, collection.weights, least, k, 1), k).filter(F.col("rank") == k).collect():
        least[r["query"]] = r["score"]  # one row for a query of the block at most
    found = _ranked(_visit(trees, queries, collection.weights, least, k, None), k)
    names = spark.createDataFrame([(q, i) for q, i in enumerate(queries.items)], "query int, item_id long")
    return found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = K, block_words: int = BLOCK_WORDS, tree_rows: int = TREE_ROWS
) -> DataFrame:
    """The ``k`` best documents of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    out = None
    for rows in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")), block_words):
        queries = Queries.of(rows)
        if queries.terms:
            trees, collection = build_index(docs, queries.terms, tree_rows)
            part = search(spark, trees, collection, queries, k)
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
