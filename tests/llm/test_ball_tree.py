"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pairforge.llm import ball_tree as B

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [w.lower() for w in TERM.findall((text or "").encode())]  # bytes.lower folds A-Z only


def plain(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, c, n in counted:
            m = 100 - 90 + 90 * n * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms_of(text))
                if c[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, nameless, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if nameless else doc_id, -score))
    return out


def same(got, want):
    def order(r):
        return tuple((x is None, x or 0) for x in r)

    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["Ünd", "x-y", "a,b", "THE"]
    weights = [1 / (1 + i) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 8, 30, 200])))) for i in range(n)]


@pytest.mark.parametrize(("seed", "tree_rows", "block_words"), [(1, 1 << 14, 200_000), (2, 40, 200_000), (3, 25, 60)])
def test_ranks_equal_those_of_all_scores(spark, documents, seed, tree_rows, block_words):
    rng = random.Random(seed)
    docs = corpus(rng, 300)
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # copies: equal scores, more than a leaf of them
    docs += [(2000, None), (2001, ""), (2002, " ,.;"), (None, docs[7][1]), (None, docs[7][1]), (7, docs[7][1]), (2003, "w1 " * 20_000)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.sample([f"w{j}" for j in range(70)] + ["the", "ünd", "y"], 6))) for i in range(12)]
    items += [(50, docs[3][1]), (51, None), (52, ""), (53, "nowhere to be found"), (3, "W3 w3 W3"), (None, "w2")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = B.rank_documents(documents(docs), table, tree_rows=tree_rows, block_words=block_words)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    same(got, plain(docs, items))


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert B.rank_documents(documents([]), items).collect() == []
    assert B.rank_documents(documents([(1, "w1"), (2, None)]), items.limit(0)).collect() == []
    assert B.rank_documents(documents([(1, None)]), items).collect() == []


def grown(rng, n, terms=80):
    weights = rng.integers(0, 9000, terms)
    rows = []
    for i in range(n):
        held = np.sort(rng.choice(terms, rng.integers(1, 25), replace=False)).astype("<i4")
        rows.append((i, held.tobytes(), rng.integers(1, 1_000_000, len(held)).astype("<i4").tobytes()))
    return rows, weights, B.Tree(dict(zip(B.TREE.names, B._tree(rows, weights), strict=True)))


def scores(tree, weights, query):
    """Exact score of every vector of the tree, in the order of its leaves."""
    dense = np.zeros(len(weights), np.int64)
    dense[query] = weights[query]
    cols = tree.terms[tree.cols]
    return np.add.reduceat(tree.impacts * dense[cols], tree.edges[:-1])


@pytest.mark.parametrize("seed", range(5))
def test_no_vector_scores_more_than_its_nodes_bound(seed):
    rng = np.random.default_rng(seed)
    _, weights, tree = grown(rng, 700)
    assert len(tree.ranges) > 50
    for _ in range(30):
        query = np.sort(rng.choice(80, 12, replace=False))
        query = query[(weights[query] > 0) & np.isin(query, tree.terms)]
        bounds = tree.bounds(np.searchsorted(tree.terms, query), weights[query])
        exact = scores(tree, weights, query)
        for (begin, end), bound in zip(tree.ranges, bounds, strict=True):
            assert exact[begin:end].max() <= bound


def test_subtrees_are_pruned_and_nothing_is_lost():
    rng = np.random.default_rng(9)
    # Groups of documents about a few terms each: all but the fitting group can be left out.
    rows, weights = [], np.full(400, 3000)
    for i in range(4000):
        group = 8 * (i % 50)
        held = np.sort(rng.choice(np.arange(group, group + 8), 5, replace=False)).astype("<i4")
        rows.append((i, held.tobytes(), rng.integers(400_000, 600_000, 5).astype("<i4").tobytes()))
    tree = B.Tree(dict(zip(B.TREE.names, B._tree(rows, weights), strict=True)))
    visited = []
    score = tree._score
    tree._score = lambda *a: (visited.append(a[0]), score(*a))
    query = np.arange(16, 24)
    got = tree.search(query, weights[query], 1, 10, None)
    assert [r[0] for r in sorted(got, reverse=True)] == np.sort(scores(tree, weights, query))[::-1][:10].tolist()
    leaves = sum(left < 0 for left, _ in tree.children)
    assert len(visited) < leaves / 3
