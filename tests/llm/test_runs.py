"""Periodic runs against a search over all periods."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairforge.llm import runs
from pairforge.llm.queries import _planted


def plain(words, exponent=4):
    """Every run as (start, length, period), by trying every period at every place."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in out.items() if e - s >= exponent * q)


def found(sequences, exponent=4):
    codes, starts, used = [], [], 0
    for words in sequences:
        numbers = {}
        starts.append(len(codes))
        codes += [numbers.setdefault(w, len(numbers)) + used for w in words]
        used += len(numbers)
    out = [[] for _ in sequences]
    for i, *run in runs.find_runs(np.array(codes, np.int64), np.array(starts, np.int64), exponent).tolist():
        out[i].append(tuple(run))
    return out


def repetitive(rng):
    words = []
    for _ in range(rng.randrange(1, 5)):
        size = rng.choice([1, 1, 2, 2, 3, 5])
        base = [rng.randrange(size) for _ in range(rng.randrange(1, rng.choice([4, 10, 30])))]
        if rng.random() < 0.4:
            base = base * rng.randrange(1, 6) + [rng.randrange(size) for _ in range(rng.randrange(4))]
        words += base * rng.randrange(1, 7) + base[: rng.randrange(len(base))]
    return words


@pytest.mark.parametrize("seed", range(25))
def test_runs_of_repetitive_sequences(seed):
    rng = random.Random(seed)
    sequences = [repetitive(rng) for _ in range(40)]
    assert found(sequences) == [plain(s) for s in sequences]
    assert found(sequences, 6) == [plain(s, 6) for s in sequences]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=1, max_size=80), min_size=1, max_size=4))
def test_runs_of_two_words(sequences):
    assert found(sequences) == [plain(s) for s in sequences]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_long_structured_sequences():
    shapes = [[0] * 5000, fibonacci(3000), [0, 1] * 2000 + [2], ([0] * 7 + [1]) * 300, (fibonacci(55) + [3]) * 9 + fibonacci(40)]
    rng = random.Random(0)
    shapes.append([rng.randrange(9) for _ in range(400)] * 5 + [9] * 6 + [1] * 5)
    assert found(shapes) == [plain(s) for s in shapes]


def test_fewer_than_four_periods_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(9, np.int64), np.zeros(1, np.int64), 3)


def test_range_successor():
    rng = np.random.default_rng(2)
    for n in (1, 2, 63, 64, 65, 1000):
        values = rng.permutation(n)
        tree = runs.Wavelet(values)
        low = rng.integers(0, n, 200)
        high = rng.integers(low, n + 1)
        least = rng.integers(0, n + 2, 200)
        got = tree.successor(low, high, least)
        want = [min([v for v in values[a:b] if v >= c], default=n) for a, b, c in zip(low, high, least, strict=True)]
        assert got.tolist() == want


def strongest(found):
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def planted(i, text):
    words = (text or "").split()
    if words and (at := _planted(i, len(words))):
        a, p = at
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    return words


def test_documents_against_the_plain_search(spark, documents):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab cd e f".split()) for _ in range(rng.randrange(150)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "x " * 3000), (504, "ab " * 5), (504, "ab " * 5), (None, "z " * 9), (505, "é\nü " * 7)]
    got = runs.detect(documents(rows), _planted).collect()
    want = []
    for i, text in rows:
        words = planted(i, text)
        mine = plain(words)
        best = strongest(mine) if mine else (None,) * 3
        gone = {p for s, n, q in mine for p in range(s + q, s + n)}
        want.append(
            {
                "doc_id": i, "n_runs": len(mine), "start": best[0], "length": best[1], "period": best[2],
                "exponent_milli": 1000 * best[1] // best[2] if mine else None,
                "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in mine).encode()).hexdigest(),
                "collapsed_sha256": hashlib.sha256(" ".join(w for p, w in enumerate(words) if p not in gone).encode()).hexdigest(),
            }
        )
    assert sorted(str(r.asDict()) for r in got) == sorted(map(str, want))
    listed = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.length, r.period) for r in runs.list_runs(documents(rows)).collect())
    assert listed == sorted((-1 if i is None else i, *r) for i, t in rows for r in plain((t or "").split()))


def test_collapsing_keeps_other_texts_and_columns(spark, documents):
    rows = [(1, "a b  c\nd"), (2, "go " * 9 + "now"), (3, None), (4, "x y " * 4 + "x z")]
    out = runs.collapse(documents(rows))
    assert out.columns == [*documents([]).columns, "n_runs"]
    got = {r.doc_id: (r.text, r.n_runs, r.term) for r in out.collect()}
    assert got == {1: ("a b  c\nd", 0, "x"), 2: ("go now", 1, "x"), 3: (None, 0, "x"), 4: ("x y z", 1, "x")}


def test_empty_table(spark, documents):
    assert runs.detect(documents([])).collect() == [] and runs.collapse(documents([])).collect() == []
