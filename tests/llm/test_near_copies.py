"""MinHash, cap filters, repeated passages: against plain versions over all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from pairforge.llm import cap_filters, minhash, substrings
from pairforge.llm.components import Joined, connected_components, spanning


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def words(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(400)) for _ in range(n)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    return roots(ids, links), sets


@pytest.fixture(scope="module")
def varied():
    """Groups of copies with a few words changed, short texts, odd texts."""
    rng = random.Random(4)
    rows, n = [], 0
    for size in (1, 2, 3, 30):
        for length in (6, 40, 300):
            base = words(rng, length)
            for _ in range(size):
                copy = list(base)
                for _ in range(rng.randrange(0, 1 + length // 60)):
                    copy[rng.randrange(length)] = "changed"
                rows.append((n, " ".join(copy)))
                n += 1
    odd = ["", None, "  \t\n", "one", "ONE", "one two three", "one two three", "Eins zwei drei vier fünf", "w " * 30_000]
    odd += ["w " * 20_000, "long " + "x" * 50_000, "a b c d e f", "A  B\nC d e F", "a b c d e f g"]
    return rows + [(n + i, t) for i, t in enumerate(odd)]


@pytest.mark.parametrize("block", [128, 8])
def test_minhash_finds_the_components_of_all_pairs(documents, varied, block):
    got = minhash.near_copies(documents(varied), block=block).collect()
    want, sets = plain_components(varied)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_gives_every_row_of_a_repeated_or_null_id_a_result(documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z y x w v u"), (7, None), (7, "q")]
    got = sorted(minhash.near_copies(documents(rows)).drop("row").collect(), key=str)
    assert len(got) == 6
    assert sum(r.component_id == 1 for r in got) == 3
    assert [r.kept for r in got if r.doc_id is None and r.component_id is None] == [True]
    assert [r.kept for r in got if r.doc_id is None and r.component_id == 1] == [False]


def test_minhash_of_an_empty_table(documents):
    assert minhash.near_copies(documents([])).collect() == []


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**63, 4000, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            n = int(4000 * (1 - share) / 2 / share * share)
            one, two = np.unique(both[n:]), np.unique(both[:-n])
            true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
            value, used = minhash.estimate(minhash.sketch(one)[None], minhash.sketch(two)[None])
            assert used[0] == minhash.REGISTERS
            errors.append(value[0] - true)
        assert abs(np.mean(errors)) < 0.03
        assert np.abs(errors).max() < 5 * np.sqrt(0.25 / minhash.REGISTERS)


def test_a_sketch_keeps_zeros_and_mantissa_of_the_least_hash():
    h = np.array([(3 << 57) | (1 << 50) | (5 << 40), (3 << 57) | (1 << 55)], np.uint64)
    out = minhash.sketch(np.sort(h))
    assert (out != minhash.EMPTY).sum() == 1
    assert out[3] == (6 << minhash.MANTISSA | 5)


# --- components ------------------------------------------------------------------


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(1, 2), (2, 3), (3, 1), (9, 9)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e} - {9}
    assert got == {n: r for n, r in roots(nodes, [e for e in edges if e[0] != e[1]]).items()}


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_spanning_forests_keep_connectivity():
    rng = np.random.default_rng(1)
    links = rng.random((60, 60)) < 0.03
    dense = rng.random((60, 60)) < 0.5
    for m in (links, dense):
        pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(m | m.T, 1)), strict=True)]
        found = spanning(m)
        assert len(found) < 60
        assert roots(range(60), found) == roots(range(60), pairs)
    joined = Joined()
    for a, b in [(5, 3), (3, 9), (9, 5), (1, 2)]:
        joined.join(a, b)
    assert joined.take() == [(5, 3), (3, 9), (1, 2)] and joined.take() == []


# --- embeddings ------------------------------------------------------------------


def vector_rows(seed=2, dims=24):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for size, spread in ((1, 0), (40, 0.02), (25, 0.3), (12, 0.0), (60, 5.0), (30, 0.25)):
        base = rng.standard_normal(dims)
        for _ in range(size):
            vector = (base + spread * rng.standard_normal(dims) / np.sqrt(dims)).astype(np.float32)
            rows.append((n, vector.tolist(), int(n % 2)))
            n += 1
    odd = [None, [], [0.0] * dims, [1.0, None] + [0.0] * (dims - 2), [float("nan")] * dims, [float("inf")] * dims]
    odd += [rows[1][1], rows[1][1][:5], [v * 1e-30 for v in rows[1][1]], rows[1][1]]
    for i, v in enumerate(odd):
        rows.append((n + i, v, None if i == len(odd) - 1 else 1))
    return rows


def plain_links(rows, similar=0.93):
    units = {}
    for i, v, label in rows:
        if label is None or not v or None in v or not np.isfinite(v).all() or not np.any(v):
            continue
        x = np.array(v, np.float64) / np.abs(v).max()
        units[i] = (label, len(v), x / np.linalg.norm(x))
    ids = sorted(units)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if units[a][:2] == units[b][:2] and units[a][2] @ units[b][2] >= similar
    ]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return roots([r[0] for r in rows], links), count


@pytest.mark.parametrize("block", [128, 8])
def test_cap_filters_find_the_links_of_all_pairs(spark, block):
    rows = vector_rows()
    table = spark.createDataFrame(
        [(*r, 9, "c", 0.5) for r in rows],
        "vec_id long, embedding array<float>, label int, cap long, node string, place double",
    ).repartition(3)
    got = cap_filters.near_copies(table, block=block).collect()
    components, count = plain_links(rows)
    assert {r.vec_id: r.component_id for r in got} == components
    assert {r.vec_id: r.n_links for r in got} == {r[0]: count[r[0]] for r in rows}


def test_cap_filters_meet_nearly_all_close_pairs():
    rng = np.random.default_rng(8)
    for codes in (64, 256):
        x = rng.standard_normal((1500, 48))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.standard_normal(x.shape)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        met = [bool(np.intersect1d(a, b).size) for a, b in zip(cap_filters.decode(x, codes), cap_filters.decode(y, codes), strict=True)]
        assert np.mean(met) >= 0.99


def test_decoding_lists_all_caps_above_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = cap_filters.decode(x)
    for r in range(cap_filters.ROTATIONS):
        turn, places, books, threshold = cap_filters._code(16, cap_filters.CODES, r)
        for unit, caps in zip(x @ turn, found, strict=True):
            sums = (books[0] @ unit[places[0]])[:, None] + (books[1] @ unit[places[1]])[None, :]
            above = set(np.flatnonzero(sums.ravel() >= threshold) + r * cap_filters.CODES**2)
            mine = {c for c in caps.tolist() if c // cap_filters.CODES**2 == r}
            assert above <= mine and mine


def test_embeddings_empty_table_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert cap_filters.near_copies(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [0.0, 1.0], 1)]
    got = cap_filters.near_copies(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id is None, r.n_links, r.component_id, r.kept) for r in got) == [
        (False, 0, 5, True), (False, 2, 1, True), (False, 2, 1, True), (True, 2, 1, False)
    ]


# --- repeated passages -----------------------------------------------------------


def plain_spans(rows, least_words):
    """The same rule over all windows in rank order, for unique ids."""
    first, later = {}, defaultdict(list)
    for i, text in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        for unit, start, end, word, n in substrings.windows(text):
            if unit not in first:
                first[unit] = (i, start, end)
                continue
            j, _, kept_end = first[unit]
            begin = max(start, kept_end) if i == j else start
            if begin < end:
                later[i].append((begin, end, word, word + n))
    out = set()
    for i, found in later.items():
        run = None
        for begin, end, word, last in sorted(found):
            if run and begin <= run[1] + 2:
                run = [run[0], max(run[1], end), min(run[2], word), max(run[3], last)]
                continue
            if run and run[3] - run[2] >= least_words:
                out.add((i, run[0], run[1]))
            run = [begin, end, word, last]
        if run and run[3] - run[2] >= least_words:
            out.add((i, run[0], run[1]))
    return out


def prose(rng, n):
    out = []
    while len(out) < n:
        sentence = words(rng, rng.randrange(3, 12))
        sentence[0] = sentence[0].capitalize()
        sentence[-1] += "."
        out += sentence
    return " ".join(out)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(9)
    shared = [prose(rng, 70), prose(rng, 90).replace(". ", " "), prose(rng, 60)]
    rows = []
    for i in range(40):
        text = prose(rng, 120)
        if i % 4 == 0:
            at = text.index(" ", len(text) // 2)  # in the middle of a sentence
            text = text[:at] + " " + shared[(i // 4) % 3] + text[at:]
        rows.append((i, text + ("\n" + prose(rng, 30)) * 2))
    rows += [(100, ""), (101, None), (102, "a"), (103, "Same. " * 400), (104, "x" * 9000), (105, "ab " * 9000)]
    return shared, rows


def test_repeated_spans_equal_the_plain_rule(documents, passages):
    _, rows = passages
    got = substrings.repeated_spans(documents(rows)).collect()
    assert {(r.doc_id, r.start, r.end) for r in got} == plain_spans(rows, substrings.LEAST_WORDS)


def test_pasted_passages_are_nearly_all_covered(documents, passages):
    shared, rows = passages
    texts = dict(rows)
    got = defaultdict(list)
    for r in substrings.repeated_spans(documents(rows)).collect():
        assert r.kept_doc_id < r.doc_id or r.kept_start < r.start
        if r.kept_doc_id != r.doc_id:
            got[r.doc_id].append((r.start, r.end))
    for i in range(12, 40, 4):
        passage = shared[(i // 4) % 3]
        begin = texts[i].index(passage)
        inside = sum(min(e, begin + len(passage)) - max(s, begin) for s, e in got[i] if s < begin + len(passage) and e > begin)
        assert inside >= 0.6 * len(passage)
    assert not {i for i in got if i < 100} & {i for i in range(40) if i % 4}


def test_removing_spans_keeps_the_rest(documents, passages):
    _, rows = passages
    clean = {r.doc_id: r for r in substrings.without_repeats(documents(rows)).collect()}
    spans = defaultdict(list)
    for i, start, end in plain_spans(rows, substrings.LEAST_WORDS):
        spans[i].append((start, end))
    assert len(clean) == len(rows)
    for i, text in rows:
        assert clean[i].text == substrings.remove(text, spans[i])
        assert clean[i].source == "s"


def test_repeated_rows_and_null_ids(documents):
    text = prose(random.Random(1), 80)
    got = substrings.repeated_spans(documents([(3, text), (3, text), (None, text)], parts=1)).collect()
    assert sorted((str(r.doc_id), r.kept_doc_id) for r in got) == [("3", 3), ("None", 3)]
    assert substrings.repeated_spans(documents([])).collect() == []
