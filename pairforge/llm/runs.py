"""Stretches of words that repeat with a period, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart are equal)
and at least ``EXPONENT`` periods and ``LEAST_WORDS`` words, which no neighbouring word
extends. The sequences of a batch are laid one after the other, and

1. words that cannot be in a run are left out: those that stand fewer than four times
   in their stretch of remaining words, and stretches that are too short;
2. a suffix array of the rest is made by doubling. On the way every dyadic block (length
   b, a power of two, at a multiple of b) gets the interval of suffixes that begin with it;
3. a run of period b <= q < 2b holds such a block together with its copy q words on. So
   each block asks for its occurrences in the neighbouring window, b to 2b words on, by
   range successor in a wavelet tree over the suffix array;
4. two occurrences at most b / 2 apart tell that the block has that period itself, and
   that its occurrences form a progression: the only candidate from it is the distance
   between the end of the progression's stretch and that of the block's own. Every other
   occurrence gives its distance as a candidate;
5. candidates are extended by at most five periods to either side; overlapping results
   of one period are one run. Those with a divisor of their period as a period go.

All steps but the hashing of results work on whole arrays, and all memory is in
proportion to the words of a batch: some 4 MB of text, or one longer text.

Null texts have no words; texts without words have no runs. Rows do not meet, so null and
repeated ids are no special case and nothing is shuffled. Further columns are left out
by ``detect`` and ``list_runs``, and kept by ``collapse``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import added, slices, utf8, with_columns
from pairforge.llm.token_grammar import ragged

EXPONENT = 4  # periods in a run, at least; the method needs four
LEAST_WORDS = 6
QUERIES_AT_ONCE = 1 << 19  # blocks looked up in one step


# --- wavelet tree -----------------------------------------------------------------------


class Wavelet:
    """Bit planes of a permutation, with the number of ones before every 64 bits."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.bits = max(1, self.n.bit_length())
        self.planes: list[tuple[np.ndarray, np.ndarray, int]] = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1]]).astype(np.int32)
            zeros = int(self.n - ones.sum())
            self.planes.append((packed, before, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(plane: tuple[np.ndarray, np.ndarray, int], at: np.ndarray) -> np.ndarray:
        packed, before, _ = plane
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(packed[at >> 6] & mask)

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest value >= ``least`` among ``values[low:high]``; ``n`` where there is none."""
        least = np.minimum(least, self.n)
        l, r, below = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for level, plane in enumerate(self.planes):
            ol, orr = self._ones(plane, l), self._ones(plane, r)
            one = (least >> self.bits - 1 - level & 1).astype(bool)
            below += np.where(one, (r - orr) - (l - ol), 0)
            l, r = np.where(one, plane[2] + ol, l - ol), np.where(one, plane[2] + orr, r - orr)
        out = np.full(len(low), self.n, np.int64)
        there = np.flatnonzero(below < high - low)
        l, r, k = low[there], high[there], below[there]
        value = np.zeros(len(there), np.int64)
        for level, plane in enumerate(self.planes):
            ol, orr = self._ones(plane, l), self._ones(plane, r)
            zeros = (r - orr) - (l - ol)
            one = k >= zeros
            k = np.where(one, k - zeros, k)
            value |= one.astype(np.int64) << self.bits - 1 - level
            l, r = np.where(one, plane[2] + ol, l - ol), np.where(one, plane[2] + orr, r - orr)
        out[there] = value
        return out


# --- blocks ----------------------------------------------------------------------------


def _pruned(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, code, stretch) of the words that may be in runs. Any number of rounds is right."""
    first = np.zeros(len(codes) + 1, bool)
    first[starts] = True
    place, stretch = np.arange(len(codes)), None
    for _ in range(6):
        before = len(place)
        if not before:
            break
        place = place[np.bincount(codes)[codes] >= EXPONENT] if stretch is None else place[np.bincount(inner)[inner] >= EXPONENT]
        cut = first[place] | (np.diff(place, prepend=-2) != 1)
        stretch = np.cumsum(cut) - 1
        long = (np.bincount(stretch) >= LEAST_WORDS)[stretch] if len(place) else np.zeros(0, bool)
        place, stretch = place[long], stretch[long]
        inner = np.unique(stretch << 32 | codes[place], return_inverse=True)[1]
        if len(place) > 0.95 * before:
            break
    if not len(place):
        return place, place, place
    return place, inner, np.cumsum(np.diff(stretch, prepend=-1) != 0) - 1


def _blocks(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``x``, and rows (place, length, low, high) of dyadic blocks.

    ``begin`` and ``end`` bound each place's stretch. Low and high bound the suffixes that
    begin with the block. Blocks that stand fewer than three times are left out, because
    a run of four periods holds its first block three times.
    """
    n = len(x)
    counts = np.bincount(x)
    rank = (np.cumsum(counts) - counts)[x]
    size = counts[x]
    order = np.argsort(x, kind="stable")
    found = []
    longest = int((end - begin).max()) // EXPONENT
    b = 1
    while b <= longest:
        at = np.flatnonzero((size >= 3) & ((np.arange(n) - begin) % b == 0) & (np.arange(n) + b <= end))
        found.append(np.stack([at, np.full(len(at), b), rank[at], rank[at] + size[at]]))
        slots = np.flatnonzero(size[order] >= 2)
        if not len(slots):
            break
        of = order[slots]
        inside = of + b < end[of]
        key = rank[of] * (n + 1) + np.where(inside, rank[np.minimum(of + b, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        of, key = of[by], key[by]
        order[slots] = of
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(key)]]))
        rank[of], size[of] = np.repeat(slots[heads], sizes), np.repeat(sizes, sizes)
        b *= 2
    return order, np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)


def _first_change(x: np.ndarray, end: np.ndarray, at: np.ndarray, period: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Smallest t >= ``at`` where the word ``period`` on differs or lies outside; -1 if not ``within`` so many."""
    lengths = np.clip(end[at] - period - at, 0, within)
    out = np.where(end[at] - period - at < within, at + lengths, -1)
    places = ragged(at, lengths)
    differs = np.flatnonzero(x[places] != x[places + np.repeat(period, lengths)])
    heads = np.cumsum(lengths) - lengths
    first = np.searchsorted(differs, heads)
    some = np.flatnonzero(first < len(differs))
    some = some[differs[first[some]] < heads[some] + lengths[some]]
    out[some] = at[some] + differs[first[some]] - heads[some]
    return out


def _last_change(x: np.ndarray, begin: np.ndarray, at: np.ndarray, period: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Largest t < ``at`` where the word ``period`` on differs, at most ``within`` before; else the last t not looked at."""
    lengths = np.minimum(at - begin[at], within)
    out = at - lengths - 1
    places = ragged(at - lengths, lengths)
    differs = np.flatnonzero(x[places] != x[places + np.repeat(period, lengths)])
    tails = np.cumsum(lengths)
    last = np.searchsorted(differs, tails) - 1
    some = np.flatnonzero(last >= 0)
    some = some[differs[last[some]] >= tails[some] - lengths[some]]
    out[some] = at[some] + differs[last[some]] - tails[some]
    return out


def _in_steps(weight: np.ndarray) -> Iterator[slice]:
    """Slices of about ``QUERIES_AT_ONCE`` of weight, one item at least."""
    steps = np.cumsum(weight) // QUERIES_AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), len(weight)]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield slice(a, b)


def _candidates(tree: Wavelet, x: np.ndarray, end: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) pairs worth looking at."""
    at, b, low, high = blocks
    near = tree.successor(low, high, at + b)
    while True:
        alive = near < np.minimum(at + 2 * b, tree.n)
        at, b, low, high, near = at[alive], b[alive], low[alive], high[alive], near[alive]
        if not len(at):
            return
        further = tree.successor(low, high, near + 1)
        gap = further - near
        chain = (further < np.minimum(at + 2 * b, tree.n)) & (2 * gap <= b)
        yield at[~chain], (near - at)[~chain]
        if chain.any():
            c = np.flatnonzero(chain)
            for part in _in_steps(8 * b[c]):
                k = c[part]
                own = _first_change(x, end, at[k], gap[k], 4 * b[k])
                other = _first_change(x, end, near[k], gap[k], 4 * b[k])
                period = other - own
                good = (own >= 0) & (other >= 0) & (period >= b[k]) & (period < 2 * b[k])
                yield at[k][good], period[good]
                # The progression's last member; without an end in sight it covers the window.
                last = near[k] + (other + gap[k] - b[k] - near[k]) // gap[k] * gap[k]
                further[k] = np.where(other >= 0, tree.successor(low[k], high[k], last + 1), tree.n)
        near = further


def _smallest(x: np.ndarray, left: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether no divisor of the period is a period as well. ``period`` is in ascending order."""
    out = np.ones(len(left), bool)
    heads = np.flatnonzero(np.diff(period, prepend=-1))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(period)], strict=True):
        whole = rest = int(period[a])
        places = left[a:b, None] + np.arange(whole)
        factor = 2
        while rest > 1:
            if factor * factor > rest:
                factor = rest
            if rest % factor == 0:
                out[a:b] &= (x[places] != x[places + whole // factor]).any(1)
                while rest % factor == 0:
                    rest //= factor
            factor += 1
    return out


def find_runs(codes: np.ndarray, starts: np.ndarray, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (sequence, start, length, period) of all runs, in this order.

    ``codes`` holds the words of all sequences as numbers that no two sequences share;
    ``starts`` says where each sequence begins.
    """
    nothing = np.zeros((0, 4), np.int64)
    if exponent < EXPONENT:
        raise ValueError("the method needs four periods")
    place, x, stretch = _pruned(codes, starts)
    if not len(place):
        return nothing
    sizes = np.bincount(stretch)
    begin = (np.cumsum(sizes) - sizes)[stretch]
    end = begin + sizes[stretch]
    order, blocks = _blocks(x, begin, end)
    if not blocks.size:
        return nothing
    tree = Wavelet(order)
    pieces: list[np.ndarray] = []
    for part in _in_steps(np.ones(blocks.shape[1], np.int64)):
        for at, period in _candidates(tree, x, end, blocks[:, part]):
            for step in _in_steps(9 * period):
                a, d = at[step], period[step]
                left = _last_change(x, begin, a, d, EXPONENT * d) + 1
                change = _first_change(x, end, a, d, (EXPONENT + 1) * d)
                right = np.where(change >= 0, change, a + (EXPONENT + 1) * d) + d
                long = right - left >= np.maximum(LEAST_WORDS, EXPONENT * d)
                pieces.append(np.stack([d, left, right], 1)[long])
    found = np.concatenate(pieces) if pieces else np.zeros((0, 3), np.int64)
    if not len(found):
        return nothing
    period, left, right = found[np.lexsort((found[:, 1], found[:, 0]))].T
    # Pieces of one period that share a period's words belong together.
    apart = np.int64(len(x) + 1)
    group = np.cumsum(np.diff(period, prepend=-1) != 0)
    reach = np.maximum.accumulate(group * apart + right)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (group[1:] * apart + left[1:] > reach[:-1] - period[1:])])
    heads = np.flatnonzero(new)
    left, right, period = left[heads], np.maximum.reduceat(right, heads), period[heads]
    long = right - left >= np.maximum(LEAST_WORDS, exponent * period)
    left, right, period = left[long], right[long], period[long]
    smallest = _smallest(x, left, period)
    left, right, period = left[smallest], right[smallest], period[smallest]
    own = place[left]
    sequence = np.searchsorted(starts, own, side="right") - 1
    runs = np.stack([sequence, own - starts[sequence], right - left, period], 1)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


# --- documents -------------------------------------------------------------------------

Plant = Callable[[int | None, int], tuple[int, int] | None]


def _sequences(texts: list[bytes], ids: list, plant: Plant | None) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of all texts, their numbers, and where each text's begin."""
    every, codes, starts = [], [], [0]
    used = 0
    for text, doc_id in zip(texts, ids, strict=True):
        words = text.split()  # at the six white-space bytes of ASCII
        if plant and words and (planted := plant(doc_id, len(words))):
            a, p = planted
            words = words[:a] + [words[a + i % p] for i in range(len(words) - a)]
        numbers: dict[bytes, int] = {}
        codes.append(np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, len(words)) + used)
        used += len(numbers)
        every.append(words)
        starts.append(starts[-1] + len(words))
    return every, np.concatenate(codes) if codes else np.zeros(0, np.int64), np.array(starts[:-1], np.int64)


def _kept(words: list[bytes], runs: list[list[int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(change).tolist(), strict=False) if not inside]


def _strongest(runs: list[list[int]]) -> list[int]:
    """The run of the greatest length / period, compared exactly; then the smallest start and period."""
    def order(a, b):
        return b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2]

    return min(runs, key=cmp_to_key(order))


def _analysed(batch: pa.RecordBatch, doc_id: str, text: str, plant: Plant | None, exponent: int) -> Iterator[tuple]:
    """(words, runs as [start, length, period]) of every row."""
    ids = batch.column(batch.schema.get_field_index(doc_id)).to_pylist()
    texts = utf8(batch.column(batch.schema.get_field_index(text))).to_pylist()
    every, codes, starts = _sequences(texts, ids, plant)
    # Texts without words begin where the next one does; no run may be taken for theirs.
    some = np.array([i for i, words in enumerate(every) if words], np.int64)
    runs = find_runs(codes, starts[some], exponent)
    of: dict[int, list[list[int]]] = {}
    for sequence, *run in runs.tolist():
        of.setdefault(int(some[sequence]), []).append(run)
    for i, words in enumerate(every):
        yield words, of.get(i, [])


DETECTED = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string,"
    " collapsed_sha256 string"
)


def detect(docs: DataFrame, plant: Plant | None = None, exponent: int = EXPONENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the number of runs, the strongest one, and digests.

    ``plant`` may change words first: for (doc_id, number of words) it names a place and a
    period, from which on the words of the first period are repeated.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            rows = []
            for words, runs in _analysed(batch, "doc_id", "text", plant, exponent):
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                best = _strongest(runs) if runs else None
                rows.append(
                    (
                        len(runs),
                        *(best or (None, None, None)),
                        1000 * best[1] // best[2] if best else None,
                        hashlib.sha256(listed.encode()).hexdigest(),
                        hashlib.sha256(b" ".join(_kept(words, runs))).hexdigest(),
                    )
                )
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [f.split()[0] for f in DETECTED.split(",")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DETECTED)


def list_runs(docs: DataFrame, plant: Plant | None = None, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, start, length, period): one row for each run of every document."""

    def run(batches):
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_pylist()
            rows = [(i, *r) for i, (_, runs) in zip(ids, _analysed(batch, "doc_id", "text", plant, exponent), strict=True) for r in runs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "length", "period"]
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, text: str = "text", exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with every run cut down to its first period, and ``n_runs``.

    Texts with a run are joined anew, with one space between words; all others stay as they are.
    """

    def run(batches):
        for batch in slices(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            new, counts = column.to_pylist(), []
            for i, (words, runs) in enumerate(_analysed(batch, text, text, None, exponent)):
                if runs:
                    new[i] = b" ".join(_kept(words, runs)).decode("utf-8", "replace")
                counts.append(len(runs))
            yield with_columns(batch, {text: pa.array(new, pa.string()), "n_runs": pa.array(counts, pa.int64())})

    fields = added(docs, f"`{text}` string, n_runs long") if text not in docs.columns else added(docs, "n_runs long")
    order = [n for n in docs.columns if n != "n_runs"] + ["n_runs"]
    return docs.select(*[n for n in docs.columns if n != "n_runs"]).mapInArrow(
        lambda batches: (b.select(order) for b in run(batches)), fields
    )
