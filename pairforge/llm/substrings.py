"""Passages that occur more than once: all but the earliest occurrence go.

``repeated_passages`` finds every one. Of each run of 25 words the seed of 8 words with the
least hash is picked, so equal runs pick equal seeds; about one seed in ten words is
stored. Runs that follow each other and pick the same seed are a block. Blocks whose seed occurs
twice, and no others, are then grouped by a 96-bit digest; where one seed is in different blocks,
the runs of one block of each kind are too. So the result is that of comparing all runs of
all texts. Digests are made from 64-bit hashes of the words. Texts equal to the byte are compared once. Runs are laid together by word numbers. A whole line that stands earlier
is repeated at any length, so headings, footers and short texts count too.

``repeated_spans`` is the older, coarser way over units; it may leave the ends of a passage, or a short
one, where it is. A text is cut into units: lines, and inside them groups of sentences. A sentence
begins after ``.!?`` or at a capitalised word, so that a passage pasted into another
sentence begins one, and opens a unit if a hash picks its first word; long units are
cut further before words picked alike. Such cuts depend on the words beside them
only, so parts that two texts share are cut alike. Units are normalised by case and white space. Each unit opens a window, the units from it
on until they hold ``WINDOW_WORDS`` words, and windows are grouped by a 96-bit
digest over all texts. Of equal windows the earliest by (doc_id, row, place) is kept.
The others are laid together into spans of the original text, and spans of fewer
than ``LEAST_WORDS`` words stay.

Minima are combined before the shuffle and windows find theirs by a join that
adaptive execution may split, so one very common line is no hot task. Offsets count
code points, ends are exclusive. Null and empty texts have no units; rows with a
null id rank last; repeated rows rank by their place in the input.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.common import slices
from pairforge.llm.minhash import _mix
from pairforge.llm.token_grammar import ragged
from pairforge.runtime import durable, forget

WINDOW_WORDS = 8
SEED_WORDS = 8
LEAST_LINE_WORDS = 1  # a whole line that stands earlier is repeated from so many words on
LEAST_WORDS = 25
OPENING_WORDS = 2  # one first word in so many lets a sentence open a unit
LONG_UNIT = 25  # longer units are cut further
PIECE_WORDS = 9  # one word in so many opens a piece of a long unit
SUMMED = 1 << 14  # words hashed at once

# The look-behinds let a run of white space be tried at its first character only.
_WORD = re.compile(r"\S+")
_CUT = re.compile(r"\n|(?<=[.!?])\s++|(?<!\s)\s++(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])")

WINDOWS = T.StructType(
    [
        T.StructField("high", T.LongType()),
        T.StructField("low", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("word", T.IntegerType()),
        T.StructField("words", T.IntegerType()),
    ]
)


def _opens(word: str, one_in: int) -> bool:
    return zlib.crc32(word.lower().encode()) % one_in == 0


def _cuts(text: str) -> list[int]:
    """Places where a unit may begin: lines, and sentences whose first word a hash picks."""
    places = [0]
    for m in _CUT.finditer(text):
        if m[0] == "\n":
            places.append(m.end())
        else:
            word = _WORD.match(text, m.end())
            if word is None or _opens(word[0], OPENING_WORDS):
                places.append(m.end())
    return places


def units(text: str) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, normalised text, words) of every unit that holds a word.

    Long units are cut further before words that a hash picks, so that parts two
    texts share are cut alike wherever they stand.
    """
    places = _cuts(text)
    for at, following in zip(places, [*places[1:], len(text)], strict=True):
        words = text[at:following].split()
        if not words:
            continue
        if len(words) <= LONG_UNIT:
            start, end = at, following
            while text[start].isspace():
                start += 1
            while text[end - 1].isspace():
                end -= 1
            yield start, end, " ".join(words).lower(), len(words)
            continue
        held: list[str] = []
        for m in _WORD.finditer(text, at, following):
            if not held or _opens(m[0], PIECE_WORDS):
                if held:
                    yield first, last, " ".join(held).lower(), len(held)
                first, held = m.start(), []
            held.append(m[0])
            last = m.end()
        yield first, last, " ".join(held).lower(), len(held)


def windows(text: str, least: int = WINDOW_WORDS) -> Iterator[tuple[str, int, int, int, int]]:
    """(normalised text, start, end, first word, words); the last units may open none."""
    found = list(units(text))
    first, last, held = 0, 0, 0
    for i, (start, _, _, n) in enumerate(found):
        while held < least and last < len(found):
            held += found[last][3]
            last += 1
        if held < least:
            return
        yield " ".join([u[2] for u in found[i:last]]), start, found[last - 1][1], first, held
        first += n
        held -= n


def window_table(docs: DataFrame, least: int = WINDOW_WORDS) -> DataFrame:
    """All windows of ``docs`` (doc_id, text), written so that ``row`` stays as it is."""
    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            columns: list[list] = [[] for _ in WINDOWS]
            high, low, ids, rows, starts, ends, firsts, counts = columns
            for doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                for unit, start, end, first, n in windows(text, least) if text else ():
                    digest = xxhash.xxh3_128_intdigest(unit)
                    high.append(digest >> 64)
                    low.append(digest & 0xFFFFFFFF)
                    ids.append(doc_id)
                    rows.append(row)
                    starts.append(start)
                    ends.append(end)
                    firsts.append(first)
                    counts.append(n)
                row += 1
            arrays = [
                pa.array(c, pa.uint64()).view(pa.int64())
                if i == 0
                else pa.array(c, pa.uint32()).view(pa.int32())
                if i == 1
                else pa.array(c, pa.int64() if i < 4 else pa.int32())
                for i, c in enumerate(columns)
            ]
            yield pa.RecordBatch.from_arrays(arrays, WINDOWS.names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return durable(rows.mapInArrow(run, WINDOWS), "windows")


def _rank() -> Column:
    """Where a window stands: null ids last, then by row and place."""
    last = F.lit(2**63 - 1)
    return F.struct(
        F.coalesce("doc_id", last).alias("rank"),
        F.col("row"),
        F.col("start"),
        F.col("end"),
        F.col("doc_id"),
        (F.col("word") + F.col("words")).alias("stop"),
    )


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(row, doc_id, start, end, n_words, kept_doc_id, kept_start): the spans to remove.

    ``kept_doc_id`` and ``kept_start`` say where the first window of the span is kept.
    """
    table = window_table(docs, window_words)
    # Only digests met twice are looked up, so the wide rows of the others go no further.
    twice = (
        table.groupBy("high", "low")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.bitwise_not("high").alias("_high"), F.bitwise_not("low").alias("_low"))
    )
    keyed = table.withColumns({"_high": F.bitwise_not("high"), "_low": F.bitwise_not("low")})
    copies = durable(keyed.join(twice, ["_high", "_low"]).drop("_high", "_low"), "windows")
    kept = (
        copies.groupBy("high", "low")
        .agg(F.min(_rank()).alias("kept"))
        .select(F.bitwise_not("high").alias("_high"), F.bitwise_not("low").alias("_low"), "kept")
    )
    later = (
        copies.withColumns({"_high": F.bitwise_not("high"), "_low": F.bitwise_not("low")})
        .join(kept, ["_high", "_low"])
        .filter(~((F.col("row") == F.col("kept.row")) & (F.col("start") == F.col("kept.start"))))
        # A window that overlaps the one kept in its own text leaves that one whole.
        .withColumn(
            "from",
            F.when(F.col("row") == F.col("kept.row"), F.greatest("start", "kept.end")).otherwise(F.col("start")),
        )
        .filter(F.col("from") < F.col("end"))
        .withColumn(
            "from_word",
            F.when(F.col("row") == F.col("kept.row"), F.greatest("word", "kept.stop")).otherwise(F.col("word")),
        )
    )
    by_row = Window.partitionBy("row").orderBy("from", "end")
    reach = F.max(F.col("word") + F.col("words")).over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    # Whatever white space lies between neighbouring units, their words are next to each other.
    opened = later.withColumn("_new", F.coalesce((F.col("from_word") > reach).cast("int"), F.lit(1)))
    spans = opened.withColumn("_span", F.sum("_new").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        spans.groupBy("row", "_span")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min("from").alias("start"),
            F.max("end").alias("end"),
            (F.max(F.col("word") + F.col("words")) - F.min("word")).cast("long").alias("n_words"),
            F.min(F.struct("from", "kept.doc_id", "kept.start")).alias("_first"),
        )
        .filter(F.col("n_words") >= least_words)
        .select(
            "row",
            "doc_id",
            F.col("start").cast("long").alias("start"),
            F.col("end").cast("long").alias("end"),
            "n_words",
            F.col("_first.doc_id").alias("kept_doc_id"),
            F.col("_first.start").cast("long").alias("kept_start"),
        )
    )


# --- every repeated passage, exactly ------------------------------------------------


# White space as ``str.split`` and ``\\s`` have it, by code point.
_SPACE = np.zeros(0x110000, bool)
_SPACE[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * np.uint64(0x9E3779B97F4A7C15)
    out += right
    return _mix(out)


def _run_hashes(h: np.ndarray, least: int) -> np.ndarray:
    """Hashes of all runs of ``least`` words, put together from runs of 1, 2, 4, ... words."""
    out, taken, size = None, 0, 1
    n = len(h) - least + 1
    while True:
        if least & size:
            part = h[taken : taken + n]
            out = part if out is None else _mixed(out, part)
            taken += size
        size *= 2
        if size > least:
            return out
        h = _mixed(h[: -size // 2], h[size // 2 :])


def _sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of ``values``, by the sum of what each value is mixed to at its place."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), SUMMED):
        start, n = starts[a : a + SUMMED], lengths[a : a + SUMMED]
        at = ragged(start, n)
        place = (at - np.repeat(start, n)).astype(np.uint64)
        place *= np.uint64(0xD6E8FEB86659FD93)
        out[a : a + SUMMED] = np.add.reduceat(_mixed(values[at].astype(np.uint64), place), np.cumsum(n) - n)
    return _mix(out)


class _Words:
    """The words of several texts, one after the other, as hashes.

    For each run of ``least`` words the seed of least hash inside it is picked, so equal runs pick equal seeds
    wherever they stand.
    """

    def __init__(self, texts: list[str], least: int) -> None:
        whole = "\n".join(texts)
        self.least = least
        codes, self.starts, self.ends = self.cut(whole)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.begins = np.cumsum(lengths) - lengths  # of the texts, in code points
        self.firsts = np.searchsorted(self.starts, self.begins)
        self.counts = np.diff(np.append(self.firsts, len(self.starts)))
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        # Lines that hold a word.
        self.line = np.unique(np.append(np.searchsorted(self.starts, np.flatnonzero(codes == 10)), 0))
        self.line = self.line[self.line < len(self.starts)]
        self.line_words = np.diff(np.append(self.line, len(self.starts)))
        lower = whole.lower()
        if len(lower) == len(whole):
            codes, starts, ends = np.frombuffer(lower.encode("utf-32-le"), "<u4"), self.starts, self.ends
        else:  # some letters become two
            codes, starts, ends = self.cut(lower)
        self.h = _sums(codes, starts, ends - starts)

    @staticmethod
    def cut(whole: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points, and where words start and end."""
        codes = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = ~_SPACE[codes]
        steps = np.diff(inside)
        return codes, np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)

    def lanes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of every word, the second drawn from the first."""
        return self.h, _mix(self.h ^ np.uint64(0xD1B54A32D192ED03))

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(seed, its first word, first run, runs) of all runs, one after the other, that pick the same seed."""
        k = min(SEED_WORDS, self.least)
        n = len(self.h) - self.least + 1
        if n < 1:
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none, none, none
        seeds = np.zeros(len(self.h) - k + 1, np.uint64)
        for j in range(k):
            seeds *= np.uint64(0x9E3779B97F4A7C15)
            seeds += self.h[j : j + len(seeds)]
        seeds = _mix(seeds)
        picked, value, size = np.arange(len(seeds)), seeds, 1
        while size < (wide := self.least - k + 1):
            step = min(size, wide - size)
            right = value[step:] < value[:-step]
            picked = np.where(right, picked[step:], picked[:-step])
            value = np.where(right, value[step:], value[:-step])
            size += step
        runs = np.flatnonzero(self.text[:n] == self.text[self.least - 1 :])
        if not len(runs):
            return seeds[:0], runs, runs, runs
        picked = picked[runs]
        edges = np.flatnonzero(np.diff(picked, prepend=-1))
        places = picked[edges]
        return seeds[places], places, runs[edges], np.diff(np.append(edges, len(runs)))


def _sorted_lists(text: np.ndarray, n: int, *columns: np.ndarray) -> list[pa.Array]:
    """Lists of the values of each of ``n`` texts."""
    order = np.argsort(text, kind="stable")
    offsets = pa.array(np.searchsorted(text[order], np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns]


FEATURES = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("seeds", T.ArrayType(T.LongType())),
        T.StructField("places", T.ArrayType(T.IntegerType())),
    ]
)

BLOCKS = T.StructType(
    [
        T.StructField("high", T.LongType()),
        T.StructField("low", T.IntegerType()),
        T.StructField("seed", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("word", T.IntegerType()),
        T.StructField("words", T.IntegerType()),  # of each run
        T.StructField("start", T.IntegerType()),
        # Of each run; starts and ends from the block's start.
        T.StructField("highs", T.ArrayType(T.LongType())),
        T.StructField("lows", T.ArrayType(T.IntegerType())),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
    ]
)


def _text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary"))).alias("key")


def _features(docs: DataFrame, least: int, least_line: int) -> DataFrame:
    """Seeds of every text that holds a word, written so that ``row`` stays as it is.

    Places are first words. A line too short for a run is a seed of its own, at -1 - first word.
    """

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            texts = batch.column(1).fill_null("").to_pylist()
            words = _Words(texts, least)
            seeds, places, _, _ = words.blocks()
            chosen = (words.line_words >= least_line) & (words.line_words < least)
            lines, sizes = words.line[chosen], words.line_words[chosen]
            at = np.concatenate([words.text[places], words.text[lines]])
            seeds = np.concatenate([seeds, _sums(words.h, lines, sizes)]).view(np.int64)
            first = words.firsts[at]
            places = np.concatenate([places, -1 - lines]) + np.where(np.arange(len(at)) < len(places), -first, first)
            lists = _sorted_lists(at, len(texts), seeds, places.astype(np.int32))
            held = np.flatnonzero(words.counts)
            first = words.firsts[held]
            start = words.starts[first] - words.begins[held]
            end = words.ends[first + words.counts[held] - 1] - words.begins[held]
            rows = pa.array(row + held)
            row += len(texts)
            numbers = [pa.array(x.astype(np.int32)) for x in (start, end, words.counts[held])]
            take = pa.array(held)
            doc_id, key = batch.column(0).take(take), batch.column(2).take(take)
            arrays = [rows, doc_id, key, *numbers, *[x.take(take) for x in lists]]
            yield pa.RecordBatch.from_arrays(arrays, FEATURES.names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key())
    return durable(rows.mapInArrow(run, FEATURES), "seeds")


def _block_table(texts: DataFrame, least: int) -> DataFrame:
    """Blocks whose seed is in ``places``, for texts (doc_id, row, text, places).

    A block is all runs of ``least`` words, one after the other, that pick the same seed. A line is a block of one run.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            words = _Words(batch.column(2).to_pylist(), least)
            flat = batch.column(3).flatten().to_numpy()
            first = np.repeat(words.firsts, batch.column(3).value_lengths().to_numpy())
            marked = np.zeros(len(words.h), bool)
            marked[(flat + first)[flat >= 0]] = True
            blocks = words.blocks()
            seeds, _, at, n_runs = (x[marked[blocks[1]]] for x in blocks)
            marked[:] = False
            marked[(first - 1 - flat)[flat < 0]] = True
            chosen = marked[words.line] & (words.line_words < least)
            lines, sizes = words.line[chosen], words.line_words[chosen]
            line_high, line_low = (_sums(x, lines, sizes) for x in words.lanes())
            # The first and the last run of a block hold all its words.
            lanes = [_run_hashes(x, least) if len(at) else x[:0] for x in words.lanes()]
            ends = [_mixed(_mixed(x[at], x[at + n_runs - 1]), n_runs.astype(np.uint64)) for x in lanes]
            inner = ragged(at, n_runs)
            n_runs = np.concatenate([n_runs, np.ones(len(lines), np.int64)])
            at, begin, stop = np.concatenate([at, lines]), np.concatenate([inner, lines]), np.concatenate([inner + least, lines + sizes])
            begin, stop = words.starts[begin], words.ends[stop - 1]
            start = words.starts[at]
            text = pa.array(words.text[at])
            high, low = (np.concatenate(x) for x in ((ends[0], line_high), (ends[1], line_low)))
            highs, lows = (np.concatenate([x[inner], y]) for x, y in zip(lanes, (line_high, line_low), strict=True))
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_runs)]).astype(np.int32))
            # Equal lines are equal blocks, so any number drawn from the line does for its seed.
            seeds = np.concatenate([seeds, line_high]).view(np.int64)
            size = np.concatenate([np.full(len(at) - len(lines), least), sizes])
            arrays = [high.view(np.int64), low.astype(np.uint32).view(np.int32), seeds]
            arrays += [batch.column(0).take(text), batch.column(1).take(text)]
            arrays += [x.astype(np.int32) for x in (at - words.firsts[words.text[at]], size, start - words.begins[words.text[at]])]
            lists = [highs.view(np.int64), lows.astype(np.uint32).view(np.int32)]
            lists += [(x - np.repeat(start, n_runs)).astype(np.int32) for x in (begin, stop)]
            arrays += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in arrays], BLOCKS.names)

    return durable(texts.select("doc_id", "row", "text", "places").mapInArrow(run, BLOCKS), "blocks")


def _kept(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks without their runs' digests, and (high, low, first, last, words, kept): for the blocks of a digest, where
    their runs ``first`` to ``last`` stand earliest.

    ``kept`` is the place of the run ``first``; the others stand there one word on each. Equal blocks hold equal runs, so the
    earliest stands for them, and runs are compared where one seed is in different blocks only.
    """
    # A seed is in different blocks if their digests differ anywhere.
    ranges = [f(c).alias(f"{n}_{c}") for c in ("high", "low") for n, f in (("least", F.min), ("most", F.max))]
    mixed = (
        blocks.groupBy("seed")
        .agg(*ranges)
        .filter("least_high <> most_high OR least_low <> most_low")
        .select(F.bitwise_not("seed").alias("_seed"), F.lit(True).alias("mixed"))
    )
    rank = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("rank")
    leads = (
        blocks.groupBy("high", "low")
        .agg(
            F.min(F.struct(rank, "row", "word", "doc_id", "start", "starts", "ends")).alias("lead"),
            *[F.first(c).alias(c) for c in ("seed", "words", "highs", "lows")],
        )
        .select("high", "low", F.bitwise_not("seed").alias("_seed"), "words", "highs", "lows", "lead.*")
    )
    leads = durable(leads.join(mixed, "_seed", "left").drop("_seed"), "leads")
    narrow = durable(blocks.drop("highs", "lows", "seed"), "narrow")
    forget(blocks)
    alone = leads.filter("mixed IS NULL").select(
        "high",
        "low",
        F.lit(0).alias("first"),
        (F.size("starts") - 1).alias("last"),
        "words",
        F.struct("row", "word", "start", (F.col("start") + F.col("ends")[0]).alias("end"), "doc_id").alias("kept"),
    )
    runs = (
        leads.filter("mixed")
        .select("*", F.posexplode(F.arrays_zip("highs", "lows", "starts", "ends")).alias("i", "run"))
        .select(
            "high",
            "low",
            "words",
            "i",
            F.col("run.highs").alias("run_high"),
            F.col("run.lows").alias("run_low"),
            F.struct(
                "rank",
                "row",
                (F.col("word") + F.col("i")).alias("word"),
                (F.col("start") + F.col("run.starts")).alias("start"),
                (F.col("start") + F.col("run.ends")).alias("end"),
                "doc_id",
            ).alias("place"),
        )
    )
    earliest = durable(runs.groupBy("run_high", "run_low").agg(F.min("place").alias("kept")), "earliest")
    keys = [F.bitwise_not(c).alias(f"_{c}") for c in ("run_high", "run_low")]
    parts = (
        runs.select("high", "low", "words", "i", *keys)
        .join(earliest.select(*keys, "kept"), ["_run_high", "_run_low"])
        # Runs that are kept one after the other go together. One between them that is kept elsewhere
        # is repeated as well, so it may be covered twice.
        .groupBy("high", "low", "words", F.col("kept.row"), (F.col("kept.word") - F.col("i")).alias("shift"))
        .agg(F.min(F.struct("i", "kept")).alias("begin"), F.max("i").alias("last"))
        .select(
            "high",
            "low",
            F.col("begin.i").alias("first"),
            "last",
            "words",
            F.struct(*[f"begin.kept.{c}" for c in ("row", "word", "start", "end", "doc_id")]).alias("kept"),
        )
    )
    kept = durable(alone.unionByName(parts), "kept")
    forget(earliest)
    forget(leads)
    return narrow, kept


def repeated_passages(
    docs: DataFrame, least_words: int = LEAST_WORDS, least_line_words: int = LEAST_LINE_WORDS
) -> DataFrame:
    """(row, doc_id, start, end, n_words, kept_doc_id, kept_start): every repeated passage, whole.

    A word is repeated if a run of ``least_words`` words around it stands earlier by
    (doc_id, row, place), or if its whole line (or whole text, equal to the byte) of
    ``least_line_words`` words or more does;
    repeated words side by side make a span. Where a text repeats itself with an overlap,
    the part that is kept stays whole. Equal short texts are equal lines.
    """
    found = _features(docs, least_words, least_line_words)
    # Equal texts are one class; its earliest text stands for it.
    last = F.lit(2**63 - 1)
    classes = durable(
        found.groupBy("key")
        .agg(
            F.min(F.struct(F.coalesce("doc_id", last).alias("rank"), "row", "doc_id")).alias("lead"),
            F.count(F.lit(1)).alias("copies"),
            F.first("seeds").alias("seeds"),
            F.first("places").alias("places"),
        )
        .select("key", "lead.row", "lead.doc_id", "copies", "seeds", "places"),
        "classes",
    )
    # Seeds are the bulk of both tables, so each goes as soon as it is read for the last time.
    rows = durable(found.drop("seeds", "places"), "rows")
    forget(found)
    # A class is named by its row until its places are together: no more is moved with each seed.
    seeds = classes.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        "row", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place")
    )
    twice = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = durable(
        seeds.select("row", "place", F.bitwise_not("seed").alias("_k"))
        .join(twice.select(F.bitwise_not("seed").alias("_k")), "_k")
        .groupBy("row")
        .agg(F.collect_list("place").alias("places"))
        .join(classes.select("key", "row", "doc_id"), "row"),
        "marked",
    )
    named = durable(classes.drop("seeds", "places"), "named")
    forget(classes)
    texts = docs.select(_text_key(), "text").filter("key IS NOT NULL").groupBy("key").agg(F.first("text").alias("text"))
    blocks, kept = _kept(_block_table(texts.join(marked, "key"), least_words))
    names = {c: F.bitwise_not(c).alias(f"_{c}") for c in ("high", "low")}
    own = F.col("row") == F.col("kept.row")
    word = F.col("word") + F.col("first")
    start = F.col("start") + F.col("starts")[F.col("first")]
    later = (
        blocks.select(*names.values(), "row", "doc_id", "word", "start", "starts", "ends")
        .join(kept.select(*names.values(), "first", "last", "words", "kept"), ["_high", "_low"])
        .filter(~(own & (word == F.col("kept.word"))))
        # A run that overlaps the one kept in its own text leaves that one whole.
        .select(
            "row",
            "doc_id",
            F.when(own, F.greatest(word, F.col("kept.word") + F.col("words"))).otherwise(word).alias("word"),
            (F.col("word") + F.col("last") + F.col("words")).alias("stop"),
            F.when(own, F.greatest(start, "kept.end")).otherwise(start).alias("start"),
            (F.col("start") + F.col("ends")[F.col("last")]).alias("end"),
            F.col("kept.doc_id").alias("kept_doc_id"),
            F.col("kept.start").alias("kept_start"),
        )
        .filter("word < stop")
    )
    by_row = Window.partitionBy("row").orderBy("word", "stop")
    reach = F.max("stop").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("_new", F.coalesce((F.col("word") > reach).cast("int"), F.lit(1)))
    spans = durable(
        opened.withColumn("_span", F.sum("_new").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "_span")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.min("word").alias("word"),
            F.max("stop").alias("stop"),
            F.min(F.struct("word", "kept_doc_id", "kept_start")).alias("first"),
        )
        .select(
            "row",
            "doc_id",
            "word",
            F.col("start").cast("long").alias("start"),
            F.col("end").cast("long").alias("end"),
            (F.col("stop") - F.col("word")).cast("long").alias("n_words"),
            "first.kept_doc_id",
            F.col("first.kept_start").cast("long").alias("kept_start"),
        ),
        "spans",
    )
    # Other texts of a class are repeated whole, and kept where their earliest is.
    begun = spans.filter("word = 0").select(
        F.col("row").alias("lead"), F.lit(True).alias("moved"), F.col("kept_doc_id").alias("_id"), F.col("kept_start").alias("_at")
    )
    several = named.filter("copies > 1").select(
        F.reverse("key").alias("_k"), F.col("row").alias("lead"), F.col("doc_id").alias("lead_id")
    )
    kept_whole = several.join(begun, "lead", "left")
    copies = (
        rows.withColumn("_k", F.reverse("key"))
        .join(kept_whole, "_k")
        .filter((F.col("row") != F.col("lead")) & (F.col("n_words") >= min(least_words, least_line_words)))
        .select(
            "row",
            "doc_id",
            F.col("start").cast("long").alias("start"),
            F.col("end").cast("long").alias("end"),
            F.col("n_words").cast("long").alias("n_words"),
            F.when(F.col("moved"), F.col("_id")).otherwise(F.col("lead_id")).alias("kept_doc_id"),
            F.when(F.col("moved"), F.col("_at")).otherwise(F.col("start").cast("long")).alias("kept_start"),
        )
    )
    return spans.drop("word").unionByName(copies)


def remove(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the given spans."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at : max(at, start)])
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text``. Ids must be unique and not null."""
    spans = repeated_spans(docs, least_words).groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "end")).alias("_spans")  # as many as one text has
    )
    joined = docs.join(spans, "doc_id", "left")
    names = docs.columns

    def run(batches):
        for batch in slices(batches, "text"):
            fields = batch.schema.names
            cuts = batch.column(fields.index("_spans")).to_pylist()
            texts = batch.column(fields.index("text")).to_pylist()
            new = [remove(t, [(c["start"], c["end"]) for c in cut or ()]) for t, cut in zip(texts, cuts, strict=True)]
            arrays = [pa.array(new, pa.string()) if n == "text" else batch.column(fields.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(run, docs.schema)
