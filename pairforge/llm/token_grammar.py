"""Token ids in binary shards, compressed by a grammar (Re-Pair).

A file set is a folder with two Parquet tables written by Spark, so any store works and
a lost executor costs its tasks only.

``shards`` has one row for about a million ids that follow each other. Within a shard
the most frequent pairs of neighbouring symbols are replaced by nonterminals, again and
again, until no pair occurs twice: a round takes every pair that is frequent enough, from the
most frequent ones down to two occurrences, settles overlaps in favour of the more frequent
pair, and keeps the pairs that were really replaced. Stored are, as little-endian unsigned
32-bit numbers,

* ``rules``: the two symbols of nonterminal ``first``, ``first + 1``, ...;
* ``lengths``: how many ids each of them stands for, by which a position is found without
  expanding what stands before it;
* ``symbols``: the sequence that is left, in two bytes a symbol where that is enough;
* ``doc_ids``, ``doc_numbers``, ``doc_offsets``, ``doc_tokens``, ``ends``: the pieces of
  documents in the shard. A document longer than a shard goes through several.

``parts`` has one row for every task that wrote: the ids that stand before its own.

Documents are sorted by ``doc_id`` with a range partitioning whose further keys are a hash
of the text and the place in the input, so that a hot id is spread over tasks; null ids
come first. Null and empty texts consist of the end id alone. Equal ids are ordered by
the hash of their texts; repeated rows are stored each. Further columns are left out.
An empty table gives empty tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.common import slices
from pairforge.llm.packing import END
from pairforge.llm.word_ids import word_ids
from pairforge.runtime import broadcast_if_small

SHARD_TOKENS = 1 << 20
LEAST_COUNT = 2  # occurrences that make a pair a rule
START = 1 << 14  # the first round takes pairs that occur once in so many symbols

SHARDS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("part_start", T.LongType()),  # ids of this part before the shard
        T.StructField("n_tokens", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("rules", T.BinaryType()),
        T.StructField("lengths", T.BinaryType()),
        T.StructField("width", T.IntegerType()),  # bytes of a symbol
        T.StructField("symbols", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_numbers", T.ArrayType(T.LongType())),  # place of the document in its part
        T.StructField("doc_offsets", T.ArrayType(T.LongType())),  # ids of the document before the piece
        T.StructField("doc_tokens", T.ArrayType(T.LongType())),  # of the whole document
        T.StructField("ends", T.ArrayType(T.LongType())),  # of the pieces in the shard
    ]
)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i], starts[i] + 1, ...``, ``lengths[i]`` of them, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


# --- grammar --------------------------------------------------------------------------


def _hashed(keys: np.ndarray, bits: int, turn: int = 0) -> np.ndarray:
    """Slots of a table of 2^bits entries, by a multiplication that wraps around; others in each ``turn``."""
    width = 8 * keys.dtype.itemsize
    odd = pow(0x9E3779B1 if width == 32 else 0x9E3779B97F4A7C15, 2 * turn + 1, 1 << width)
    return keys * keys.dtype.type(odd) >> keys.dtype.type(width - bits)


def _frequent(keys: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` commonest keys that stand ``least`` times or more, and their counts."""
    ordered = np.sort(keys)
    edges = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    edges = np.concatenate([[0], edges, [len(ordered)]])
    counts = np.diff(edges)
    kept = np.flatnonzero(counts >= least)
    kept = kept[np.argsort(-counts[kept], kind="stable")[:most]]
    return ordered[edges[kept]], counts[kept]


def _round(
    symbols: np.ndarray, open_: np.ndarray, least: int, next_symbol: int, turn: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after one round, where pairs begin that may repeat, and the new nonterminals' pairs.

    ``open_`` are such places before it: a pair that is alone stays so until one of its symbols changes. Which
    pairs share a slot depends on ``turn``, so that a lone one does not stay open round after round. At
    least one pair is replaced if any occurs ``least`` times without overlap. Symbols get four bytes
    where two cannot number the pairs.
    """
    half = 8 * symbols.dtype.itemsize
    wide = np.uint32 if half == 16 else np.uint64
    whole = len(open_) == len(symbols) - 1
    left, right = (symbols[:-1], symbols[1:]) if whole else (symbols[open_], symbols[open_ + 1])
    # Of a run of one symbol every other pair counts.
    equal = np.flatnonzero(left == right)
    if len(equal):
        begins = np.concatenate([[True], np.diff(open_[equal]) > 1])
        place = np.arange(len(equal))
        odd = (place - np.maximum.accumulate(np.where(begins, place, 0))) & 1 == 1
        counted = np.ones(len(open_), bool)
        counted[equal[odd]] = False
        later = open_[~counted]
        at, left, right = open_[counted], left[counted], right[counted]
    else:
        later, at = open_[:0], open_
    keys = left.astype(wide) << wide(half) | right
    slots = _hashed(keys, bits := max(8, len(keys).bit_length()), turn).astype(np.intp)
    held = np.minimum(np.bincount(slots, minlength=1 << bits), 0xFFFF).astype(np.uint16)[slots]
    many = np.flatnonzero(held >= min(least, 0xFFFF))
    frequent = keys[many]
    chosen, _ = _frequent(frequent, least, (1 << 32) - next_symbol) if len(frequent) else (frequent, None)
    repeats = held >= LEAST_COUNT
    if not len(chosen):
        return symbols, np.sort(np.concatenate([at[repeats], later])), np.zeros((0, 2), np.int64)
    # Two pairs of one slot: the commoner, which is written last, goes first; the other waits for the next round.
    table = np.zeros(1 << (bits := len(chosen).bit_length() + 4), np.int32)
    table[_hashed(chosen, bits)[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]
    rule = table[_hashed(frequent, bits)]
    hit = np.flatnonzero(chosen[rule] == frequent)
    rule, place = rule[hit], at[many[hit]]
    # Of two that overlap the commoner (the smaller number) wins.
    linked = np.diff(place) == 1
    wins = np.ones(len(place), bool)
    wins[:-1] &= ~(linked & (rule[1:] < rule[:-1]))
    wins[1:] &= ~(linked & (rule[:-1] < rule[1:]))
    wins = np.flatnonzero(wins)
    place, rule = place[wins], rule[wins]
    pays = np.bincount(rule, minlength=len(chosen)) >= LEAST_COUNT
    if not pays.all():
        wins = pays[rule]
        place, rule = place[wins], rule[wins]
    numbers = next_symbol + np.cumsum(pays) - 1
    symbols = symbols.astype(np.uint16 if half == 16 and numbers[-1] < 1 << 16 else np.uint32)
    symbols[place] = numbers.astype(symbols.dtype)[rule]
    keep = np.ones(len(symbols), bool)
    keep[place + 1] = False
    fresh = np.zeros(len(symbols), bool)
    fresh[at] = repeats
    fresh[later] = True
    fresh[place] = True
    # The symbol before a new one is the symbol at ``place - 1``, or the new one that took it in.
    before = place[place > 0] - 1
    fresh[np.where(keep[before], before, before - 1)] = True
    fresh = np.flatnonzero(fresh & keep)
    symbols = symbols[keep]
    fresh = (np.cumsum(keep, dtype=np.int32) - 1)[fresh].astype(np.intp)
    if len(fresh) and fresh[-1] == len(symbols) - 1:
        fresh = fresh[:-1]
    pairs = chosen[pays]
    pairs = np.stack([pairs >> wide(half), pairs & wide((1 << half) - 1)], 1).astype(np.int64)
    return symbols, fresh, pairs


def compress(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(first nonterminal, rules as rows of two symbols, remaining symbols).

    Goes on until no pair of neighbours occurs twice without overlap.
    """
    first = int(ids.max()) + 1 if len(ids) else 1
    # Two bytes a symbol as long as its numbers last, then four.
    symbols = ids.astype(np.uint16 if first < 1 << 16 else np.uint32)
    rules = [np.zeros((0, 2), np.int64)]
    made = turn = 0
    # The bar starts where only the most frequent pairs pass, and falls down to two.
    bar = max(LEAST_COUNT, len(symbols) // START)
    open_ = np.arange(len(symbols) - 1)
    while len(open_):
        symbols, open_, pairs = _round(symbols, open_, bar, first + made, turn)
        if not len(pairs) and bar == LEAST_COUNT:
            break
        rules.append(pairs)
        made += len(pairs)
        turn += 1
        bar = max(LEAST_COUNT, bar // 8)
    return first, np.concatenate(rules), symbols


def rule_lengths(first: int, rules: np.ndarray) -> np.ndarray:
    """Ids that each nonterminal stands for. A rule's symbols are older than the rule."""
    lengths = np.zeros(len(rules), np.int64)
    while (open_ := np.flatnonzero(lengths == 0)).size:
        sides = rules[open_]
        known = np.where(sides < first, 1, lengths[np.maximum(sides - first, 0)])
        lengths[open_] = np.where((known > 0).all(1), known.sum(1), 0)
    return lengths


def expansions(first: int, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all nonterminals one after the other, and where each starts."""
    starts = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), np.uint32)
    done = np.zeros(len(rules), bool)
    inner = rules >= first
    child = np.where(inner, rules - first, 0)
    while not done.all():
        ready = np.flatnonzero(~done & (~inner | done[child]).all(1))
        for side in (0, 1):
            at = starts[ready] + (0 if side == 0 else np.where(inner[ready, 0], lengths[child[ready, 0]], 1))
            deep = inner[ready, side]
            flat[at[~deep]] = rules[ready[~deep], side]
            of = child[ready[deep], side]
            flat[ragged(at[deep], lengths[of])] = flat[ragged(starts[of], lengths[of])]
        done[ready] = True
    return flat, starts


def expand(symbols: np.ndarray, first: int, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that ``symbols`` stand for."""
    flat, starts = expansions(first, rules, lengths)
    inner = symbols >= first
    rule = symbols[inner].astype(np.int64) - first
    sizes = np.ones(len(symbols), np.int64)
    sizes[inner] = lengths[rule]
    place = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint32)
    out[place[~inner]] = symbols[~inner]
    out[ragged(place[inner], sizes[inner])] = flat[ragged(starts[rule], sizes[inner])]
    return out


def expand_range(
    symbols: np.ndarray, first: int, rules: np.ndarray, lengths: np.ndarray, start: int, stop: int
) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard; only the symbols that cover them are expanded."""
    sizes = np.ones(len(symbols), np.int64)
    inner = symbols >= first
    sizes[inner] = lengths[symbols[inner].astype(np.int64) - first]
    ends = np.cumsum(sizes)
    start, stop = max(0, start), min(stop, int(ends[-1]) if len(ends) else 0)
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right")
    skipped = start - int(ends[a] - sizes[a])
    return expand(symbols[a : b + 1], first, rules, lengths)[skipped : skipped + stop - start]


# --- writing --------------------------------------------------------------------------


class _Pieces:
    """Ids and pieces of documents that wait for their shard."""

    def __init__(self, part: int, most: int) -> None:
        self.part, self.most = part, most
        self.shard = self.start = self.number = 0
        self.clear()

    def clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.rows: list[tuple[int | None, int, int, int, int]] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            taken = ids[at : at + self.most - self.held]
            self.ids.append(taken)
            self.held += len(taken)
            self.rows.append((doc_id, self.number, at, len(ids), self.held))
            at += len(taken)
            if self.held == self.most:
                yield self.close()
        self.number += 1

    def close(self) -> tuple:
        first, rules, symbols = compress(np.concatenate(self.ids))
        width = symbols.dtype.itemsize
        row = (
            self.part, self.shard, self.start, self.held, first,
            rules.astype("<u4").tobytes(), rule_lengths(first, rules).astype("<u4").tobytes(),
            width, symbols.astype(f"<u{width}").tobytes(),
            *[list(c) for c in zip(*self.rows, strict=True)],
        )
        self.shard += 1
        self.start += self.held
        self.clear()
        return row


def _record_batch(row: tuple) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
    kinds += (pa.list_(pa.int64()),) * 5
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], SHARDS.names)


def write_tokens(
    docs: DataFrame, vocabulary: str, path: str, shard_tokens: int = SHARD_TOKENS, end: int = END
) -> None:
    """Write the ids of ``docs`` (doc_id, text) in ascending order of ``doc_id`` to a new folder.

    ``vocabulary`` is the path of a tokenizer file that every executor can read.
    """
    closing = np.array([end], "<u4")

    def run(batches):
        encode = word_ids(vocabulary).encode_all
        pieces = _Pieces(TaskContext.get().partitionId(), shard_tokens)
        for batch in slices(batches, "text"):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                for row in pieces.add(doc_id, np.concatenate([ids, closing])):
                    yield _record_batch(row)
        if pieces.held:
            yield _record_batch(pieces.close())

    keys = ("doc_id", "_hash", "_place")
    ordered = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("text").cast("string").alias("text"),
            F.xxhash64("text").alias("_hash"),
            F.monotonically_increasing_id().alias("_place"),
        )
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
    )
    spark = docs.sparkSession
    ordered.select("doc_id", "text").mapInArrow(run, SHARDS).write.parquet(f"{path}/shards")
    # One row for each task that wrote something.
    parts = (
        spark.read.schema(SHARDS).parquet(f"{path}/shards")
        .groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_shards"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/parts")


# --- reading --------------------------------------------------------------------------

_POLYNOMIAL = 0xEDB88320  # of crc32, bits reversed


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, bits reversed."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit >>= 1
        b = b >> 1 ^ _POLYNOMIAL if b & 1 else b >> 1
    return out


def crc_before(crc: int, n_bytes: int) -> int:
    """What a part's crc32 adds (by xor) to that of a whole in which ``n_bytes`` follow it."""
    power, square = 1 << 31, 1 << 30
    n = 8 * n_bytes
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return _times(power, crc)


def _opened(batch: pa.RecordBatch, i: int) -> dict:
    row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
    row["rules"] = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
    row["lengths"] = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    row["symbols"] = np.frombuffer(row["symbols"], f"<u{row['width']}")
    return row


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(f"{path}/shards")


def _with_start(pieces: DataFrame, path: str) -> DataFrame:
    """``part_start`` becomes ``start``: ids before it in all parts."""
    parts = pieces.sparkSession.read.parquet(f"{path}/parts").select("part", F.col("start").alias("_before"))
    joined = pieces.join(broadcast_if_small(parts), "part")
    return joined.withColumn("start", F.col("part_start") + F.col("_before")).drop("_before", "part_start")


PIECES = (
    "part int, doc_number long, doc_id long, part_start long, offset long, length long, n_tokens long, ids binary, crc long"
)


def read_pieces(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Pieces of documents: ids as little-endian unsigned 32-bit numbers, and their part in the
    document's crc32 (the xor of its pieces'). ``start`` counts the ids of all documents before
    the document."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = _opened(batch, i)
                ids = expand(row["symbols"], row["first"], row["rules"], row["lengths"])
                if len(ids) != row["n_tokens"]:
                    raise ValueError("a shard does not hold the ids it declares")
                out: list[list] = [[] for _ in range(9)]
                begin = 0
                fields = ("doc_ids", "doc_numbers", "doc_offsets", "doc_tokens", "ends")
                for doc_id, number, offset, total, stop in zip(*[row[f] for f in fields], strict=True):
                    data = ids[begin:stop].astype("<u4").tobytes()
                    after = total - offset - (stop - begin)
                    crc = crc_before(zlib.crc32(data), 4 * after) if after else zlib.crc32(data)
                    values = (row["part"], number, doc_id, row["part_start"] + begin - offset, offset, stop - begin, total, data if with_ids else None, crc)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    begin = stop
                kinds = (pa.int32(), *[pa.int64()] * 6, pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                    [f.split(" ")[0] for f in PIECES.split(", ")],
                )

    return _with_start(_shards(spark, path).mapInArrow(run, PIECES), path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its pieces."""
    pieces = read_pieces(spark, path, with_ids=False)
    return (
        pieces.groupBy("part", "doc_number", "doc_id", "start", "n_tokens")
        .agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("length").alias("_read"))
        .select(
            "doc_id",
            "start",
            "n_tokens",
            F.when(F.col("_read") == F.col("n_tokens"), F.col("ids_crc32"))
            .otherwise(F.raise_error(F.lit("a document's pieces are incomplete")).cast("long"))
            .alias("ids_crc32"),
        )
    )


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Ids ``start`` to ``stop`` of the whole file set: rows (start, ids), one for each shard.

    Shards that do not meet the range are not decoded, and of the others only the symbols that cover it.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = _opened(batch, i)
                low = max(0, start - row["start"])
                ids = expand_range(row["symbols"], row["first"], row["rules"], row["lengths"], low, stop - row["start"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["start"] + low], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())],
                    ["start", "ids"],
                )

    placed = _with_start(_shards(spark, path).select(*SHARDS.names[:9]), path)
    met = placed.filter((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    return met.mapInArrow(run, "start long, ids binary")
