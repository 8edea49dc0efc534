"""Near copies of texts by HyperMinHash.

1. One pass over the texts makes, per document, the digest of its set of 5-word
   shingles and a sketch: the 64-bit hashes of the shingles are dealt to 128
   buckets by their first bits, and of the least hash in each bucket the number of
   leading zeros and the next ten bits are kept. Documents with equal sets form a
   class, and one of them stands for it from here on.
2. Bands of four registers (empty ones borrow by a fixed rule) give 32 keys a class.
   Classes that share a key are compared by their sketches: the share of equal
   registers, less the equalities expected by chance, estimates the similarity. The
   estimate keeps all pairs within five standard errors of the threshold. Keys with
   very many classes are kept whole. Only a spanning forest of what is kept leaves
   the task, and its components are candidate groups.
3. Candidate groups fetch their texts. Full sets are compared inside blocks of a
   group; a large group is many pairs of blocks, and blocks whose sizes rule a link
   out never meet. Again only a spanning forest leaves the task.

No pair list is ever formed, a class of equal texts of any size is one node, and no
task holds more than two blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.common import slices, utf8
from pairforge.llm.components import Joined, connected_components, spanning
from pairforge.runtime import durable

SHINGLE = 5
SIMILAR = (85, 100)  # link when 100 * intersection >= 85 * union
REGISTERS = 128  # a power of two
MANTISSA = 10
BAND = 4
ERRORS = 5.0  # standard errors an estimate may lie below the threshold
BLOCK = 128  # classes of one bucket or group that meet in one task
BLOCK_SHINGLES = 1 << 19  # shingles in a block of large texts
EMPTY = np.uint16(0xFFFF)

_WEIGHTS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64
)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct k-word sequences of a UTF-8 text.

    ``bytes`` folds A-Z only and splits at the six ASCII white-space characters,
    which is the word rule here. Fewer than k words are one sequence.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    x = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    k = min(k, len(x))
    n = len(x) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h += x[i : i + n] * _WEIGHTS[i % len(_WEIGHTS)]
    return np.unique(_mix(h))


def sketch(hashes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Leading zeros and mantissa of the least hash of each bucket, as 16-bit registers."""
    bits = 64 - (registers.bit_length() - 1)
    out = np.full(registers, EMPTY)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rest = hashes[first] & np.uint64((1 << bits) - 1)
    top = rest >> np.uint64(bits - 53)  # exact as a float
    exponent = np.frexp(top.astype(np.float64))[1]  # bits in use
    zeros = 53 - exponent
    shift = np.maximum(exponent - 1 - MANTISSA, 0)
    mantissa = np.where(top > 0, (top >> shift.astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1), 0)
    out[bucket[first]] = np.minimum(zeros, 62).astype(np.uint16) << MANTISSA | mantissa.astype(np.uint16)
    return out


# Where an empty register looks for one to borrow, in order; the same for every text.
_BORROW = np.array([np.random.default_rng(1000 + i).permutation(REGISTERS) for i in range(REGISTERS)])


def band_keys(registers: np.ndarray, band: int = BAND) -> np.ndarray:
    """Keys (rows x bands) of sketches (rows x registers)."""
    full = registers.copy()
    for i in np.flatnonzero((registers == EMPTY).any(axis=1) & (registers != EMPTY).any(axis=1)):
        row = registers[i]
        empty = np.flatnonzero(row == EMPTY)
        order = _BORROW[empty]
        lender = order[np.arange(len(empty)), (row[order] != EMPTY).argmax(axis=1)]
        full[i, empty] = row[lender]
    parts = full.reshape(len(full), -1, band).astype(np.uint64)
    h = np.arange(parts.shape[1], dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    h = np.repeat(h, len(full), axis=0)
    for j in range(band):
        h = _mix((h ^ parts[:, :, j]) * _WEIGHTS[j % 5] + np.uint64(1))
    return h.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of each row of ``a`` to that row of ``b``, and the registers it rests on.

    Registers of different least hashes are equal by chance with a probability of
    about 1/3 * 2**-MANTISSA; that share is taken off.
    """
    filled = (a != EMPTY) | (b != EMPTY)
    used = filled.sum(axis=1)
    equal = ((a == b) & filled).sum(axis=1)
    chance = 2.0**-MANTISSA / 3
    share = equal / np.maximum(used, 1)
    return (share - chance) / (1 - chance), used


FEATURES = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("registers", T.BinaryType()),
    ]
)


def features(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """One row per document, written to the shared folder so that ``row`` stays as it is."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            sizes, digests, sketches = [], [], []
            for i, text in enumerate(utf8(batch.column(1)).to_pylist()):
                hashes = shingle_set(text, k)
                sizes.append(len(hashes))
                # An empty set is a class of its own, told by its row.
                key = hashes.tobytes() if len(hashes) else b"row %d" % (row + i)
                digests.append(hashlib.blake2b(key, digest_size=16).digest())
                sketches.append(sketch(hashes).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)),
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(sketches, pa.binary()),
                ],
                FEATURES.names,
            )
            row += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return durable(rows.mapInArrow(run, FEATURES), "sketches")


def _whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The same rows, sorted by ``key``, cut so that rows of equal key stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(batch.schema.get_field_index(key)))
        if held and np.asarray(held[-1].column(batch.schema.get_field_index(key)))[-1] != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        turn = np.flatnonzero(keys[1:] != keys[:-1])
        if not len(turn):
            held.append(batch)
            continue
        cut = int(turn[-1]) + 1
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"]
    )


def _alike_pairs(sketches: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one run that may be similar. Rows stand run by run, of the given sizes."""
    starts = np.cumsum(sizes) - sizes
    left, right = [], []
    for n in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(n, 1)
        at = starts[sizes == n][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    good = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        x, y = sketches[a[at : at + (1 << 14)]], sketches[b[at : at + (1 << 14)]]
        alike, used = estimate(x, y)
        error = np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
        good[at : at + (1 << 14)] = alike >= threshold - ERRORS * error
    return a[good], b[good]


def candidate_edges(classes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all classes which may be similar and share a band.

    Bands of more than ``block`` classes are not compared by sketches: they are near
    copies for the most part, and all go on to the comparison of full sets.
    """

    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                raw = b"".join(batch.column(1).to_pylist())
                found = band_keys(np.frombuffer(raw, np.uint16).reshape(batch.num_rows, -1))
                n = found.shape[1]
                flat = pa.array(found.ravel())
                at = pa.array(np.repeat(np.arange(batch.num_rows), n))
                yield pa.RecordBatch.from_arrays([flat, batch.column(0).take(at)], ["key", "node"])

    rows = classes.filter("n_shingles > 0")
    banded = durable(rows.select("node", "registers").mapInArrow(keys, "key long, node long"), "bands")
    counts = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
    # Joined by a key of their own, so that adaptive execution may split hot bands.
    meeting = durable(
        banded.withColumn("_k", F.bitwise_not("key"))
        .join(counts.filter("n > 1").select(F.bitwise_not("key").alias("_k"), "n", "least"), "_k")
        .select("key", "node", "n", "least"),
        "bands",
    )
    carried = meeting.filter(F.col("n") <= block).select("key", "node").join(rows.select("node", "registers"), "node")

    def compare(batches):
        joined = Joined()
        for table in _whole_runs(batches, "key"):
            place = np.asarray(table["key"])
            nodes = np.asarray(table["node"])
            sketches = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(len(nodes), -1)
            edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
            a, b = _alike_pairs(sketches, np.diff(edges), threshold)
            for x, y in zip(nodes[a].tolist(), nodes[b].tolist(), strict=True):
                joined.join(x, y)
            yield _edges(joined.take())

    dealt = carried.repartition("key").sortWithinPartitions("key")
    hot = meeting.filter((F.col("n") > block) & (F.col("node") > F.col("least")))
    return dealt.mapInArrow(compare, "a long, b long").unionByName(
        hot.select(F.col("node").alias("a"), F.col("least").alias("b"))
    )


def _set_bytes(texts: DataFrame, k: int) -> DataFrame:
    """Replaces ``text`` by its shingle set; rows whose set is not the wanted one go."""

    def run(batches):
        names = None
        for batch in slices(batches, "text"):
            names = names or batch.schema.names
            wanted = batch.column(names.index("digest")).to_pylist()
            sets = [shingle_set(t, k).tobytes() for t in utf8(batch.column(names.index("text"))).to_pylist()]
            same = [hashlib.blake2b(s, digest_size=16).digest() == w for s, w in zip(sets, wanted, strict=True)]
            arrays = [
                pa.array(sets, pa.binary()) if n == "text" else batch.column(i) for i, n in enumerate(names)
            ]
            yield pa.RecordBatch.from_arrays(arrays, names).filter(pa.array(same))

    fields = [
        T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in texts.schema.fields
    ]
    return texts.mapInArrow(run, T.StructType(fields))


def _linked(sets: list[np.ndarray], part: int, whole: int) -> np.ndarray:
    """Which sets are similar: all intersections at once, over the shingles that occur twice."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.zeros((len(sets), len(sets)), np.int64)
    twice = np.flatnonzero(seen > 1)
    place = np.full(len(values), -1)
    place[twice] = np.arange(len(twice))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    for start in range(0, len(twice), 1 << 14):
        inside = (column >= start) & (column < start + (1 << 14))
        marks = np.zeros((len(sets), min(1 << 14, len(twice) - start)), np.float32)
        marks[owner[inside], column[inside] - start] = 1.0
        both += np.rint(marks @ marks.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    return (whole * both >= part * union) & (sizes[:, None] > 0)


def verified_edges(
    docs: DataFrame, members: DataFrame, similar: tuple[int, int] = SIMILAR, k: int = SHINGLE, block: int = BLOCK
) -> DataFrame:
    """Edges that connect all similar classes of each candidate group, confirmed on full sets.

    ``members``: (component, node, doc_id, digest, n_shingles), one row per class.
    Members are dealt by size: neighbouring size steps differ by the threshold, so
    only equal or neighbouring steps can hold similar sets.
    """
    part, whole = similar
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(whole / part) + 1e-9)).cast("int")
    # Steps of one group and how many blocks each is cut into; small groups are one block.
    sized = members.withColumn("_step", step)
    fits = F.greatest(F.lit(2), F.least(F.lit(block), F.floor(F.lit(BLOCK_SHINGLES) / F.max("n_shingles"))))
    steps = sized.groupBy("component", "_step").agg(
        F.ceil(F.count(F.lit(1)) / fits).cast("int").alias("blocks"),
        F.count(F.lit(1)).alias("n"),
        F.sum("n_shingles").alias("shingles"),
    )
    whole_group = sized.groupBy("component").agg(
        ((F.count(F.lit(1)) <= block) & (F.sum("n_shingles") <= BLOCK_SHINGLES)).alias("together")
    )
    steps = durable(steps, "steps")
    above = steps.select("component", (F.col("_step") - 1).alias("_step"), F.col("blocks").alias("blocks_above"))
    below = steps.select("component", (F.col("_step") + 1).alias("_step"), F.col("blocks").alias("blocks_below"))
    plan = durable(
        steps.select("component", "_step", "blocks")
        .join(above, ["component", "_step"], "left")
        .join(below, ["component", "_step"], "left")
        .join(whole_group, "component"),
        "steps",
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")

    def others(blocks: str) -> Column:
        n = F.coalesce(F.col(blocks), F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    spot = F.col("_step")
    met = F.when(F.col("together"), F.array(F.xxhash64("component"))).otherwise(
        F.concat(
            F.transform(others("blocks"), lambda o: F.xxhash64("component", spot, F.least(own, o), spot, F.greatest(own, o))),
            F.transform(others("blocks_above"), lambda o: F.xxhash64("component", spot, own, spot + 1, o)),
            F.transform(others("blocks_below"), lambda o: F.xxhash64("component", spot - 1, o, spot, own)),
        )
    )
    split_key = F.xxhash64("component", "_step")
    placed = (
        sized.withColumn("_k", split_key)
        .join(plan.withColumn("_k", split_key).select("_k", "blocks", "blocks_above", "blocks_below", "together"), "_k")
        .select("node", "doc_id", "digest", met.alias("places"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Null ids can stand for a class as well, hence the null-safe join.
    found = texts.join(placed, texts["doc_id"].eqNullSafe(placed["doc_id"])).select("node", "digest", "places", "text")
    sets = _set_bytes(found, k).select("node", F.explode("places").alias("place"), "text")

    def compare(batches):
        joined = Joined()
        for table in _whole_runs(batches, "place"):
            place, nodes = np.asarray(table["place"]), table["node"].to_pylist()
            texts = table["text"]
            edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True]).tolist()
            for start, stop in zip(edges, edges[1:], strict=False):
                # Repeated ids can bring the same class twice.
                found = {nodes[i]: texts[i].as_py() for i in range(start, stop)}
                if len(found) > 1:
                    names = list(found)
                    linked = _linked([np.frombuffer(s, np.uint64) for s in found.values()], part, whole)
                    for i, j in spanning(linked):
                        joined.join(names[i], names[j])
            yield _edges(joined.take())

    return sets.repartition("place").sortWithinPartitions("place").mapInArrow(compare, "a long, b long")


def near_copies(
    docs: DataFrame, similar: tuple[int, int] = SIMILAR, k: int = SHINGLE, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row) for every row of ``docs`` (doc_id, text).

    The component is the smallest doc_id that links reach. Texts without words link
    with nothing. Rows that repeat an id are told apart while linking and each get a
    row; a null id is no smallest id unless its component has no other.
    """
    found = features(docs, k)
    classes = durable(
        found.groupBy("digest").agg(
            F.min("doc_id").alias("least_id"),
            F.min(F.struct("row", "doc_id", "n_shingles", "registers")).alias("one"),
        ).select(
            "digest",
            "least_id",
            F.col("one.row").alias("node"),
            F.col("one.doc_id").alias("doc_id"),
            F.col("one.n_shingles").alias("n_shingles"),
            F.col("one.registers").alias("registers"),
        ),
        "classes",
    )
    groups = connected_components(candidate_edges(classes, similar[0] / similar[1], block))
    members = classes.drop("registers").join(groups, "node")
    links = connected_components(verified_edges(docs, members, similar, k, block))
    lead = classes.select("digest", "node", "least_id").join(links, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    named = lead.groupBy("component").agg(F.min("least_id").alias("component_id"))
    where = lead.select("digest", "component").join(named, "component").select(
        F.reverse("digest").alias("_k"), "component_id"
    )
    return (
        found.select("row", "doc_id", "n_shingles", F.reverse("digest").alias("_k"))
        .join(where, "_k")
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
            "row",
        )
    )
