"""Near copies of embeddings by spherical-cap filters.

Filter directions form a structured random product code: the space is turned by a
random rotation and cut into two parts, each part has a small codebook, and one code
word of each part makes a direction. A vector is decoded to the list of all
directions whose cap it lies in, by extending partial sums and leaving out those
that cannot reach the threshold any more. Several rotations make as many such codes;
their number follows from how often one code parts random pairs at the threshold, so
that all of them do with a chance of ``MISS`` at most, at every code size. Vectors meet under (label, direction) and
are verified by their cosine in double precision.

They meet in two rounds. In the first one every vector is sent under its first direction
only, where most members of a group find each other. In the second one it is sent under
all others, but only to buckets that hold more than one of the components found so far; codes are
so fine that strangers seldom share one. Then links are counted among all members of a
component, whichever directions they share, so counts are exact for the components found.

Equal vectors of one label are one node that counts its copies. A bucket, or a component, of any size
is cut into blocks of ``BLOCK`` nodes, and each pair of blocks is a task's work. No pair
leaves a task: only counts per node and a spanning forest do.

Null labels, null or zero vectors and vectors with null or non-finite components link
with nothing. Rows that repeat an id are told apart; each gets a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.components import Joined, connected_components, spanning
from pairforge.llm.minhash import _edges, _whole_runs
from pairforge.runtime import durable

SIMILAR = 0.93
PARTS = 2
CODES = 64  # code words in each part at least, a power of two
ROTATIONS = 3  # codes of their own at least, so that a pair missed by one is met in another
MISS = 1e-4  # chance that a pair at the threshold is missed by all codes
TRIALS = 1000  # random pairs that one code is tried on
CAPS = 10.0  # caps of a code an average vector lies in
LEAST_CAPS = 6  # a vector in fewer caps of a code takes its nearest directions
STRANGERS = 2  # members of a bucket by chance, if all vectors had one label
BLOCK = 128
SEED = 11


def codes_for(rows: int) -> int:
    """Code words in each part: more directions for more vectors, so that a bucket holds few strangers.

    Beyond some three million vectors of one label the code grows no more, and strangers do.
    """
    codes = CODES
    while rows * CAPS / codes**PARTS > STRANGERS and codes < 4096:
        codes *= 2
    return codes


@lru_cache(maxsize=128)
def _code(dims: int, codes: int, rotation: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], float]:
    """Rotation, places of each part, its code words, and the threshold."""
    rng = np.random.default_rng([SEED, dims, codes, rotation])
    turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    places = [p for p in np.array_split(np.arange(dims), PARTS) if len(p)]
    books = []
    for place in places:
        words = rng.standard_normal((codes, len(place)))
        words /= np.linalg.norm(words, axis=1, keepdims=True)
        books.append(words * np.sqrt(len(place) / dims))
    share = min(0.5, CAPS / codes ** len(places))
    return turn, places, books, NormalDist().inv_cdf(1 - share) / np.sqrt(dims)


def _decode_one(unit: np.ndarray, codes: int, rotation: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, direction) pairs of one code."""
    turn, places, books, threshold = _code(unit.shape[1], codes, rotation)
    turned = unit @ turn
    scores = [turned[:, p] @ b.T for p, b in zip(places, books, strict=True)]
    best = np.array([s.max(axis=1) for s in scores])
    rest = np.vstack([np.cumsum(best[::-1], axis=0)[::-1][1:], np.zeros((1, len(unit)))])
    owner, number, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    # Vectors whose best direction is below the threshold still get directions near it.
    limit = np.minimum(threshold, best.sum(axis=0) * 0.92)
    for score, still in zip(scores, rest, strict=True):
        sums = total[:, None] + score[owner]
        a, b = np.nonzero(sums + still[owner][:, None] >= limit[owner][:, None])
        number, total, owner = number[a] * codes + b, sums[a, b], owner[a]
    order = np.lexsort((-total, owner))
    owner, number, total = owner[order], number[order], total[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    good = (total >= threshold) | (place < LEAST_CAPS)
    return owner[good], number[good] + rotation * codes**PARTS


@lru_cache(maxsize=64)
def rotations(dims: int, codes: int, similar: float = SIMILAR) -> int:
    """How many codes keep the chance of missing a pair at ``similar`` at ``MISS`` or below.

    One code is tried on random pairs at that cosine; its share of misses, with three standard
    errors on top, is raised to the number of codes. A share above nine in ten counts as that.
    """
    if dims < 2:
        return ROTATIONS
    rng = np.random.default_rng([SEED, dims, codes])
    x = rng.standard_normal((TRIALS, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = similar * x + np.sqrt(max(0.0, 1 - similar**2)) * z / np.linalg.norm(z, axis=1, keepdims=True)
    met = 0
    for at in range(0, TRIALS, 250):
        (i, a), (j, b) = (_decode_one(v[at : at + 250], codes, 0) for v in (x, y))
        met += len(np.unique(np.intersect1d(i * codes**PARTS + a, j * codes**PARTS + b) // codes**PARTS))
    share = 1 - met / TRIALS
    share = min(0.9, share + 3 * np.sqrt(max(share * (1 - share), 1 / TRIALS) / TRIALS))
    return max(ROTATIONS, int(np.ceil(np.log(MISS) / np.log(share))))


def decode(unit: np.ndarray, codes: int = CODES, similar: float = SIMILAR) -> list[np.ndarray]:
    """Sorted numbers of all directions in whose cap each row of ``unit`` lies."""
    found = [_decode_one(unit, codes, r) for r in range(rotations(unit.shape[1], codes, similar))]
    owner, number = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((number, owner))
    return np.split(number[order], np.searchsorted(owner[order], np.arange(1, len(unit))))


PREPARED = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("vec_id", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("label", T.StringType()),
        T.StructField("vector", T.BinaryType()),
        T.StructField("caps", T.ArrayType(T.LongType())),
    ]
)


def prepare(vectors: DataFrame, codes: int, similar: float = SIMILAR) -> DataFrame:
    """One row per vector, with its caps if it can link. Written, so that ``row`` stays."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                labels = batch.column(2).to_pylist()
                units: list[np.ndarray | None] = []
                for label, values in zip(labels, batch.column(1).to_pylist(), strict=True):
                    unit = None
                    if label is not None and values and None not in values:
                        given = np.array(values, np.float64)
                        top = np.abs(given).max()
                        if np.isfinite(given).all() and top > 0:
                            given = given / top  # so that squares neither overflow nor vanish
                            unit = given / np.linalg.norm(given)
                    units.append(unit)
                caps: list = [None] * batch.num_rows
                for dims in {len(u) for u in units if u is not None}:
                    some = [i for i, u in enumerate(units) if u is not None and len(u) == dims]
                    for i, found in zip(some, decode(np.array([units[i] for i in some]), codes, similar), strict=True):
                        caps[i] = found
                digests = [
                    hashlib.blake2b(
                        b"row %d" % (row + i) if u is None else f"{labels[i]}|".encode() + u.tobytes(), digest_size=16
                    ).digest()
                    for i, u in enumerate(units)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + batch.num_rows)),
                        batch.column(0),
                        pa.array(digests, pa.binary()),
                        batch.column(2),
                        pa.array([None if u is None else u.tobytes() for u in units], pa.binary()),
                        pa.array(caps, pa.list_(pa.int64())),
                    ],
                    PREPARED.names,
                )
                row += batch.num_rows

    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label")
    )
    return durable(given.mapInArrow(run, PREPARED), "vectors")


def _block_pairs(blocks: Column, member: str) -> Column:
    """The pairs of blocks that a member of a bucket of ``blocks`` blocks takes part in."""
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    return F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda o: F.struct(F.least(own, o).alias("one"), F.greatest(own, o).alias("two"), own.alias("own")),
    )


def _blocks_of(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of every pair of blocks, and which of them are close in it."""
    for table in _whole_runs(batches, "place"):
        place = np.asarray(table["place"])
        edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True]).tolist()
        for start, stop in zip(edges, edges[1:], strict=False):
            if stop - start < 2:
                continue
            part = table.slice(start, stop - start)
            x = np.array([np.frombuffer(v, np.float64) for v in part["vector"].to_pylist()])
            close = x @ x.T >= similar
            np.fill_diagonal(close, False)
            if part["one"][0].as_py() != part["two"][0].as_py():  # pairs inside a block are another task's work
                own = np.asarray(part["own"])
                close &= own[:, None] != own[None, :]
            if close.any():
                yield part, close


def _join(similar: float):
    """A spanning forest of the links between different components."""

    def run(batches):
        joined = Joined()
        for part, close in _blocks_of(batches, similar):
            nodes, component = np.asarray(part["node"]), np.asarray(part["component"])
            close &= component[:, None] != component[None, :]
            for i, j in spanning(close):
                joined.join(int(nodes[i]), int(nodes[j]))
            if len(joined.edges) >= 10_000:
                yield _edges(joined.take())
        yield _edges(joined.take())

    return run


def _count(similar: float):
    """Links of every node in a pair of blocks."""

    def run(batches):
        for part, close in _blocks_of(batches, similar):
            count = close @ np.asarray(part["copies"])
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(part["node"])[some]), pa.array(count[some].astype(np.int64))], ["node", "links"]
            )

    return run


def _met(members: DataFrame, groups: DataFrame, vectors: DataFrame, block: int) -> DataFrame:
    """Members (place, own, one, two, node, ...) of every pair of blocks of a group, with their vectors.

    ``members`` have a ``group``, ``groups`` say how many members each has; others are left out.
    """
    sizes = groups.select(F.bitwise_not("group").alias("_k"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = (
        members.withColumn("_k", F.bitwise_not("group"))
        .join(sizes, "_k")
        .drop("_k")
        .select("*", F.explode(_block_pairs(F.col("blocks"), "node")).alias("pair"))
        .drop("blocks")
        .select("*", F.xxhash64("group", "pair.one", "pair.two").alias("place"), "pair.*")
        .drop("pair", "group")
    )
    return dealt.join(vectors, "node").repartition("place").sortWithinPartitions("place")


def _links(able: DataFrame, components: DataFrame | None, caps: Column, similar: float, block: int) -> DataFrame:
    """Edges (a, b) between components whose members meet under ``caps``."""
    known = able.select("node", "label", caps.alias("caps"), F.length("vector").alias("size"))
    if components is None:
        known = known.withColumn("component", F.col("node"))
    else:
        known = known.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Vectors of one length meet only: the length is part of the bucket.
    entries = known.select("node", "component", "label", "size", F.explode("caps").alias("cap")).select(
        "node", "component", F.xxhash64("label", "size", "cap").alias("group")
    )
    mixed = (
        entries.groupBy("group")
        .agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        .filter("lo < hi")
    )
    met = _met(entries, mixed, able.select("node", "vector"), block)
    return durable(met.mapInArrow(_join(similar), "a long, b long"), "links")


def near_copies(vectors: DataFrame, similar: float = SIMILAR, block: int = BLOCK, codes: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    rows = prepare(vectors, codes or codes_for(vectors.count()), similar)
    nodes = durable(
        rows.groupBy("digest").agg(
            F.min("row").alias("node"),
            F.min("vec_id").alias("least_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("label").alias("label"),
            F.first("vector").alias("vector"),
            F.first("caps").alias("caps"),
        ),
        "nodes",
    )
    able = nodes.filter("vector IS NOT NULL").select("node", "label", "copies", "vector", "caps")
    first = _links(able, None, F.slice("caps", 1, 1), similar, block)
    second = _links(able, durable(connected_components(first), "components"), F.col("caps"), similar, block)
    groups = durable(connected_components(first.unionByName(second)), "components")
    sizes = groups.groupBy(F.col("component").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    members = groups.select("node", F.col("component").alias("group"))
    counted = _met(members, sizes, able.select("node", "copies", "vector"), block).mapInArrow(_count(similar), "node long, links long")
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    lead = (
        nodes.select("digest", "node", "least_id", "copies")
        .join(groups, "node", "left")
        .join(links, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    named = lead.groupBy("component").agg(F.min("least_id").alias("component_id"))
    where = lead.join(named, "component").select(
        F.reverse("digest").alias("_k"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        "component_id",
    )
    return (
        rows.select("vec_id", F.reverse("digest").alias("_k"))
        .join(where, "_k")
        .select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
