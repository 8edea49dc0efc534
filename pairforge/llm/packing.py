"""Training sequences by power-of-two decomposition.

A document's tokens, closed by an end token, are cut into pieces whose lengths are
powers of two: as many of the longest length as fit, then one for each bit of the
rest. Pieces of one length form a bucket whose batches need no padding, so every
piece is a sequence of its own and no sequence crosses documents. Nothing has to
be brought together, so there is no shuffle.

Null and empty texts consist of the end token alone. Repeated rows are packed each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.common import slices, utf8
from pairforge.llm.word_ids import CACHED_WORDS, word_ids

LONGEST = 2048
END = 1

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def cuts(n: int, longest: int = LONGEST) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens, longest first."""
    start = 0
    while n - start >= longest:
        yield start, longest
        start += longest
    bit = longest >> 1
    while bit:
        if (n - start) & bit:
            yield start, bit
            start += bit
        bit >>= 1


def pack(
    docs: DataFrame, vocabulary: str, longest: int = LONGEST, end: int = END, cached_words: int = CACHED_WORDS
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): ``ids`` are little-endian unsigned 32-bit numbers.

    ``vocabulary`` is the path of a tokenizer file that every executor can read. Texts are
    encoded word by word where the file says that words stay apart, else whole; a worker
    keeps ``cached_words`` of them.
    A sequence is numbered by its input split and its place there.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    closing = np.array([end], "<u4").tobytes()

    def run(batches):
        encode = word_ids(vocabulary, cached_words).encode
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            columns: list[list] = [[] for _ in PIECES]
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)).to_pylist(), strict=True):
                ids = encode(text) + closing
                n = len(ids) // 4
                for start, length in cuts(n, longest):
                    row = (doc_id, start, length, ids[4 * start : 4 * (start + length)], n, number, 0)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(columns)],
                PIECES.names,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def buckets(pieces: DataFrame) -> DataFrame:
    """Sequences and tokens of each length, from which batches of equal length are drawn."""
    return pieces.groupBy("length").agg(
        F.countDistinct("sequence_id").alias("sequences"), F.sum("length").alias("tokens")
    )
