"""Lines with the byte at which they begin, read from byte ranges of files.

A line belongs to the range that holds its first byte, whichever ranges the files are cut
into, so (file, offset) is a key that no split size, core count or order of tasks changes.
Lines end at LF, CR or CRLF. A byte order mark at the start of a file is no text.

Files are opened by Arrow's file systems (local, HDFS, S3, GCS) in the tasks. Compressed
files cannot be cut and are one range each; their offsets are those of the plain bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 128 << 20
BLOCK_BYTES = 4 << 20
COMPRESSED = (".gz", ".bz2", ".lz4", ".zst")
LF, CR = 10, 13
BOM = b"\xef\xbb\xbf"


@dataclass
class ByteRange(InputPartition):
    root: str
    path: str
    name: str
    start: int
    end: int | None  # None: to the end of the file


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def byte_ranges(roots: list[str], split_bytes: int) -> list[ByteRange]:
    """Ranges of about ``split_bytes`` over all files below the given paths; hidden files are left out."""
    if split_bytes < 1:
        raise ValueError("a split must hold a byte at least")
    out = []
    for root in roots:
        system, top = _open(root)
        info = system.get_file_info(top)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(root)
        files = [info] if info.is_file else system.get_file_info(pafs.FileSelector(top, recursive=True))
        for file in sorted((f for f in files if f.is_file), key=lambda f: f.path):
            name = file.base_name if info.is_file else file.path[len(top.rstrip("/")) + 1 :]
            if any(part[0] in "._" for part in name.split("/")):
                continue
            if name.endswith(COMPRESSED):
                out.append(ByteRange(root, file.path, name, 0, None))
            else:
                out += [
                    ByteRange(root, file.path, name, start, min(start + split_bytes, file.size))
                    for start in range(0, file.size, split_bytes)
                ]
    return out


def lines_of(stream, start: int, end: int | None, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """(offsets, lengths, text bytes) of the lines that begin at ``start`` or later, and before ``end``.

    ``stream`` stands at the byte before ``start``, or at 0.
    """
    at = max(0, start - 1)  # where ``held`` begins
    held = b""
    inside = start > 0  # whether ``held`` begins inside a line of the range before
    last = False
    while not last:
        block = stream.read(block_bytes)
        last = not block
        held += block
        data = np.frombuffer(held, np.uint8)
        # A CR at the end of what is known may be the first half of a CRLF.
        known = len(data) if last else max(0, len(data) - 1)
        after = np.append(data, 0)
        ends = np.flatnonzero((data[:known] == LF) | (data[:known] == CR))
        ends = ends[(data[ends] == LF) | (after[ends + 1] != LF)]
        if inside:
            if not len(ends):
                at, held = at + known, held[known:]
                continue
            first = int(ends[0]) + 1
            at, held, data, after, ends = at + first, held[first:], data[first:], after[first:], ends[1:] - first
            inside = False
        if last and len(data) and (not len(ends) or ends[-1] != len(data) - 1):
            ends = np.append(ends, len(data))  # the last line of a file needs no end
        begins = np.concatenate([[0], ends + 1])[: len(ends)].astype(np.int64)
        mine = np.ones(len(ends), bool) if end is None else at + begins < end
        begins, stops = begins[mine], ends[mine]
        if len(begins):
            stops = stops - ((stops > begins) & (after[stops] == LF) & (data[np.maximum(stops - 1, 0)] == CR))
            inner = np.zeros(len(data) + 1, np.int8)
            np.add.at(inner, begins, 1)
            np.add.at(inner, stops, -1)
            text, lengths = data[np.cumsum(inner[:-1]) > 0].tobytes(), stops - begins
            if at == 0 and text.startswith(BOM) and lengths[0] >= len(BOM):
                text = text[len(BOM) :]
                lengths[0] -= len(BOM)
            yield at + begins, lengths, text
        if len(ends):
            cut = int(ends[-1]) + 1
            at, held = at + cut, held[cut:]
        if end is not None and at >= end:
            return


class OffsetLines(DataSource):
    """Options: ``paths`` (a JSON list of files, folders or URIs) and ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "offset_lines"

    def schema(self) -> str:
        return "file string, offset long, text string"

    def reader(self, schema) -> OffsetLinesReader:
        return OffsetLinesReader(json.loads(self.options["paths"]), int(self.options.get("splitBytes", SPLIT_BYTES)))


class OffsetLinesReader(DataSourceReader):
    def __init__(self, roots: list[str], split_bytes: int) -> None:
        self.roots, self.split_bytes = roots, split_bytes

    def partitions(self) -> list[ByteRange]:
        return byte_ranges(self.roots, self.split_bytes)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        system, _ = _open(partition.root)
        if partition.end is None:
            stream = system.open_input_stream(partition.path)
        else:
            stream = system.open_input_file(partition.path)
            stream.seek(max(0, partition.start - 1))
        with stream:
            for offsets, lengths, text in lines_of(stream, partition.start, partition.end):
                edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                texts = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(edges.tobytes()), pa.py_buffer(text))
                files = pa.DictionaryArray.from_arrays(np.zeros(len(lengths), np.int32), [partition.name]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([files, pa.array(offsets, pa.int64()), texts], ["file", "offset", "text"])
