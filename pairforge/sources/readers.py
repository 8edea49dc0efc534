"""Readers. Nothing is inferred from the data, and each gives a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import fields
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.labels import entailment_code, parse_similarity
from pairforge.functions.text import strip
from pairforge.operators.prune import require_labels
from pairforge.runtime import ship
from pairforge.schema import PAIRS, XML_PAIRS
from pairforge.sources.offsets import SPLIT_BYTES, OffsetLines
from pairforge.sources.xml_scan import Cutter, Lanes, Scanner, Start, Summary, compose

# Tab-separated text as pandas writes it: quotes are doubled inside quotes. A row with
# too few or too many fields fails the job, whichever columns are asked for.
TSV = {
    "sep": "\t",
    "header": "true",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "enforceSchema": "false",
    "mode": "FAILFAST",
    "columnPruning": "false",
}


# Backslashes first: the others put new ones in.
ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"))


def read_jsonl(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = PAIRS
) -> DataFrame:
    """JSON lines; a line that is no JSON fails the job.

    Without a ``schema`` every field is kept with the type it has in the JSON, in
    order of name: quoted digits stay text. That takes one more pass over the input.
    """
    reader = spark.read.option("mode", "FAILFAST")
    return (reader if schema is None else reader.schema(schema)).json(path)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    delimiter: str = "\t",
    one_line: bool = False,
) -> DataFrame:
    """Delimited text with a header, every column a string named by it.

    With a ``schema`` the header must agree with it. Quoted fields may span lines,
    so a file is one split. With ``one_line`` rows do not, as ``write_predictions``
    stores them on request: files of any size are split, and escapes are undone.
    """
    options = {**TSV, "sep": delimiter, "multiLine": "false" if one_line else "true"}
    reader = spark.read.options(**options)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if not one_line:
        return df
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({name: unescape_lines(F.col(name)) for name in strings})


def escape_lines(text: Column) -> Column:
    """Backslashes, line ends and NUL as two-character escapes."""
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape_lines(text: Column) -> Column:
    """The inverse of ``escape_lines``."""
    # Escaped text holds no NUL, so that can stand for a backslash of the text meanwhile. Then
    # every backslash left opens an escape, and one that stands alone at the end means NUL.
    marked = F.replace(text, F.lit("\\\\"), F.lit("\0"))
    for plain, escaped in ESCAPES[1:-1]:
        marked = F.replace(marked, F.lit(escaped), F.lit(plain))
    marked = F.replace(marked, F.lit("\\0"), F.lit("\\"))
    parts = F.transform(F.split(marked, r"\x00"), lambda part: F.replace(part, F.lit("\\"), F.lit("\0")))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(parts, "\\")).otherwise(text)


def with_row_number(df: DataFrame, name: str = "pair_id") -> DataFrame:
    """Number the rows of a table just read from files: 0, 1, ... in path and file order.

    A first scan counts the rows of every input split, a second one numbers them from the
    counts of the splits before, so no row is written or moved, and the numbers do not
    depend on how the files are cut. The table of counts is collected: it has one short row
    for each split, which the driver lists anyway to plan a scan. Both scans must see the
    same files and settings; a row that the first one did not count fails the job.
    """
    spark = df.sparkSession
    rows = df.select(
        *df.columns,
        F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("_chunk"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    counted = rows.groupBy("_chunk").agg(
        F.min("_file").alias("file"),
        F.max("_file").alias("last_file"),
        F.min("_start").alias("start"),
        F.max("_start").alias("last_start"),
        F.min("_seq").alias("first"),
        F.count(F.lit(1)).alias("n"),
        # Some readers make rows of blank lines when no column is asked for.
        F.max(F.col(f"`{df.columns[0]}`").isNull()).alias("read"),
    )
    splits, before = [], 0
    for r in sorted(counted.collect(), key=lambda r: (r["file"], r["start"])):
        if (r["file"], r["start"]) != (r["last_file"], r["last_start"]):
            raise ValueError("two input splits share a hash")
        splits.append((r["_chunk"], r["first"], r["n"], before))
        before += r["n"]
    table = spark.createDataFrame(splits, "_chunk long, _first long, _n long, _before long")
    place = F.col("_seq") - F.col("_first")
    counted_before = (place >= 0) & (place < F.col("_n"))
    number = F.when(counted_before, place + F.col("_before")).otherwise(
        F.raise_error(F.lit("a row was not there when rows were counted")).cast("long")
    )
    numbered = rows.join(F.broadcast(table), "_chunk", "left")
    return numbered.select(number.alias(name), *[F.col(f"`{c}`") for c in df.columns])


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_no, text) over files in path order. Lines end at LF, CR or CRLF."""
    return with_row_number(spark.read.text(path), "line_no").withColumnRenamed("value", "text")


def read_offset_lines(
    spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """(file, offset, text): every line with the byte at which it begins, in one pass.

    Files are cut at any byte and read by as many tasks as ``split_bytes`` asks for; the rows
    are the same for every cut. ``file`` is relative to the path given.
    """
    ship(spark)
    spark.dataSource.register(OffsetLines)
    paths = [path] if isinstance(path, str) else list(path)
    options = {"paths": json.dumps(paths), "splitBytes": str(split_bytes)}
    return spark.read.format(OffsetLines.name()).options(**options).load()


def read_stripped_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_lines(spark, path).withColumn("text", strip(F.col("text")))


def annotated_pairs(raw: DataFrame, need_labels: bool, force: bool = False) -> DataFrame:
    """Typed annotated pairs from the attribute strings of an XML scan."""
    pairs = raw.select(
        F.col("_id").alias("id"),
        F.nullif(F.col("t"), F.lit("")).alias("t"),
        F.nullif(F.col("h"), F.lit("")).alias("h"),
        entailment_code(F.col("_entailment"), force).alias("entailment"),
        parse_similarity(F.col("_similarity"), force).alias("similarity"),
    )
    return require_labels(pairs) if need_labels else pairs


ELEMENT = "pair"
_LANE = [f.name for f in fields(Summary)]


def _in_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut where the input split changes, with the split's hash; the second column holds it."""
    for batch in batches:
        chunks = np.asarray(batch.column(1))
        edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:], strict=False):
            if start < stop:
                yield int(chunks[start]), batch.slice(start, stop - start)


def _parsed(elements: Iterable[str]) -> pa.RecordBatch:
    """Attributes and texts of elements, as an XML parser gives them."""
    rows = []
    for element in map(ElementTree.fromstring, elements):
        t, h = element.find("t"), element.find("h")
        own = element.attrib
        rows.append(
            (own.get("id"), own.get("entailment"), own.get("similarity"), None if t is None else t.text, None if h is None else h.text)
        )
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], XML_PAIRS.names)


def read_xml(
    spark: SparkSession, path: str | list[str], need_labels: bool, force: bool = False
) -> DataFrame:
    """Annotated pairs from ``<pair id entailment similarity><t/><h/></pair>`` elements.

    A file of any size is read by many tasks, see ``xml_scan``: one scan finds out where in
    the markup each input split begins, a second one cuts the elements out and parses
    them. Elements that go over a border of splits are put together from their records, which
    a third scan picks by number. Broken markup, pairs inside pairs, document types with
    declarations of their own and encodings other than UTF-8 fail the job. A pair is parsed
    by itself, so it must not use a namespace prefix that is declared further up.
    """
    ship(spark)
    records = spark.read.option("lineSep", ">").text(path).select(
        F.col("value"),
        F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("chunk"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
    )
    scanner = Scanner(ELEMENT)

    def summarise(batches):
        chunk, lanes, place = None, None, None

        def row():
            flat = [getattr(lane, name) for lane in lanes.lanes for name in _LANE]
            return pa.RecordBatch.from_pylist([{**place, "lanes": flat}], summaries)

        for found, batch in _in_splits(batches):
            if found != chunk:
                if lanes:
                    yield row()
                chunk, lanes = found, Lanes(scanner)
                place = {n: batch.column(i)[0].as_py() for i, n in enumerate(batch.schema.names) if n != "value"}
            lanes.feed(batch.column(0).to_pylist())
        if lanes:
            yield row()

    summaries = pa.schema(
        [("chunk", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("lanes", pa.list_(pa.int64()))]
    )
    # One short row for each input split.
    found = records.mapInArrow(summarise, "chunk long, file string, start long, seq long, lanes array<long>").collect()
    files: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["file"], r["start"])):
        files.setdefault(r["file"], []).append(r)
    starts: dict[int, Start] = {}
    over = []
    for number, (file, splits) in enumerate(files.items()):
        width = len(_LANE)
        lanes = [[Summary(*r["lanes"][i : i + width]) for i in range(0, len(r["lanes"]), width)] for r in splits]
        for r, lane, start in zip(splits, lanes, compose(lanes, file), strict=True):
            if r["chunk"] in starts:
                raise ValueError("two input splits share a hash")
            starts[r["chunk"]] = start
            if start.head >= 0 or start.tail is not None:
                last = start.begun + lane[start.state].begun - 1
                over.append((r["chunk"], r["seq"], start.head, start.tail, f"{number}:{start.begun - 1}", f"{number}:{last}"))
    shared = spark.sparkContext.broadcast(starts)

    def cut(batches):
        chunk, cutter = None, None
        for found, batch in _in_splits(batches):
            if found != chunk:
                chunk, cutter = found, Cutter(scanner, shared.value[found])
            yield _parsed(cutter.feed(batch.column(0).to_pylist()))

    pairs = records.mapInArrow(cut, XML_PAIRS)
    if over:
        borders = spark.createDataFrame(over, "chunk long, _first long, head long, tail long, _before string, _after string")
        place = F.col("seq") - F.col("_first")
        pieces = records.join(F.broadcast(borders), "chunk").select(
            F.when(place <= F.col("head"), F.col("_before")).when(place >= F.col("tail"), F.col("_after")).alias("element"),
            F.struct("start", "seq", "value").alias("piece"),
        )
        joined = pieces.filter("element IS NOT NULL").groupBy("element").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
        text = F.concat(F.array_join("pieces.value", ">"), F.lit(">"))
        texts = joined.select(F.substring(text, F.instr(text, "<"), F.lit(2**31 - 1)).alias("text"))
        pairs = pairs.unionByName(
            texts.mapInArrow(lambda batches: (_parsed(b.column(0).to_pylist()) for b in batches), XML_PAIRS)
        )
    return annotated_pairs(pairs, need_labels, force)


def read_named(
    spark: SparkSession, name: str, config: str | None = None, split: str | None = None
) -> DataFrame:
    """A catalog table by name, or a Parquet folder by path; optionally one config and one split of it."""
    is_path = "/" in name
    df = spark.read.parquet(name) if is_path else spark.table(name)
    if config is not None:
        df = df.filter(F.col("config") == config)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df
