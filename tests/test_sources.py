import gzip
import io
import json
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairforge import runtime
from pairforge.operators import columns, prune
from pairforge.operators.align import drop_last, zip_lines
from pairforge.plans import make_splits, parallel_text
from pairforge.runtime import durable, exists, fresh_path, scratch, shared_dir
from pairforge.sources import readers, splits, writers
from pairforge.sources.offsets import lines_of

XML = """<?xml version="1.0" encoding="utf-8"?>
<entailment-corpus>
<pair id="1" entailment="None" similarity="1.5"><t> a  b </t><h>c &amp; d</h></pair>
<pair id="2" entailment="ENTAILMENT" similarity="4"><t>e</t><h>f</h></pair>
<pair id="3" entailment="Paraphrase"><t>g</t><h></h></pair>
<pair id="4" entailment="odd" similarity="2.0"><t>i</t><h>j</h></pair>
<pair id="5" entailment="" similarity="3.0"><t>k</t><h>l</h></pair>
<pair id="6" similarity="5.0"><t>m</t><h>n</h></pair>
{more}</entailment-corpus>
"""
UNLABELLED = '<pair id="7"><t>o</t><h>p</h></pair>\n'


@pytest.fixture
def xml(tmp_path):
    def write(more=""):
        path = tmp_path / "pairs.xml"
        path.write_text(XML.format(more=more), encoding="utf-8")
        return str(path)

    return write


def test_xml(spark, xml):
    rows = {r["id"]: r for r in readers.read_xml(spark, xml(), need_labels=True).collect()}
    assert (rows["1"]["t"], rows["1"]["h"]) == (" a  b ", "c & d")
    assert [rows[i]["entailment"] for i in "123456"] == [0, 1, 2, 3, None, None]
    assert [rows[i]["similarity"] for i in "123456"] == [1.5, 4.0, None, 2.0, 3.0, 5.0]
    assert rows["3"]["h"] is None


def test_xml_forced(spark, xml):
    rows = {r["id"]: r for r in readers.read_xml(spark, xml(UNLABELLED), True, force=True).collect()}
    assert (rows["7"]["entailment"], rows["7"]["similarity"]) == (3, 0.0)
    assert rows["3"]["similarity"] == 0.0


def test_xml_without_labels(spark, xml):
    path = xml(UNLABELLED)
    loose = readers.read_xml(spark, path, need_labels=False)
    good, bad = prune.split_by_labels(loose)
    assert good.count() == 6 and [r["id"] for r in bad.collect()] == ["7"]
    with pytest.raises(Exception, match="its id is 7"):
        readers.read_xml(spark, path, need_labels=True).collect()


def test_lines_keep_their_numbers(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(" um \r\ndois x\ntrês\rquatro\n\ncinco".encode())
    got = readers.read_stripped_lines(spark, str(path)).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == list(enumerate(["um", "dois x", "três", "quatro", "", "cinco"]))


def test_lines_over_files_and_splits(spark, tmp_path):
    """Files of very different sizes are read out of order and in pieces."""
    sizes = {"b.txt": 3000, "a.txt": 7, "c.txt": 900}
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(f"{name} {i} {'x' * (i % 50)}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = readers.read_lines(spark, str(tmp_path))
        got = [r["text"].rsplit(" ", 1)[0] for r in lines.orderBy("line_no").collect()]
        numbers = sorted(r["line_no"] for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [f"{name} {i}" for name in sorted(sizes) for i in range(sizes[name])]
    assert numbers == list(range(3907))


def test_alignment_cuts_each_side_first(spark, tmp_path):
    (tmp_path / "en").write_text("a\nb\nc\nd\n")
    (tmp_path / "pt").write_text("1\n2\n3\n")
    en = readers.read_stripped_lines(spark, str(tmp_path / "en"))
    pt = readers.read_stripped_lines(spark, str(tmp_path / "pt"))
    got = zip_lines(drop_last(en), drop_last(pt)).orderBy("line_no").collect()
    assert [(r["source"], r["target"]) for r in got] == [("a", "1"), ("b", "2")]


def test_parallel_text_run(spark, tmp_path):
    (tmp_path / "en").write_text("one two\nthree\nfour five six\nnoise\n")
    (tmp_path / "pt").write_text("um dois\ntrês\nquatro cinco seis\nruído\n")

    def load():
        return lambda texts: [t.upper() for t in texts]

    out = str(tmp_path / "out")
    arguments = (spark, str(tmp_path / "en"), str(tmp_path / "pt"), out, load)
    parallel_text.run(*arguments, num_examples=3, trim_word_count=1)
    rows = {(r["source"], r["target"]) for r in readers.read_jsonl(spark, out).collect()}
    assert rows == {("ONE TWO", "um dois"), ("FOUR FIVE SIX", "quatro cinco seis")}
    parallel_text.run(*arguments)  # the output exists: left alone
    assert readers.read_jsonl(spark, out).count() == 2


TEXTS = ['say "x"', "tab\there", "line\nbreak", "a,b", "ünï — 😀", "\\back\\slash", "'", 'end"', " pad "]


def test_tsv_round_trip(spark, tmp_path):
    rows = [(t, t + "!", t[::-1]) for t in TEXTS]
    path = str(tmp_path / "p")
    writers.write_predictions(spark.createDataFrame(rows, "source string, target string, prediction string"), path)
    assert sorted(map(tuple, readers.read_delimited(spark, path).collect())) == sorted(rows)


def test_tsv_as_pandas_writes_it(spark, tmp_path):
    import pandas as pd

    rows = [(t, t + "!", t[::-1]) for t in TEXTS]
    path = tmp_path / "p.csv"
    pd.DataFrame(rows, columns=["source", "target", "prediction"]).to_csv(path, index=False, sep="\t")
    assert sorted(map(tuple, readers.read_delimited(spark, str(path)).collect())) == sorted(rows)


def test_jsonl_is_raw_utf8_with_nulls(spark, tmp_path):
    path = tmp_path / "j"
    writers.write_jsonl(spark.createDataFrame([("é😀", None)], "source string, target string").coalesce(1), str(path))
    (part,) = path.glob("part-*")
    assert part.read_text(encoding="utf-8") == '{"source":"é😀","target":null}\n'
    assert json.loads(part.read_text())["target"] is None
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.write_jsonl(spark.range(1), str(path))
    writers.write_jsonl(spark.range(1), str(path), skip_existing=True)


def test_digits_stay_text(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"source": "123", "target": "4.0"}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "d.jsonl")).first() == ("123", "4.0")


def test_split_suffixes(spark, tmp_path):
    known = {"a.csv": "csv", "a.json": "json", "a.jsonl": "json", "a.jsonl.gz": "json", "a.csv.gz": "csv"}
    assert {n: splits.file_format(n) for n in known} == known
    assert splits.file_format("a.txt") is splits.file_format("gz") is None
    with gzip.open(tmp_path / "t.jsonl.gz", "wt") as f:
        f.write('{"source": "a", "target": "b"}\n')
    (tmp_path / "v.csv").write_text('source;target\n"c;""x""";d\n')
    tables = splits.load_splits(
        spark, {"train": str(tmp_path / "t.jsonl.gz"), "validation": str(tmp_path / "v.csv")}, delimiter=";"
    )
    assert tables["train"].first() == ("a", "b") and tables["validation"].first() == ('c;"x"', "d")
    with pytest.raises(ValueError, match="neither csv nor json"):
        splits.load_splits(spark, {"test": "x.parquet"})
    with pytest.raises(ValueError):
        splits.load_splits(spark, {})


def test_prepare_cuts_before_it_filters(spark):
    df = spark.createDataFrame([(i, f"s{i}  x", "t") for i in range(6)], "pair_id long, source string, target string")
    ready = splits.prepare(
        {"train": df}, max_rows={"train": 4}, predicate="pair_id >= 2", mapping="n = length(source)"
    )["train"]
    assert [(r["pair_id"], r["n"]) for r in ready.orderBy("pair_id").collect()] == [(2, 4), (3, 4)]


def test_prepare_takes_the_first_rows_of_the_file(spark, tmp_path):
    for part in ("b", "a"):
        n = 400 if part == "a" else 900
        rows = [{"source": f"{part} {i}", "target": "x"} for i in range(n)]
        (tmp_path / f"{part}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        loaded = readers.read_jsonl(spark, str(tmp_path))
        ready = splits.prepare({"train": loaded, "test": loaded}, max_rows={"train": 402})
        got = [r["source"] for r in ready["train"].orderBy("pair_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"a {i}" for i in range(400)] + ["b 0", "b 1"]
    assert "pair_id" not in ready["test"].columns and ready["test"].count() == 1300


def test_make_splits_run(spark, tmp_path):
    path, out = tmp_path / "full.jsonl", str(tmp_path / "splits")
    path.write_text("".join(json.dumps({"source": f"s{i}", "target": f"t{i}", "src_len": 1, "tgt_len": 1, "sem_sim": 0.9}) + "\n" for i in range(50)))
    make_splits.run(spark, str(path), out, 20)
    got = spark.read.schema("source string, split string").json(out)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 16, "validation": 2, "test": 2}
    assert got.select("source").distinct().count() == 20
    make_splits.run(spark, str(path), out, 10)
    assert spark.read.schema("source string").json(out).count() == 20


def test_named_tables(spark, tmp_path):
    rows = spark.createDataFrame([("pt", "a", 1), ("pt", "b", 2), ("en", "a", 3)], "config string, split string, v int")
    path = str(tmp_path / "named")
    rows.write.partitionBy("config", "split").parquet(path)
    assert readers.read_named(spark, path, "pt", "b").first()["v"] == 2
    rows.createOrReplaceTempView("named_rows")
    assert readers.read_named(spark, "named_rows", split="a").agg(F.sum("v")).first()[0] == 4


def test_lines_and_report_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "k int, prediction string").repartition(4)
    writers.write_lines(df, str(tmp_path / "t"), order="k")
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert text.split() == [f"p{i}" for i in range(20)]
    writers.write_report(spark.createDataFrame([("bleu", 1.5)], "metric string, value double"), str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("part-*")
    assert part.read_text() == "metric,value\nbleu,1.5\n"


def test_columns(spark):
    df = spark.createDataFrame([("a", "b", "c")], "x string, y string, z string")
    assert columns.select_roles(df, None, None, None).columns == ["source", "target", "prediction"]
    assert columns.select_roles(df, "y", "x").first() == ("b", "a")
    with pytest.raises(ValueError, match="no column"):
        columns.select_roles(df, "q")
    mapped = columns.map_columns(df, "n = concat(x, ';'); m = concat(n, y); ")
    assert mapped.first()["m"] == "a;b"
    with pytest.raises(ValueError, match="not an assignment"):
        columns.map_columns(df, "n")
    assert columns.rename_roles(df.withColumnsRenamed({"x": "premise", "y": "hypothesis"})).columns == ["source", "target"]
    assert columns.prefix_column(df, "p: ", "x").first()["x"] == "p: a"


def test_filter_edges(spark):
    rows = [(2, 4, 0.8), (3, 4, 0.81), (0, 0, float("nan")), (None, 1, None)]
    df = spark.createDataFrame(rows, "src_len int, tgt_len int, sem_sim double")
    assert [r["src_len"] for r in prune.prune_length_ratio(df).collect()] == [3]
    assert [r["src_len"] for r in prune.above_similarity(df).collect()] == [3]
    words = spark.createDataFrame([("a b",), ("a",), (None,)], "target string")
    assert prune.min_words(words, "target", 1).count() == 1
    assert prune.min_words(words, "target", 0).count() == prune.min_words(words, "target", None).count() == 3
    same = spark.createDataFrame([("a", "a"), ("a", "A"), (None, "a")], "source string, target string")
    assert [r["target"] for r in prune.drop_identical(same).collect()] == ["A"]


@pytest.mark.parametrize("sizes", [(40, 25), (25, 40), (30, 30)])
def test_sampled_alignment_is_exact(spark, sizes):
    def lines(n, mark):
        return spark.createDataFrame([(i, f"{mark}{i}") for i in range(n)], "line_no long, text string")

    for asked in (5, 24, 100):
        got = parallel_text.select_pairs(lines(sizes[0], "f"), lines(sizes[1], "n"), asked).collect()
        assert len(got) == min(asked, min(sizes) - 1)
        assert all(r["source"] == f"f{r['line_no']}" and r["target"] == f"n{r['line_no']}" for r in got)


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


class Unset:
    """A session that names no shared folder."""

    def __init__(self, master):
        self.conf, self.sparkContext = {}, type("Context", (), {"master": master, "applicationId": "x"})


def test_shared_folder_must_be_named_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Unset("yarn"))
    assert shared_dir(Unset("local[2]")) == shared_dir(Unset("local[2]"))


def failing(df):
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|Malformed|malformed"):
        df.collect()


def test_a_broken_json_line_fails(spark, tmp_path):
    path = tmp_path / "broken.jsonl"
    path.write_text('{"source": "a", "target": "b"}\n{"source": "a", \n{"source": "c", "target": "d"}\n')
    failing(readers.read_jsonl(spark, str(path)))
    failing(readers.read_jsonl(spark, str(path)).select("source"))


@pytest.mark.parametrize("row", ["a\tb", "a\tb\tc\td"])
def test_a_row_of_the_wrong_length_fails(spark, tmp_path, row):
    path = tmp_path / "wrong.tsv"
    path.write_text(f"source\ttarget\tprediction\n1\t2\t3\n{row}\n")
    failing(readers.read_delimited(spark, str(path)))
    failing(readers.read_delimited(spark, str(path)).select("source"))


def test_json_without_a_schema_keeps_every_field(spark, tmp_path):
    path = tmp_path / "wide.jsonl"
    path.write_text('{"source": "a", "target": "007", "label": 1}\n{"target": "d", "source": "c", "label": 0}\n')
    df = readers.read_jsonl(spark, str(path), None)
    assert sorted(map(tuple, df.select("source", "target", "label").collect())) == [("a", "007", 1), ("c", "d", 0)]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_xml_is_read_by_many_tasks(spark, tmp_path, small_splits):
    import gzip

    def pair(i):
        if i % 50 == 7:
            return f'<pair id="{i}" similarity="3.0"/>'
        return f'<pair id="{i}" entailment="None" similarity="2.5">\n  <t>a &lt; é {i}\n b</t>\n  <h> h{i} </h>\n</pair>'

    body = "<?xml version='1.0'?><corpus>\n<!-- <pair id='x'> -->" + "\n".join(map(pair, range(2000))) + "\n</corpus>"
    (tmp_path / "one.xml").write_text(body, encoding="utf-8")
    df = readers.read_xml(spark, str(tmp_path / "one.xml"), need_labels=True)
    assert df.rdd.getNumPartitions() > 4
    rows = {int(r["id"]): r for r in df.collect()}
    assert sorted(rows) == list(range(2000))
    assert all(rows[i]["t"] == f"a < é {i}\n b" and rows[i]["h"] == f" h{i} " for i in rows if i % 50 != 7)
    assert rows[7]["t"] is None and rows[7]["similarity"] == 3.0
    (tmp_path / "many").mkdir()
    with gzip.open(tmp_path / "many" / "a.xml.gz", "wt", encoding="utf-8") as out:
        out.write(body)
    (tmp_path / "many" / "b.xml").write_text("<corpus></corpus>")
    assert readers.read_xml(spark, str(tmp_path / "many"), need_labels=True).count() == 2000


def test_predictions_on_one_line_are_read_by_many_tasks(spark, tmp_path, small_splits):
    texts = [f'a "b" {i}\n\\n\r\n\\\ttab\\' if i % 3 else f"plain {i}" for i in range(3000)]
    df = spark.createDataFrame([(t, t[::-1], t) for t in texts], "source string, target string, prediction string")
    writers.write_predictions(df.coalesce(1), str(tmp_path / "lines"), one_line=True)
    back = readers.read_delimited(spark, str(tmp_path / "lines"), one_line=True)
    assert back.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, back.collect())) == sorted((t, t[::-1], t) for t in texts)


def jobs_started(spark, run):
    """How many Spark jobs a function starts."""
    tracker, group = spark.sparkContext.statusTracker(), f"count-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_a_second_run_starts_no_job(spark, tmp_path):
    path, out = tmp_path / "in.jsonl", str(tmp_path / "out")
    path.write_text("".join(json.dumps({"source": f"s{i}", "target": "t", "label": i % 2}) + "\n" for i in range(30)))
    assert jobs_started(spark, lambda: make_splits.run(spark, str(path), out, 10)) > 0
    assert jobs_started(spark, lambda: make_splits.run(spark, str(path), out, 10)) == 0
    # All columns of the input and no others are written.
    assert set(spark.read.json(out).columns) == {"source", "target", "label", "split"}

    (tmp_path / "en").write_text("a b\nc d\nx\n")
    (tmp_path / "pt").write_text("um\ndois\ny\n")
    arguments = (spark, str(tmp_path / "en"), str(tmp_path / "pt"), str(tmp_path / "text"), lambda: lambda t: t)
    assert jobs_started(spark, lambda: parallel_text.run(*arguments)) > 0
    assert jobs_started(spark, lambda: parallel_text.run(*arguments)) == 0


def test_jobs_leave_nothing_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path / "shared"))
    (tmp_path / "en").write_text("a b\nc d\nx\n")
    (tmp_path / "pt").write_text("um\ndois\ny\n")
    parallel_text.run(spark, str(tmp_path / "en"), str(tmp_path / "pt"), str(tmp_path / "text"), lambda: lambda t: t)
    assert readers.read_jsonl(spark, str(tmp_path / "text")).count() == 2
    assert [p for p in (tmp_path / "shared").rglob("*") if p.is_file()] == []
    with scratch(spark):
        held = durable(spark.range(3))
        assert held.count() == 3
    kept = durable(spark.range(3))
    assert kept.count() == 3 and len(list((tmp_path / "shared" / "pairforge").iterdir())) == 1


def test_existing_paths(spark, tmp_path):
    assert exists(spark, str(tmp_path)) and not exists(spark, str(tmp_path / "none"))
    assert not exists(spark, fresh_path(spark, "new"))


def plain_lines(data):
    """(offset, text) of the lines of a file, one byte at a time."""
    out, begin, i = [], 0, 0
    while i < len(data):
        if data[i : i + 1] in (b"\n", b"\r"):
            out.append((begin, data[begin:i]))
            i += 2 if data[i : i + 2] == b"\r\n" else 1
            begin = i
        else:
            i += 1
    return out + ([(begin, data[begin:])] if begin < len(data) else [])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bc", b"\n", b"\r", b"\r\n", "é".encode(), b" "]), max_size=40), st.integers(1, 50), st.integers(1, 9))
def test_every_line_is_in_one_byte_range(parts, split, block):
    data, got = b"".join(parts), []
    for start in range(0, len(data), split):
        stream = io.BytesIO(data)
        stream.seek(max(0, start - 1))
        for offsets, lengths, text in lines_of(stream, start, min(start + split, len(data)), block):
            ends = lengths.cumsum()
            got += [(o, text[e - n : e]) for o, n, e in zip(offsets.tolist(), lengths.tolist(), ends.tolist())]
    assert got == plain_lines(data)


def test_lines_by_offset(spark, tmp_path):
    folder = tmp_path / "texts"
    (folder / "deep").mkdir(parents=True)
    contents = {
        "b.txt": b"\xef\xbb\xbffirst\r\nsecond\rthird\n\n",
        "a.txt": "".join(f"line {i} {'é' * (i % 40)}\n" for i in range(2000)).encode(),
        "deep/c.txt": b"no end",
        "empty.txt": b"",
    }
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    (folder / "_hidden").write_bytes(b"x")
    with gzip.open(folder / "d.txt.gz", "wb") as out:
        out.write(contents["a.txt"])
    want = [(n, o, t.removeprefix(b"\xef\xbb\xbf").decode()) for n, d in {**contents, "d.txt.gz": contents["a.txt"]}.items() for o, t in plain_lines(d)]
    for split in (1 << 20, 1000, 77):
        df = readers.read_offset_lines(spark, str(folder), split)
        assert sorted(map(tuple, df.collect())) == sorted(want)
    assert df.rdd.getNumPartitions() > 100
    one = readers.read_offset_lines(spark, f"file://{folder}/b.txt")
    assert [r.text for r in one.collect()] == ["first", "second", "third", ""]
    with pytest.raises(Exception, match="none"):
        readers.read_offset_lines(spark, str(tmp_path / "none")).collect()


def test_row_numbers_do_not_depend_on_how_files_are_cut(spark, tmp_path, small_splits):
    for name in ("a", "b"):
        rows = (json.dumps({"source": f"{name}{i}" * 9, "target": "x"}) + "\n" + "\n" * (i % 7 == 0) for i in range(900))
        (tmp_path / f"{name}.json").write_text("".join(rows))
    seen = []
    for size in ("20000", "7000", "100000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = readers.with_row_number(readers.read_jsonl(spark, str(tmp_path)))
        seen.append({r["pair_id"]: r["source"] for r in df.collect()})
        assert {r[0] for r in df.filter("source like 'a1%'").select("pair_id").collect()} <= set(seen[0])
    assert seen[0] == {i: f"{'ab'[i // 900]}{i % 900}" * 9 for i in range(1800)}
    assert seen[0] == seen[1] == seen[2]


def test_equal_splits_for_every_cut_of_the_input(spark, tmp_path, small_splits):
    (tmp_path / "in.json").write_text("".join(json.dumps({"source": f"s{i}" * 5, "target": "t"}) + "\n" for i in range(3000)))
    dealt = []
    for size in ("20000", "3000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        make_splits.run(spark, str(tmp_path / "in.json"), str(tmp_path / size), 1000)
        dealt.append(sorted((r["split"], r["source"]) for r in spark.read.json(str(tmp_path / size)).collect()))
    assert dealt[0] == dealt[1] and len(dealt[0]) == 1000


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\\\0\n\rn0r", max_size=12), min_size=1, max_size=30))
def test_escapes_are_undone(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    escaped = df.select(readers.escape_lines(F.col("t")).alias("e"))
    assert not any(c in r["e"] for r in escaped.collect() for c in "\0\n\r")
    assert [r[0] for r in escaped.select(readers.unescape_lines(F.col("e"))).collect()] == texts


def test_splits_keep_every_column(spark, tmp_path):
    (tmp_path / "t.csv").write_text("label,source,target\n1,a,b\n0,c,d\n")
    (tmp_path / "v.json").write_text('{"label": 1, "source": "a", "target": "b"}\n{"label": 0, "source": "c", "target": "d"}\n')
    with gzip.open(tmp_path / "w.csv.gz", "wt") as out:
        out.write("source,target,label\na,b,1\nc,d,0\n")
    loaded = splits.load_splits(spark, {"train": str(tmp_path / "t.csv"), "validation": str(tmp_path / "v.json"), "test": str(tmp_path / "w.csv.gz")})
    for df in splits.prepare(loaded, predicate="label = 1", mapping="note = 'a; b'").values():
        assert [(r["source"], r["target"], r["note"]) for r in df.collect()] == [("a", "b", "a; b")]


def test_an_open_quote_in_a_mapping_fails(spark):
    df = spark.range(1)
    for mapping in ("a = 'x", 'a = "x; b = 1', "a = 'x\\'"):
        with pytest.raises(ValueError, match="not closed"):
            columns.map_columns(df, mapping)
    assert columns.map_columns(df, "a = 'x;'; b = a; ").first()["b"] == "x;"
