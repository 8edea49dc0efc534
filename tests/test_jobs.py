"""Checked expressions, whole outputs, counted and rejected rows, shared models."""

import json

import pytest
from pyspark.sql import functions as F

from pairforge.operators.columns import map_columns
from pairforge.operators.counts import Counts
from pairforge.operators.inference import MODELS, infer
from pairforge.operators.prune import filter_rows
from pairforge.plans import filter_pairs, generate, make_splits
from pairforge.runtime import finished, read_manifest, write_whole
from pairforge.sources import checked, writers
from tests.conftest import plan_of
from tests.test_sources import jobs_started


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([(i, f"s{i}", "t" * i) for i in range(40)], "pair_id long, source string, target string").repartition(4)


@pytest.mark.parametrize(
    ("expression", "name"),
    [
        ("java_method('java.lang.System', 'getProperty', 'user.home') is not null", "java_method"),
        ("length(reflect('java.util.UUID', 'randomUUID')) > 0", "reflect"),
        ("TRY_REFLECT('java.lang.Math', 'abs', 1) = '1'", "try_reflect"),
        ("rand() < 0.5", "rand"),
        ("uuid() > source", "uuid"),
        ("monotonically_increasing_id() > 3", "monotonically_increasing_id"),
        ("pair_id in (select 1)", "subquery"),
        ("(select max(id) from range(3)) > 1", "subquery"),
        ("exists (select 1)", "subquery"),
        ("max(pair_id) > 3", "one row"),
        ("row_number() over (order by pair_id) > 3", "one row"),
        ("explode(array(true))", "one row"),
    ],
)
def test_expressions_that_are_refused(pairs, expression, name):
    with pytest.raises(ValueError, match=name):
        filter_rows(pairs, expression)
    with pytest.raises(ValueError, match=name):
        map_columns(pairs, f"a = {expression}")


def test_expressions_that_are_fine(pairs):
    assert filter_rows(pairs, "pair_id > 3 and length(target) % 2 = 0 and source like 's%'").count() == 18
    made = map_columns(pairs, "a = transform(split(source, ''), x -> upper(x)); b = size(a) + coalesce(pair_id, 0)")
    assert made.filter("b > 0").count() == 40
    assert "reflect" not in plan_of(filter_rows(pairs, "source <> 'reflect'")).split("Filter")[0]


def test_an_output_shows_when_it_is_whole(spark, pairs, tmp_path):
    path = str(tmp_path / "out")

    def broken(df, to):
        writers.write_jsonl(df, to)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        write_whole(pairs, path, broken)
    assert not finished(spark, path) and not (tmp_path / "out").exists()
    assert write_whole(pairs, path, writers.write_jsonl)
    manifest = read_manifest(spark, path)
    files = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert manifest["rows"] == 40 and {f["name"]: f["bytes"] for f in manifest["files"]} == {p.name: p.stat().st_size for p in files}
    assert jobs_started(spark, lambda: write_whole(pairs, path, writers.write_jsonl)) == 0
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    assert spark.read.json(path).count() == 40


def test_a_job_cut_short_is_done_again(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"source": f"s{i}", "target": "t"}) + "\n" for i in range(30)))
    out = tmp_path / "out"
    (out / "_temporary" / "0").mkdir(parents=True)
    (out / "part-0.json").write_text('{"source": "old"')
    make_splits.run(spark, str(tmp_path / "in.jsonl"), str(out), 10)
    assert finished(spark, str(out)) and spark.read.json(str(out)).count() == 10
    assert read_manifest(spark, str(out))["rows"] == 10
    aside = [p for p in tmp_path.iterdir() if ".partial-" in p.name]
    assert len(aside) == 1 and (aside[0] / "part-0.json").exists()
    assert jobs_started(spark, lambda: make_splits.run(spark, str(tmp_path / "in.jsonl"), str(out), 10)) == 0


def test_the_filter_says_what_each_step_keeps(spark, tmp_path):
    rows = [("casa azul clara", "casa azul escura"), ("a", "a b c d"), ("mesmo", "mesmo"), ("(x) sim senhor", "sim senhora")]
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"source": s, "target": t}) + "\n" for s, t in rows))

    def load():
        return lambda texts: [[float(t.count(c)) for c in "abcdfsim"] for t in texts]

    out = str(tmp_path / "out")
    assert filter_pairs.run(spark, str(tmp_path / "in.jsonl"), out, load) == {
        "in": 4, "not_identical": 3, "length_ratio": 2, "scored": 2, "out": 2
    }
    assert filter_pairs.run(spark, str(tmp_path / "in.jsonl"), out, load) == {}


def test_counts(spark):
    counts = Counts()
    df = counts.at("few", counts.at("all", spark.range(50)).filter("id < 5"))
    assert "CollectMetrics" in plan_of(df)
    df.collect()
    assert counts.result() == {"all": 50, "few": 5}
    with pytest.raises(ValueError):
        counts.at("all", df)


def test_rejected_rows_have_a_reason_and_a_place(spark, tmp_path):
    lines = ['{"source": "a", "target": "b"}', "", '{"source": "c"}', '{"source": "d", ', "[1]", '{"source": "é", "target": ""}', '{"source": 5, "target": "x"}', "  "]
    data = "\n".join(lines).encode()
    (tmp_path / "in.jsonl").write_bytes(data)
    schema = "source string, target string, n int"
    checks = {"no target": "target is not null", "empty": "length(target) > 0"}
    df = checked.read_checked_jsonl(spark, str(tmp_path / "in.jsonl"), schema, checks)
    assert plan_of(df).count("Scan") == 1
    got = [(r.source, r.target, r.reason, r.text) for r in df.orderBy("offset").collect()]
    assert got == [
        ("a", "b", None, None),
        ("c", None, "no target", lines[2]),
        (None, None, checked.NO_JSON, lines[3]),
        (None, None, checked.NO_JSON, lines[4]),
        ("é", "", "empty", lines[5]),
        ("5", "x", None, None),
    ]
    for r in df.filter("reason is not null").collect():
        assert data[r.offset :].startswith(r.text.encode()) and r.file == "in.jsonl"
    out = str(tmp_path / "out")
    assert checked.write_checked(df, out) and not checked.write_checked(df, out)
    written = spark.read.json(out)
    assert written.filter("rejected = 'true'").count() == 4 and written.filter("rejected = 'false'").count() == 2
    with pytest.raises(ValueError, match="reason"):
        checked.read_checked_jsonl(spark, out, "reason string")


def marking(folder, tag):
    """A model that leaves a file for every load, and one for every batch it sees."""

    def load():
        import os
        import uuid

        open(os.path.join(folder, f"{tag}-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: [[float(len(t))] for t in texts]

    return load


def test_scoring_two_columns_loads_one_model_a_worker(spark, pairs, tmp_path):
    table = pairs.withColumn("prediction", F.concat("source", F.lit("x")))
    load = marking(str(tmp_path), "m")
    for _ in range(2):
        generate.score(table, "generation", "source", "target", "prediction", load=load).collect()
    loads = [p.name.split("-")[1] for p in tmp_path.iterdir()]
    assert loads and len(loads) == len(set(loads))


def test_old_models_make_room(spark, pairs, tmp_path):
    one = pairs.coalesce(1)
    for i in [0, 1, 2, 0]:
        infer(one, ["source"], "y", "array<double>", marking(str(tmp_path), f"m{i}"), name=f"m{i}").collect()
    assert MODELS == 2 and len([p for p in tmp_path.iterdir() if p.name.startswith("m1")]) >= 1


def test_batches_hold_rows_of_like_length_and_keep_their_order(spark):
    rows = [(i, "x" * (i * 37 % 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    out = infer(df, ["t"], "y", "array<int>", lambda: lambda ts: [[len(t), max(map(len, ts)) - min(map(len, ts))] for t in ts], 10)
    got = out.collect()
    assert [r.i for r in got] == list(range(200)) and all(r.y[0] == len(r.t) for r in got)
    assert max(r.y[1] for r in got) <= 4
