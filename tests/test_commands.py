import json

import pytest

from pairforge import __main__ as commands
from pairforge.sources.readers import read_delimited, read_jsonl


@pytest.fixture
def model(tmp_path, monkeypatch):
    """A model module that driver and workers can import."""
    (tmp_path / "toy_models.py").write_text(
        "def upper():\n    return lambda texts: [t.upper() for t in texts]\n"
        "def letters():\n    return lambda texts: [[float(t.count(c)) for c in 'aeiou'] for t in texts]\n"
    )
    return tmp_path


def test_every_job_parses():
    parse = commands.parser().parse_args
    assert parse(["make-splits", "a", "b"]).num_samples == 300_000
    assert parse(["filter", "a", "b", "--model", "m:f"]).semantic_threshold == 0.8
    assert parse(["score", "a", "b", "--lower_case"]).metric == "generation"
    for job in (["translate", "a", "b", "c"], ["sts", "x"]):
        assert parse([*job, "--model", "m:f"]).job == job[0]


def test_split_and_profile_commands(spark, tmp_path, capsys):
    rows = [{"source": f"uma frase {i}", "target": f"outra {i}", "src_len": 3 + i % 4, "tgt_len": 2, "sem_sim": 0.9} for i in range(40)]
    path = tmp_path / "full.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    commands.main(["make-splits", str(path), str(tmp_path / "out"), "--num_samples", "30"])
    assert read_jsonl(spark, str(tmp_path / "out")).count() == 30
    labelled = tmp_path / "labelled.jsonl"
    labelled.write_text("".join(json.dumps({"s1": "um dois", "s2": "três", "label": i % 2}) + "\n" for i in range(10)))
    out = str(tmp_path / "profile")
    commands.main(["profile", out, "--corpus", f"own={path}", "--corpus", f"other={labelled}", "--positive", "other=s1,s2", "--sample", "30"])
    assert "src_len" in capsys.readouterr().out
    means = {r["corpus"]: r for r in spark.read.json(f"{out}/means").collect()}
    assert 3 < means["own"]["src_len"] < 6 and means["other"]["src_len"] == 2
    scores = spark.read.json(f"{out}/scores")
    assert scores.count() == 100 and scores.agg({"n": "sum"}).first()[0] == 30
    lengths = spark.read.json(f"{out}/lengths").filter("corpus = 'own' and measure = 'src_len'")
    assert lengths.agg({"n": "sum"}).first()[0] == 30


def test_generate_and_score_commands(spark, model, tmp_path, monkeypatch, capsys):
    monkeypatch.syspath_prepend(str(model))
    spark.sparkContext.addPyFile(str(model / "toy_models.py"))
    path = tmp_path / "pairs.csv"
    path.write_text("source,target,label\n" + "".join(f"uma  frase {i} aqui,UMA FRASE {i} AQUI,{i % 2}\n" for i in range(20)))
    out, scores = str(tmp_path / "out"), str(tmp_path / "scores")
    arguments = ["generate", out, "--file", str(path), "--model", "toy_models:upper", "--max_samples", "12", "--filter", "label = 1", "--map", "source = concat(source, '!')"]
    commands.main(arguments)
    rows = read_delimited(spark, out).collect()
    assert sorted(r["prediction"] for r in rows) == sorted(f"UMA FRASE {i} AQUI!" for i in range(1, 12, 2))
    commands.main(arguments)  # the output exists: nothing is done
    commands.main(["score", out, scores, "--model", "toy_models:letters"])
    report = {r["metric"]: float(r["value"]) for r in spark.read.option("header", "true").csv(scores).collect()}
    assert set(report) == {"bleu", "self_bleu", "ibleu", "sbert"}
    shown = capsys.readouterr().out
    assert all(f"{v:g}" in shown for v in report.values())
    # New predictions replace the report.
    (tmp_path / "other.tsv").write_text("source\ttarget\tprediction\na b c d\ta b c d\ta b c d\n")
    commands.main(["score", str(tmp_path / "other.tsv"), scores])
    assert {r["metric"]: float(r["value"]) for r in spark.read.option("header", "true").csv(scores).collect()}["bleu"] == 100.0


def test_loader_names_a_function(model, monkeypatch):
    monkeypatch.syspath_prepend(str(model))
    assert commands.loader("toy_models:upper")()(["a"]) == ["A"]
