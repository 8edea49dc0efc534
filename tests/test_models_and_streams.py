import json

import pytest
from pyspark.sql import functions as F

from pairforge.operators.inference import infer
from pairforge.plans import filter_pairs, generate, profile_corpora, sts
from pairforge.plans.filter_pairs import clean_and_prune
from pairforge.streaming.pairs import read_pair_stream, write_clean_stream
from tests.conftest import optimized, plan_of


@pytest.fixture
def pairs(spark):
    rows = [(i, f"(x) casa {'a' * (i % 7)} d’água {i}", f"casa {'b' * (i % 5)} {i} fim") for i in range(60)]
    return spark.createDataFrame(rows, "pair_id long, source string, target string").repartition(3)


def test_infer_batches_and_loads_once_per_worker(spark, pairs, tmp_path):
    marks = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(marks, uuid.uuid4().hex), "w").close()
        return lambda texts: [len(texts)] * len(texts)

    sized = infer(pairs.repartition(16), ["source"], "batch", "int", load, batch_size=4)
    assert sized.agg(F.max("batch")).first()[0] <= 4
    assert sized.count() == 60
    assert len(list(tmp_path.iterdir())) <= 8  # one per worker, not one per task


def test_infer_rejects_a_short_answer(pairs):
    with pytest.raises(Exception, match="values for"):
        infer(pairs, ["source"], "y", "int", lambda: lambda texts: [1]).collect()


def test_filter_on_output_runs_the_model_once(pairs):
    scored = infer(pairs, ["source"], "y", "int", lambda: lambda t: [len(x) for x in t])
    assert optimized(scored.filter("y > 3 and y < 90")).count("MapInArrow") == 1


def test_cheap_filters_run_below_the_model(spark, pairs):
    def load():
        return lambda texts: [[float(t.count(c)) for c in "abcdfsim"] for t in texts]

    scored = filter_pairs.filter_pairs(
        pairs, lambda df: filter_pairs.score_with_model(df, load), 0.5, 0.6
    )
    plan = optimized(scored)
    model = plan.index("MapInArrow")
    assert plan.index("sem_sim") < model < plan.index("regexp_extract_all")
    rows = scored.collect()
    assert rows and all(r["sem_sim"] > 0.6 for r in rows)
    assert {"src_len", "tgt_len", "sem_sim"} <= set(scored.columns)


def test_filter_run(spark, tmp_path):
    rows = [("casa azul clara", "casa azul escura"), ("a", "a b c d"), ("mesmo", "mesmo"), ("(x) sim senhor", "sim senhora")]
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"source": s, "target": t}) + "\n" for s, t in rows))

    def load():
        return lambda texts: [[float(t.count(c)) for c in "abcdfsim"] for t in texts]

    filter_pairs.run(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), load)
    got = spark.read.schema("source string, target string, src_len int, sem_sim double").json(str(tmp_path / "out"))
    assert {r["source"] for r in got.collect()} == {"casa azul clara", "sim senhor"}


def test_generate_and_score(spark, pairs, tmp_path):
    def load():
        return lambda texts: [f"  {t[5:]} " for t in texts]

    out = generate.generate(pairs, load, "source", "target", "say: ")
    assert out.columns == ["source", "target", "prediction"]
    row = out.first()
    assert row["prediction"] == row["source"].strip()
    path, report = str(tmp_path / "p"), str(tmp_path / "r")
    generate.run_generate(spark, pairs, load, path, source="source", target="target")
    table = generate.run_score(spark, path, report, lower_case=True)
    assert {r["metric"] for r in table.collect()} == {"bleu", "self_bleu", "ibleu"}
    assert spark.read.csv(report, header=True).count() == 3


def test_sts(spark):
    rows = [("1", "abc", "abc", None, 5.0), ("2", "abc", "dddf", None, 1.0), ("3", "abab", "ab", None, 4.0)]
    df = spark.createDataFrame(rows, "id string, t string, h string, entailment int, similarity double")

    def load():
        return lambda texts: [[float(t.count(c)) for c in "abcdfsim"] for t in texts]

    got = sts.evaluate_sts(df, load).first()
    assert 0.9 < got["pearson"] <= 1.0 and 0 <= got["mse"] < 0.1


def test_sts_batches_take_either_naming(spark, pairs):
    other = pairs.withColumnsRenamed({"source": "premise", "target": "hypothesis"})
    a = generate.sts_batches(pairs, 16).orderBy("pair_id").collect()
    assert a == generate.sts_batches(other, 16).orderBy("pair_id").collect()


def test_profiles(spark, pairs):
    got = {r["corpus"]: r for r in profile_corpora.profile_corpora({"a": pairs, "b": pairs.limit(10)}).collect()}
    assert set(got) == {"a", "b"} and got["a"]["src_len"] > 1
    counted = clean_and_prune(pairs).withColumn("sem_sim", F.rand(1))
    tables = profile_corpora.histograms(counted.drop("sem_sim"), sample=20)
    assert tables["src_len"].agg(F.sum("n")).first()[0] == 20


def test_stream_equals_batch(spark, pairs, tmp_path):
    source = tmp_path / "in"
    pairs.write.json(str(source))
    arriving = read_pair_stream(spark, str(source))
    assert arriving.isStreaming
    query = write_clean_stream(
        arriving, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True
    )
    query.awaitTermination()
    schema = "pair_id long, source string, target string, src_len int, tgt_len int"
    got = spark.read.schema(schema).json(str(tmp_path / "out"))
    want = clean_and_prune(pairs).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cleaning_plans_have_no_shuffle_and_no_python(pairs, spark, tmp_path):
    pairs.write.json(str(tmp_path / "in"))
    rows = spark.read.schema("source string, target string").json(str(tmp_path / "in"))
    plan = plan_of(clean_and_prune(rows))
    assert "Exchange" not in plan and "Python" not in plan


def test_infer_leaves_other_columns_and_nulls_alone(spark):
    import datetime as dt
    from decimal import Decimal

    rows = [
        (2**53 + 1, Decimal("1.10"), dt.datetime(2024, 5, 6, 7, 8, 9, 123456), [1, None, 3], {"a": 1}, 1.5),
        (None, None, None, None, None, None),
        (-(2**63), Decimal("-3.00"), dt.datetime(1960, 1, 1), [], {}, float("nan")),
    ]
    df = spark.createDataFrame(rows, "n long, d decimal(20,2), t timestamp, a array<int>, m map<string,int>, x double")

    def load():
        return lambda n, x: [f"{v is None} {w is None}" for v, w in zip(n, x, strict=True)]

    got = infer(df, ["n", "x"], "seen", "string", load).collect()
    assert [r["seen"] for r in got] == ["False False", "True True", "False False"]
    for before, after in zip(rows, got, strict=True):
        assert [str(v) for v in before] == [str(v) for v in after[:-1]]
