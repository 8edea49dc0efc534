import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.functions import arrays, labels, vectors
from pairforge.operators import stats
from pairforge.plans.generate import encode_rows


def frame(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


@pytest.mark.parametrize("values", [[3, 3, 5, 9, 9, 8], [1, 2], [0, 10], [4, 4, None, 6]])
def test_length_histogram_is_numpys(spark, values):
    got = stats.length_histogram(frame(spark, values, "int"), "x").orderBy("bin").collect()
    known = [v for v in values if v is not None]
    edges = range(min(known), max(known) + 1)
    n, edges = np.histogram(known, bins=edges)
    density, _ = np.histogram(known, bins=edges, density=True)
    assert [r["n"] for r in got] == n.tolist()
    assert [r["bin"] for r in got] == edges[:-1].tolist()
    assert [r["density"] for r in got] == pytest.approx(density.tolist())


@pytest.mark.parametrize("values", [[7, 7, 7], [], [None]])
def test_length_histogram_without_bins(spark, values):
    assert stats.length_histogram(frame(spark, values, "int"), "x").count() == 0


@pytest.mark.parametrize(
    "values",
    [
        [0.1, 0.2, 0.2, 0.9],
        [5.0, 5.0],
        [i / 100 for i in range(101)],
        [i / 7 for i in range(50)],
        np.random.default_rng(1).normal(size=500).tolist(),
    ],
)
def test_score_histogram_is_numpys(spark, values):
    got = stats.score_histogram(frame(spark, values, "double"), "x").orderBy("bin").collect()
    n, edges = np.histogram(values, bins=100)
    assert [r["n"] for r in got] == n.tolist()
    assert [r["centre"] for r in got] == pytest.approx(((edges[1:] + edges[:-1]) * 0.5).tolist())
    assert [r["proportion"] for r in got] == pytest.approx((n / len(values)).tolist())
    assert sum(r["n"] for r in got) == len(values)


def test_min_max(spark):
    out = stats.min_max_normalise(frame(spark, [1.0, 3.0, 2.0], "double"), "x")
    assert sorted(r["normalised"] for r in out.collect()) == [0.0, 0.5, 1.0]
    flat = stats.min_max_normalise(frame(spark, [2.0, 2.0], "double"), "x")
    assert [r["normalised"] for r in flat.collect()] == [None, None]


def test_profile_rounds_half_even(spark):
    df = spark.createDataFrame([("a", 1, 0.0005), ("a", 2, 0.0005)], "t string, n int, v double")
    assert stats.profile(df).first().asDict() == {"n": 1.5, "v": 0.0}
    assert stats.profile(df, by="t", ignore=["v"]).columns == ["t", "n"]


def test_pearson_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(stats.pearson(F.col("a"), F.col("b")).alias("p")).first()["p"] is None
    assert df.limit(1).agg(stats.pearson(F.col("b"), F.col("b")).alias("p")).first()["p"] is None
    x = np.random.default_rng(2).normal(size=(60, 2))
    rows = spark.createDataFrame(x.tolist(), "a double, b double")
    got = rows.agg(
        stats.pearson(F.col("a"), F.col("b")).alias("p"),
        stats.mean_squared_error(F.col("a"), F.col("b")).alias("m"),
    ).first()
    assert got["p"] == pytest.approx(np.corrcoef(x.T)[0, 1])
    assert got["m"] == pytest.approx(((x[:, 0] - x[:, 1]) ** 2).mean())


def test_cosines(spark):
    rows = [
        ([1.0, 0.0], [1.0, 0.0], 1.0, 1.0),
        ([1.0, 0.0], [-2.0, 0.0], -1.0, -1.0),
        ([1.0, 0.0], [0.0, 3.0], 0.0, 0.0),
        ([0.0, 0.0], [0.0, 3.0], 0.0, 0.5),
        ([0.0, 0.0], [0.0, 0.0], 0.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, c double, p double")
    a, b = F.col("a"), F.col("b")
    for r in df.select(
        "c", "p", vectors.cosine(a, b).alias("x"), vectors.unit_cosine(a, b).alias("u"),
        vectors.paired_cosine_similarity(a, b).alias("y"),
    ).collect():
        assert r["x"] == pytest.approx(r["c"]) and r["u"] == pytest.approx((r["c"] + 1) / 2)
        assert r["y"] == pytest.approx(r["p"])


def test_mean_pool(spark):
    rows = [([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])]
    df = spark.createDataFrame(rows, "v array<array<float>>, m array<int>")
    got = [r[0] for r in df.select(vectors.mean_pool(F.col("v"), F.col("m"))).collect()]
    assert got == [[2.0, 3.0], [0.0, 0.0]]


def test_labels(spark):
    rows = [("None",), ("ENTAILMENT",), ("Paraphrase",), ("what",), ("",), (None,)]
    df = spark.createDataFrame(rows, "e string")
    got = df.select(
        labels.entailment_code(F.col("e")).alias("c"),
        labels.entailment_code(F.col("e"), force=True).alias("f"),
        labels.entailment_label(labels.entailment_code(F.col("e"))).alias("n"),
    ).collect()
    assert [r["c"] for r in got] == [0, 1, 2, 3, None, None]
    assert [r["f"] for r in got] == [0, 1, 2, 3, 3, 3]
    assert [r["n"] for r in got] == ["none", "entailment", "paraphrase", None, None, None]


def test_similarity(column_of):
    assert column_of(["3.5", "", None], labels.parse_similarity) == [3.5, None, None]
    assert column_of(["3.5", "", None], lambda c: labels.parse_similarity(c, True)) == [3.5, 0.0, 0.0]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        column_of(["high"], labels.parse_similarity)


def test_encode_rows(spark):
    df = spark.createDataFrame([([5, 6, 7], [8, 0, 9])], "s array<int>, t array<int>")
    padded = encode_rows(df, "s", "t", 5, 4, pad_id=0).first()
    assert padded["input_ids"] == [5, 6, 7, 0, 0] and padded["attention_mask"] == [1, 1, 1, 0, 0]
    assert padded["labels"] == [8, -100, 9, -100]
    kept = encode_rows(df, "s", "t", 5, 4, pad_id=0, ignore_pad=False).first()
    assert kept["labels"] == [8, 0, 9, 0]
    cut = encode_rows(df, "s", "t", 2, 2).first()
    assert (cut["input_ids"], cut["attention_mask"], cut["labels"]) == ([5, 6], [1, 1], [8, 0])


def test_label_masks(spark):
    df = spark.createDataFrame([([1, 0, 2],)], "a array<int>")
    masked = arrays.mask_labels(F.col("a"), 0)
    got = df.select(masked.alias("m"), arrays.unmask_labels(masked, 0).alias("u"), arrays.count_tokens(F.col("a"), 0).alias("n")).first()
    assert (got["m"], got["u"], got["n"]) == ([1, -100, 2], [1, 0, 2], 2)
