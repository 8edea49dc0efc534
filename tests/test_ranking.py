import hashlib

import pytest
from pyspark.sql import functions as F

from pairforge.operators import ranking
from tests.conftest import plan_of


def order(n, seed=42):
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def ids(df, key="pair_id"):
    return {r[key] for r in df.select(key).collect()}


@pytest.fixture(scope="module")
def table(spark):
    def make(n):
        return spark.range(n, numPartitions=5).withColumnRenamed("id", "pair_id").withColumn(
            "source", F.concat(F.lit("text "), "pair_id")
        )

    return make


@pytest.mark.parametrize("n", [1, 2, 5, 10, 1000])
def test_split_sizes_and_members(table, n):
    got = {}
    for row in ranking.split_80_10_10(table(n)).collect():
        got.setdefault(row["split"], set()).add(row["pair_id"])
    a = round(0.8 * n)
    b = round(0.5 * (n - a))
    want = order(n)
    assert got.get("train", set()) == set(want[:a])
    assert got.get("validation", set()) == set(want[a : a + b])
    assert got.get("test", set()) == set(want[a + b :])


def test_split_of_nothing(table):
    assert ranking.split_80_10_10(table(0)).count() == 0


@pytest.mark.parametrize("n,asked", [(10, 3), (10, 10), (10, 99), (300, 299)])
def test_sample_is_exact(table, n, asked):
    assert ids(ranking.sample_n(table(n), asked)) == set(order(n)[:asked])


@pytest.mark.parametrize("asked", [0, None])
def test_sample_of_everything(table, asked):
    assert ranking.sample_n(table(7), asked).count() == 7


@pytest.mark.parametrize("fraction", [0.0, 0.05, 0.5, 0.8, 1.0])
def test_fraction_rounds_half_even(table, fraction):
    assert ranking.sample_fraction(table(10), fraction).count() == round(fraction * 10)


def test_seed_matters(table):
    df = table(100)
    assert ids(ranking.sample_n(df, 50, seed=1)) == set(order(100, 1)[:50])
    assert ids(ranking.sample_n(df, 50, seed=1)) != ids(ranking.sample_n(df, 50, seed=2))


def test_shuffle_rank_equals_a_global_sort(table):
    got = {r["pair_id"]: r["rank"] for r in ranking.with_shuffle_rank(table(500)).collect()}
    assert got == {i: r + 1 for r, i in enumerate(order(500))}
    assert [r["pair_id"] for r in ranking.shuffle_rows(table(200)).collect()] == order(200)


def test_batches_are_full_but_for_the_last(table):
    rows = ranking.shuffle_batches(table(150), 64).collect()
    sizes = [sum(r["batch_id"] == b for r in rows) for b in range(3)]
    assert sizes == [64, 64, 22]
    assert {(r["batch_id"], r["pos"]) for r in rows} == {(i // 64, i % 64) for i in range(150)}


def test_key_rank_with_gaps_and_duplicated_text(spark):
    keys = [7, -3, 10**15, 0, 2**62, -(2**62), 55, 56]
    df = spark.createDataFrame([(k,) for k in keys], "pair_id long")
    got = {r["pair_id"]: r["rank"] for r in ranking.with_key_rank(df).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    batches = ranking.key_batches(df, 3).collect()
    assert sorted((r["batch_id"], r["pos"]) for r in batches) == [(i // 3, i % 3) for i in range(8)]


@pytest.mark.parametrize("n", [0, 1, 17, 199, 200, 500])
def test_first_n(spark, n, monkeypatch):
    monkeypatch.setattr(ranking, "TOP_KEYS", 5)
    monkeypatch.setattr(ranking, "RANGES", 4)
    keys = [i * i * (-1) ** i for i in range(198)] + [2**62, -(2**62)]
    df = spark.createDataFrame([(k,) for k in keys], "pair_id long")
    assert ids(ranking.first_n(df, n)) == set(sorted(keys)[:n])


def test_first_n_narrows_through_dense_keys(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TOP_KEYS", 3)
    monkeypatch.setattr(ranking, "RANGES", 2)
    df = spark.range(1000).withColumnRenamed("id", "pair_id")
    assert ranking.nth_key(df, 457, "pair_id") == 456


def test_first_n_needs_an_integer_key(spark):
    with pytest.raises(TypeError):
        ranking.first_n(spark.createDataFrame([("a",)], "pair_id string"), 1)


def test_sampling_moves_no_texts(table):
    assert "Exchange" not in plan_of(ranking.split_80_10_10(table(100)))
    plan = plan_of(ranking.split_80_10_10(table(100), unique=True))
    main = plan[plan.rindex("+- Project") :] if "Subquery" not in plan else plan
    # Whatever is shuffled or ranked carries keys and hashes only.
    for line in main.splitlines():
        if "Exchange" in line or "Window" in line:
            assert "source" not in line


@pytest.fixture(scope="module")
def tied(spark):
    """Six keys of five rows each and ten rows without a key."""
    rows = [(i % 6, f"row {i}") for i in range(30)] + [(None, f"null {i}") for i in range(10)]
    return spark.createDataFrame(rows, "pair_id long, source string").repartition(4)


@pytest.mark.parametrize("n", [1, 5, 7, 13, 25, 33, 38, 40, 60])
def test_sizes_are_exact_with_tied_and_null_keys(tied, n):
    least = min(n, 40)
    assert ranking.sample_n(tied, n).count() == least
    assert ranking.sample_n(tied, n).distinct().count() == least
    first = [r["pair_id"] for r in ranking.first_n(tied, n).collect()]
    assert sorted(first, key=lambda k: (k is None, k)) == ([i // 5 for i in range(30)] + [None] * 10)[:n]
    parts = [r["split"] for r in ranking.split_80_10_10(tied, n).collect()]
    a = round(0.8 * least)
    b = round(0.5 * (least - a))
    assert [parts.count(s) for s in ("train", "validation", "test")] == [a, b, least - a - b]
    assert ranking.split_80_10_10(tied, n).drop("split").distinct().count() == least


def test_identical_rows_count_each(spark):
    same = spark.createDataFrame([(1, "a")] * 9 + [(2, "b")], "pair_id long, source string")
    assert ranking.sample_n(same, 4).count() == 4
    assert ranking.first_n(same, 4).count() == 4


def test_fractions_and_ranks_with_tied_and_null_keys(tied):
    assert ranking.sample_fraction(tied, 0.3).count() == 12
    ranks = [r["rank"] for r in ranking.with_shuffle_rank(tied).collect()]
    assert sorted(ranks) == list(range(1, 41))
    batches = ranking.shuffle_batches(tied, 16).collect()
    assert sorted((r["batch_id"], r["pos"]) for r in batches) == [(i // 16, i % 16) for i in range(40)]


def test_a_key_said_to_be_unique_is_checked_at_the_cut(tied):
    assert ranking.sample_n(tied.dropDuplicates(["pair_id"]), 3, unique=True).count() == 3
    cut = next(n for n in range(1, 6) if n % 5)
    with pytest.raises(Exception, match="not unique"):
        ranking.sample_n(tied.filter("pair_id is not null"), cut, unique=True).collect()
