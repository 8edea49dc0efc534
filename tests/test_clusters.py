import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairforge.operators import clusters
from pairforge.plans.cluster_pairs import cluster_pairs
from pairforge.schema import CLUSTERS
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def skewed(spark):
    """One cluster holds more than a third of the rows; others have 1 to 4 members."""
    r = random.Random(3)
    sizes = {"hot": 701, **{f"c{i}": 1 + i % 4 for i in range(300)}, "warm": 120}
    rows = [(name, f"{name} {r.randrange(5)}") for name, n in sizes.items() for _ in range(n)]
    r.shuffle(rows)
    data = [(s, i, t) for i, (s, t) in enumerate(rows)]
    return spark.createDataFrame(data, "paraphrase_set_id string, sentence_id long, paraphrase string")


def check_pairs(pairs, table):
    members, texts = {}, {}
    for row in table.collect():
        members[row["sentence_id"]] = row["paraphrase_set_id"]
        texts[row["sentence_id"]] = row["paraphrase"]
    used, per_cluster = Counter(), Counter()
    for p in pairs.collect():
        used.update([p["source_id"], p["target_id"]])
        per_cluster[p["paraphrase_set_id"]] += 1
        assert members[p["source_id"]] == members[p["target_id"]] == p["paraphrase_set_id"]
        assert texts[p["source_id"]] == p["source"] and texts[p["target_id"]] == p["target"]
    assert max(used.values()) == 1
    sizes = Counter(members.values())
    assert per_cluster == Counter({c: n // 2 for c, n in sizes.items() if n > 1})


@pytest.mark.parametrize("hot_rows", [10, 50, 10**6])
def test_every_cluster_gives_half_its_members(skewed, hot_rows):
    check_pairs(clusters.pair_neighbours(skewed, hot_rows=hot_rows), skewed)


def test_seed_changes_the_pairs_not_their_number(skewed):
    def some(seed):
        return {(r["source_id"], r["target_id"]) for r in clusters.pair_neighbours(skewed, seed=seed).collect()}

    assert some(1) == some(1)
    assert some(1) != some(2) and len(some(1)) == len(some(2))


def test_hot_keys_are_few_by_construction(skewed):
    assert [r[0] for r in clusters.hot_keys(skewed, "paraphrase_set_id", 50, 5).collect()] == ["hot"]
    both = clusters.hot_keys(skewed, "paraphrase_set_id", 50).collect()
    assert {r[0]: r[1] for r in both} == {"hot": 15, "warm": 3}


def test_pairs_do_not_depend_on_how_clusters_are_cut(skewed):
    def some(df, hot_rows):
        return {(r["source_id"], r["target_id"]) for r in clusters.pair_neighbours(df, hot_rows=hot_rows).collect()}

    whole = some(skewed, 10**6)
    assert some(skewed, 10) == some(skewed, 50) == whole
    # Nor on other rows of the table.
    hot = some(skewed.filter("paraphrase_set_id = 'hot'"), 50)
    assert hot < whole and len(hot) == 350


@pytest.mark.parametrize("hot_rows", [10, 50, 10**6])
def test_arrays_run_in_key_order_at_any_cut(skewed, hot_rows):
    held = clusters.collect_clusters(skewed, hot_rows=hot_rows, part_rows=3).collect()
    want = defaultdict(list)
    for row in skewed.orderBy("sentence_id").collect():
        want[row["paraphrase_set_id"]].append((row["sentence_id"], row["paraphrase"]))
    got = {(r["paraphrase_set_id"], r["part"]): [(m["key"], m["text"]) for m in r["members"]] for r in held}
    assert len(got) == len(held) and all(r["n"] == len(r["members"]) for r in held)
    assert got == {
        (name, p // 3): rows[p : p + 3] for name, rows in want.items() for p in range(0, len(rows), 3)
    }


def test_small_clusters_stay_whole(skewed):
    held = clusters.collect_clusters(skewed)
    assert held.count() == 302
    assert held.filter("part <> 0").count() == 0


def test_wide_rows_are_shuffled_by_cluster_and_bucket(skewed):
    plan = plan_of(clusters.pair_neighbours(skewed, hot_rows=50))
    wide = [l for l in plan.splitlines() if "Exchange hashpartitioning(paraphrase_set_id" in l]
    assert any("_bucket" in l for l in wide)
    assert plan.count("_row") and "CartesianProduct" not in plan


def test_language_filter_and_pruning(spark, tmp_path):
    rows = [
        ("1", "a", "um", [], [], "pt"),
        ("1", "b", "dois", [], [], "pt"),
        ("1", "c", "three", [], [], "en"),
        ("2", "d", "só", [], [], "pt"),
    ]
    path = str(tmp_path / "clusters")
    spark.createDataFrame(rows, CLUSTERS).write.parquet(path)
    pairs = cluster_pairs(spark.read.parquet(path))
    assert {frozenset((p["source"], p["target"])) for p in pairs.collect()} == {frozenset(("um", "dois"))}
    assert "lists" not in plan_of(pairs) and "EqualTo(language,pt)" in plan_of(pairs)


def test_null_cluster_is_a_cluster(spark):
    df = spark.createDataFrame(
        [(None, i, str(i)) for i in range(9)], "paraphrase_set_id string, sentence_id long, paraphrase string"
    )
    for hot in (2, 100):
        assert clusters.pair_neighbours(df, hot_rows=hot).count() == 4
    assert clusters.collect_clusters(df).select(F.sum("n")).first()[0] == 9
