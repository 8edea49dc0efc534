"""Orders of epochs, padded batches and subword ids."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairforge.functions.arrays import truncate
from pairforge.operators.batching import padded_batches, padding_share
from pairforge.operators.epochs import Permutation, epoch_batches, epoch_places
from pairforge.operators.ranking import key_batches
from pairforge.operators.subwords import encode_texts
from tests.conftest import plan_of


def test_every_size_is_a_permutation():
    for n in range(1, 1001):
        p = Permutation.of(n, n % 7)
        x = np.arange(n)
        assert np.array_equal(np.sort(p(x)), x)
        assert p.left * p.right < n + p.left


def test_epochs_and_seeds_differ_and_look_random():
    n = 10_000
    x = np.arange(n)
    orders = [Permutation.of(n, e, s)(x) for e, s in ((0, 1), (1, 1), (0, 2))]
    for a in range(3):
        assert abs(np.corrcoef(x, orders[a])[0, 1]) < 0.05
        assert (np.diff(orders[a]) == 1).mean() < 0.01
        for b in range(a):
            assert (orders[a] == orders[b]).mean() < 0.01 and abs(np.corrcoef(orders[a], orders[b])[0, 1]) < 0.05


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 2**61), st.integers(0, 100))
def test_large_numbers_stay_in_range(n, epoch):
    p = Permutation.of(n, epoch)
    x = np.unique(np.linspace(0, n - 1, 50).astype(np.int64).clip(0, n - 1))
    y = p(x)
    assert ((0 <= y) & (y < n)).all() and len(np.unique(y)) == len(x)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_places_are_those_of_the_permutation(spark, n):
    df = epoch_places(spark.range(n).withColumnRenamed("id", "row"), n, [0, 4, 9])
    got = {(r.epoch, r.row): r.place for r in df.collect()}
    assert got == {(e, i): int(p) for e in (0, 4, 9) for i, p in enumerate(Permutation.of(n, e)(np.arange(n)))}


def test_ten_epochs_from_one_scan_without_a_shuffle(spark):
    df = epoch_batches(spark.range(5000).withColumnRenamed("id", "row"), 5000, 64, range(10))
    plan = plan_of(df)
    assert "Exchange" not in plan and "Python" not in plan and plan.count("Range (") == 1
    sizes = df.groupBy("epoch", "batch_id").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d")).collect()
    assert len(sizes) == 10 * 79 and all(r.n == r.d == (64 if r.batch_id < 78 else 8) for r in sizes)


def test_rows_out_of_range_fail(spark):
    with pytest.raises(Exception, match="not below n"):
        epoch_places(spark.range(6).withColumnRenamed("id", "row"), 5, [0]).collect()
    with pytest.raises(ValueError):
        epoch_places(spark.range(1).withColumnRenamed("id", "row"), 1, [])


@pytest.fixture
def arrays(spark):
    rng = np.random.default_rng(4)
    lengths = [*rng.integers(0, 200, 400).tolist(), *[48] * 300, 900]
    rows = [(i, list(range(1, n + 1)) if i != 5 else None, "x") for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "key long, ids array<int>, width string").repartition(5).drop("width")


def test_padded_batches_keep_to_the_budget(arrays):
    given = {r.key: r.ids or [] for r in arrays.collect()}
    rows = padded_batches(arrays, "ids", "key", budget=512, pad_id=0).collect()
    assert sorted(r.key for r in rows) == sorted(given)
    batches = {}
    for r in rows:
        own = given[r.key]
        assert r.ids == own + [0] * (r.width - len(own)) and r.attention_mask == [1] * len(own) + [0] * (r.width - len(own))
        assert r.width % 8 == 0 and r.width - len(own) < 8 or (not own and r.width == 8)
        batches.setdefault(r.batch_id, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    widths = [batches[b][0].width for b in sorted(batches)]
    assert widths == sorted(widths)
    for batch in batches.values():
        assert len({r.width for r in batch}) == 1 and sorted(r.pos for r in batch) == list(range(len(batch)))
        assert len(batch) * batch[0].width <= 512 or len(batch) == 1
    assert padded_batches(arrays.limit(0), "ids", "key", 512, 0).count() == 0


def test_padding_is_less_than_in_a_fixed_order(arrays):
    made = padding_share(padded_batches(arrays, "ids", "key", budget=4096, pad_id=0)).first()
    fixed = key_batches(arrays.withColumn("n", F.coalesce(F.size("ids"), F.lit(0))), 32, "key")
    widest = fixed.groupBy("batch_id").agg((F.max("n") * F.count("*")).alias("all"), F.sum("n").alias("own"))
    share = widest.agg(1 - F.sum("own") / F.sum("all")).first()[0]
    assert made.padding < 0.08 < 0.3 < share


def test_subword_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Olá, mundo!", "", None, "<|endoftext|> x", "a" * 5000, "um  dois\n"]
    df = spark.createDataFrame([(i, t, t and t[::-1]) for i, t in enumerate(texts)], "i int, s string, t string")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    got = encode_texts(df, {"source_ids": "s", "target_ids": "t"}, path, begin=7, end=9).orderBy("i").collect()
    for r, text in zip(got, texts, strict=True):
        for value, own in ((r.source_ids, text), (r.target_ids, text and text[::-1])):
            assert value == (None if own is None else [7, *tokenizer.encode(own, add_special_tokens=False).ids, 9])
    short = encode_texts(df, {"ids": "s"}, path).select(truncate(F.col("ids"), 3).alias("x"))
    assert all(r.x is None or len(r.x) <= 3 for r in short.collect())
