import math
import random
from collections import Counter

import pytest

from pairforge.operators import bleu
from pairforge.operators.metrics import evaluate, metric_names, register, report
from tests.conftest import plan_of
from tests.test_tokens import model_13a


def counts(rows):
    match, possible, sys_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for pred, ref in rows:
        p, r = model_13a(pred), model_13a(ref)
        sys_len, ref_len = sys_len + len(p), ref_len + len(r)
        for n in range(4):
            a = Counter(tuple(p[i : i + n + 1]) for i in range(len(p) - n))
            b = Counter(tuple(r[i : i + n + 1]) for i in range(len(r) - n))
            match[n] += sum((a & b).values())
            possible[n] += max(len(p) - n, 0)
    return match, possible, sys_len, ref_len


def model_bleu(rows):
    match, possible, c, r = counts(rows)
    if 0 in match:
        return 0.0
    precision = math.exp(sum(math.log(m / p) for m, p in zip(match, possible)) / 4)
    return precision * (1.0 if c > r else math.exp(1 - r / c))


def model_smoothed(rows):
    match, possible, c, r = counts([(p.strip(), t.strip()) for p, t in rows])
    if not any(match) or 0 in possible:
        return 0.0
    smooth, logs = 1.0, 0.0
    for m, p in zip(match, possible):
        if m == 0:
            smooth *= 2
        logs += math.log(100 * m / p if m else 100 / (smooth * p))
    return round(math.exp(logs / 4) * (math.exp(1 - r / c) if c < r else 1.0), 4)


CORPORA = {
    "identical": [("a b c d e", "a b c d e"), ("x y z w", "x y z w")],
    "no overlap": [("a b c d", "e f g h")],
    "short": [("a b", "a b"), ("c", "c")],
    "clipping": [("the the the the the the the", "the cat is on the mat"), ("the cat the cat the cat", "the cat the cat")],
    "shorter": [("a b c d", "a b c d e f g h")],
    "longer": [("a b c d e f g h", "a b c d")],
    "empty predictions": [("", "a b c d"), ("", "e")],
    "entities": [("&quot;x&quot; 1,234.5 3-4 a", '"x" 1,234.5 3-4 b'), ("a b c d", "a b c d")],
    "one order missing": [("a b x c d y", "a b z c d w")],
}


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "prediction string, target string")


@pytest.mark.parametrize("name", CORPORA)
def test_against_counters(frame, name):
    df = frame(CORPORA[name])
    assert bleu.corpus_bleu(df).first()["bleu"] == pytest.approx(model_bleu(CORPORA[name]))
    assert bleu.smoothed_bleu(df).first()["bleu"] == pytest.approx(model_smoothed(CORPORA[name]))


def test_random_corpora(frame):
    r = random.Random(1)
    for size, vocabulary in ((40, 3), (60, 8), (30, 40)):
        def text():
            return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(r.randrange(25)))

        rows = [(text(), text()) for _ in range(size)]
        assert bleu.corpus_bleu(frame(rows)).first()["bleu"] == pytest.approx(model_bleu(rows))
        got = bleu.smoothed_bleu(frame(rows)).first()["bleu"]
        assert got == pytest.approx(model_smoothed(rows), abs=1e-4)


def test_long_repetitive_row(frame):
    rows = [("a b " * 6000, "b a " * 5000)]
    assert bleu.corpus_bleu(frame(rows)).first()["bleu"] == pytest.approx(model_bleu(rows))


def test_null_counts_as_empty_and_no_rows_give_zero(frame):
    rows = [(None, "a b c d e"), ("a b c d e", "a b c d e")]
    want = model_bleu([("", "a b c d e"), ("a b c d e", "a b c d e")])
    assert bleu.corpus_bleu(frame(rows)).first()["bleu"] == pytest.approx(want)
    assert bleu.corpus_bleu(frame([])).first()["bleu"] == 0.0


def test_generation_record(spark):
    rows = [("a b c d e", "a b c x e f", "a b c d e f"), ("q w e r t", "q w e r z", "q w e r t")]
    df = spark.createDataFrame(rows, "source string, target string, prediction string")
    got = evaluate(df, "generation", reference="target").first()
    b = model_bleu([(r[2], r[1]) for r in rows])
    s = model_bleu([(r[2], r[0]) for r in rows])
    assert got["bleu"] == pytest.approx(b) and got["self_bleu"] == pytest.approx(s)
    assert got["ibleu"] == round(0.7 * b - (1 - 0.7) * s, 3)
    assert "sbert" not in got.asDict()
    gold = evaluate(df, "generation", reference="target", prediction="source").first()
    assert gold["self_bleu"] == 1.0


def test_generation_with_vectors(spark):
    df = spark.createDataFrame(
        [("a", "b", "c", [1.0, 0.0], [1.0, 0.0]), ("a", "b", "c", [1.0, 0.0], [0.0, 1.0])],
        "source string, reference string, prediction string, prediction_vec array<float>, reference_vec array<float>",
    )
    assert evaluate(df, "generation").first()["sbert"] == pytest.approx(0.5)
    assert {r["metric"]: r["value"] for r in report(evaluate(df, "generation")).collect()} == {
        "bleu": 0.0, "self_bleu": 0.0, "ibleu": 0.0, "sbert": 50.0,
    }


def test_no_text_is_shuffled(frame):
    plan = plan_of(bleu.corpus_bleu(frame(CORPORA["short"])))
    assert plan.count("Exchange") == plan.count("Exchange SinglePartition") == 1
    assert "Python" not in plan


def test_registry(spark, frame):
    df = frame([("a", "b")])
    assert {"bleu", "generation", "similarity_scores", "smoothed_bleu", "sts"} <= set(metric_names())
    with pytest.raises(ValueError, match="unknown metric"):
        evaluate(df, "rouge")
    with pytest.raises(ValueError, match="needs column"):
        evaluate(df, "bleu")
    with pytest.raises(ValueError, match="no role"):
        evaluate(df, "bleu", reference="target", source="target")

    @register("rows", ("prediction",))
    def rows(d):
        return d.groupBy().count()

    assert evaluate(df, "rows").first()["count"] == 1


def test_ngrams_are_counted_in_batches_by_number(spark, frame, monkeypatch):
    """Long texts with repeats, more than a batch holds; no n-gram is a string of its own."""
    rng = random.Random(7)
    rows = [(" ".join(rng.choices("ab, c. d1-2", k=rng.randrange(0, 400))), " ".join(rng.choices("ab, c. d", k=300))) for _ in range(60)]
    monkeypatch.setattr(bleu, "SLICE_BYTES", 1 << 10)
    df = frame([*rows, ("", ""), ("a\u00a0b\u3000c", "a b\x1cc")])
    assert "transform" not in plan_of(bleu.corpus_bleu(df))
    got = bleu.match_counts(df, "prediction", {"ref": df["target"]}).agg(*bleu.total_counts({"ref": df["target"]})).first()
    match, possible, sys_len, ref_len = counts([*rows, ("", ""), ("a\u00a0b\u3000c", "a b\x1cc")])
    assert list(got) == [*possible, sys_len, ref_len, *match]
