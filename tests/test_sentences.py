"""Sentences by a learned model."""

import pytest
from pyspark.sql import functions as F

from pairforge.functions.tokens import with_word_counts
from pairforge.operators import sentences as module
from pairforge.operators.sentences import (
    SentenceModel,
    neighbours,
    sentence_tokenizer,
    sentences,
    starter_scores,
    treebank_words,
    with_sentences,
    words_of_sentences,
)

MODEL = SentenceModel(("dr", "sr", "e.u.a", "pág"), ("ele", "a", "mas"))
CASES = [
    ("O Dr. Silva chegou. Ele saiu.", ["O Dr. Silva chegou.", "Ele saiu."]),
    ("Vive nos E.U.A. Ele gosta.", ["Vive nos E.U.A.", "Ele gosta."]),
    ("Ver pág. 12. Fim", ["Ver pág. 12.", "Fim"]),
    ('Sim! "Não?" disse. fim.', ["Sim!", '"Não?"', "disse. fim."]),
    ("Bem... talvez. Bem... Talvez", ["Bem... talvez.", "Bem...", "Talvez"]),
    ("J. Silva e (o sr.) B. Ele", ["J. Silva e (o sr.) B.", "Ele"]),
    ("  um  \n dois ", ["um dois"]),
    ("", []),
    (None, []),
    (" \t\n", []),
]


def test_sentences(column_of):
    texts, want = zip(*CASES, strict=True)
    assert column_of(list(texts), lambda c: sentences(c, MODEL)) == list(want)


def test_treebank_words(column_of):
    given = ["Olá, mundo.", "3,5 e 1:2, sim: não", 'Ele disse "sim..." (hoje).', "don't I'm we'll", "a--b; R$ 5 50%", "E.U.A. vs. o sr.", "'tis '"]
    want = [
        ["Olá", ",", "mundo", "."],
        ["3,5", "e", "1:2", ",", "sim", ":", "não"],
        ["Ele", "disse", '"', "sim", "...", '"', "(", "hoje", ")", "."],
        ["do", "n't", "I", "'m", "we", "'ll"],
        ["a", "--", "b", ";", "R", "$", "5", "50", "%"],
        ["E.U.A.", "vs.", "o", "sr", "."],
        ["'tis", "'"],
    ]
    assert column_of(given, treebank_words) == want


@pytest.fixture
def corpus(spark):
    """Abbreviations are always followed by a period; other words end sentences now and then."""
    words = "casa rua homem mulher tempo livro escola cidade".split()
    texts = []
    for i in range(400):
        a, b, c = words[i % 8], words[(i * 3 + 1) % 8], words[(i * 5 + 2) % 8]
        texts.append(f"O dr. {a.title()} viu a {b}. Ontem o {c} foi av. {a.title()} {i}. Ontem {b} e {c}! Quem viu {a} viu {c}.")
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(7)


def test_the_model_is_learned_from_counts(corpus):
    model = SentenceModel.learn(corpus, "text")
    assert model.abbreviations == ("av", "dr") and "ontem" in model.starters and "casa" not in model.starters
    assert SentenceModel.learn(corpus.repartition(3), "text") == model
    counted = corpus.select(F.size(sentences(F.col("text"), model)).alias("n")).groupBy("n").count().collect()
    assert [(r["n"], r["count"]) for r in counted] == [(4, 400)]


def test_nothing_is_learned_from_nothing(spark):
    empty = spark.createDataFrame([(None,), ("",)], "text string")
    assert SentenceModel.learn(empty, "text") == SentenceModel((), ())
    assert SentenceModel.learn(empty.limit(0), "text") == SentenceModel((), ())


def test_word_counts_by_sentences(spark):
    df = spark.createDataFrame([("O Dr. Silva chegou. Ele saiu.", "Sim.")], "source string, target string")
    row = with_word_counts(df, sentence_tokenizer(MODEL)).first()
    assert (row["src_len"], row["tgt_len"]) == (8, 2)
    total = df.select(words_of_sentences(sentences(F.col("source"), MODEL))).first()[0]
    assert total == 8


def test_long_texts_take_time_in_proportion(spark):
    df = spark.createDataFrame([("uma casa azul. " * 40_000,)], "text string")
    assert df.select(F.size(sentences(F.col("text"), MODEL))).first()[0] in (1, 40_000)


def test_more_words_than_fit_a_plan_are_joined(spark, corpus, monkeypatch):
    extra = spark.createDataFrame(
        [(900, 'Viu o "dr." (Ontem) e o dr. Casa; ver B. Ontem'), (900, None), (901, ""), (None, "O DR. Ontem"), (902, "û. É (av.) Ontem av. ontem")],
        "i int, text string",
    )
    texts = corpus.unionByName(extra).unionByName(extra)
    model = SentenceModel.learn(texts, "text")

    def cut(model):
        return sorted(with_sentences(texts, "text", model).select("i", "text", "sentences").collect(), key=repr)

    want = cut(model)
    monkeypatch.setattr(module, "MOST_WORDS", 1)
    large = SentenceModel.learn(texts, "text")
    assert not large.in_plan and {r["word"] for r in large.starters.collect()} == set(model.starters)
    assert cut(large) == want
    assert cut(SentenceModel(model.abbreviations, large.starters)) == want
    assert any(r["sentences"] and len(r["sentences"]) > 1 for r in want)


def test_the_texts_are_read_once_for_the_model(spark, corpus):
    counted = neighbours(corpus, "text")
    rows = {(r["a"], r["b"]): r["n"] for r in counted.collect()}
    assert rows[None, "O"] == rows["", "O"] == 400 and rows["dr.", "Casa"] == 50 and (None, "dr.") in rows
    assert ("O", "dr.") not in rows
    starters = {r["word"]: r["score"] for r in starter_scores(counted, ["av", "dr"]).collect()}
    assert set(starters) >= {"ontem", "quem"} and starters["ontem"] > 30
    short = spark.createDataFrame([("av",), ("dr",)], "word string")
    assert {r["word"]: r["score"] for r in starter_scores(counted, short).collect()} == starters
