import random
import re

from pyspark.sql import functions as F

from pairforge.functions import tokens

# The same alternatives in the terms of Python's re.
WORD = re.compile(
    r"""(?:[^\W\d_]\.)+|\d+(?:[.,]\d+)*(?:[.,]\d+)|\w+(?:\.(?!\.|$))?|\d+(?:[-\\/]\d+)*|\$|-+|\S""",
    re.MULTILINE | re.UNICODE,
)
ALPHABET = "abZé19²_.,;-/\\$ \n\t\x1c\x85　!?()😀"


def random_texts(n, longest, alphabet=ALPHABET, seed=11):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(longest))) for _ in range(n)]


def test_word_tokens_equal_the_model(column_of):
    texts = random_texts(4000, 20)
    assert column_of(texts, tokens.word_tokens) == [WORD.findall(t) for t in texts]


def test_word_tokens_on_table_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for row in docs.select("text", tokens.word_tokens(F.col("text")).alias("t")).collect():
        assert row["t"] == WORD.findall(row["text"])


def test_word_token_examples(column_of):
    given = ["B.C.D. venceu", "R$ 1.234,50", "31/08/1999", "sim... não.", "fim.\noutro fim", "às 07h45."]
    wanted = [
        ["B.C.D.", "venceu"],
        ["R", "$", "1.234,50"],
        ["31", "/", "08", "/", "1999"],
        ["sim", ".", ".", ".", "não", "."],
        ["fim", ".", "outro", "fim"],
        ["às", "07h45", "."],
    ]
    assert column_of(given, tokens.word_tokens) == wanted


def test_word_count_of_nothing(column_of):
    assert column_of(["", "  ", None], tokens.word_count) == [0, 0, None]


def model_13a(s):
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = s.replace(old, new)
    s = f" {s} "
    s = re.sub(r"([{-~\[-` -&(-+:-@/])", r" \1 ", s)
    s = re.sub(r"([^0-9])([.,])", r"\1 \2 ", s)
    s = re.sub(r"([.,])([^0-9])", r" \1 \2", s)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", s).split()


def test_bleu_tokens_equal_the_model(column_of):
    texts = random_texts(3000, 30, "ab1 9.,-\n'\"&;()é<>/　")
    texts += ["a &quot;b&quot; &amp;lt; &lt;skipped&gt;", "<skipped>x", "1,234.5 3-4 x-y", "end-\nline"]
    assert column_of(texts, tokens.bleu_tokens) == [model_13a(t) for t in texts]


def test_ngrams(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    out = rows.select(*[tokens.ngrams("t", n).alias(f"g{n}") for n in (1, 2, 3, 4)]).collect()
    assert [list(r) for r in out] == [
        [["a", "b", "c"], ["a b", "b c"], ["a b c"], []],
        [["a"], [], [], []],
        [[], [], [], []],
    ]


def test_tokenizer_can_be_replaced(spark):
    df = spark.createDataFrame([("a,b c", "d")], "source string, target string")
    assert tokens.with_word_counts(df, tokens.whitespace_tokens).first()["src_len"] == 2
    assert tokens.with_word_counts(df).first()["src_len"] == 4
