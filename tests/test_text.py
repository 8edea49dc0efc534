import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pairforge.functions import text
from tests.conftest import optimized, plan_of

CASES_A = [
    ("a b", "a b"),
    ("(riso) Olá", "Olá"),
    (" (riso) Olá", "(riso) Olá"),
    (" (riso) Olá", "(riso) Olá"),
    ("[a) b", "b"),
    ("(a) (b) c", "(b) c"),
    ("(a\rb) c", "c"),
    ("(a\nb) c", "(a b) c"),
    ("d’água", "dágua"),
    ("d’água e d’ouro", 'd"água e d"ouro'),
    ("‘só", "‘só"),
    ("“a” b", '"a" b'),
    ('"a"', "a"),
    ('"a" b "c"', '"a" b "c"'),
    ('a "', "a"),
    ('"', ""),
    ('""', ""),
    ("``a``", "a"),
    ("‘‘a’’", "a"),
    ("a\t\t\n b", "a b"),
    ("　a　　b　", "a b"),
    ("a\u001cb", "a b"),
    ("-Olá", "Olá"),
    ("- Olá", "Olá"),
    ("--Olá", "-Olá"),
    ("", ""),
    (None, None),
    ('😀"a', "😀a"),
]

CASES_B = [
    ("a\nb", "a\nb"),
    ("a\tb", "a\tb"),
    ("  a   b ", "a b"),
    ("d’água", "d'água"),
    ("''a''", '"a"'),
    ('""', '""'),
    (None, None),
]


def model_a(s):
    """The corpus cleaner said in plain Python."""
    s = re.sub(r"\A[(\[].*?[)\]]", "", s.replace("\xa0", " "))
    for quote in text.QUOTES_A:
        s = s.replace(quote, '"')
    at = [i for i, c in enumerate(s) if c == '"']
    if len(at) == 1:
        s = s.replace('"', "")
    elif at[:2] == [0, len(s) - 1]:
        s = s[1:-1]
    s = " ".join(s.split())
    return (s[1:] if s.startswith("-") else s).strip()


def model_b(s):
    s = re.sub(" +", " ", s.strip())
    for old, new in text.QUOTES_B:
        s = s.replace(old, new)
    return s


ALPHABET = "ab-()[]\"'`‘’“” \t\n\r\x0b\x1c\x1f\x85\xa0 　é😀."


@pytest.mark.parametrize("given_,wanted", CASES_A)
def test_clean_a_cases(column_of, given_, wanted):
    assert column_of([given_], text.clean_a) == [wanted]


@pytest.mark.parametrize("given_,wanted", CASES_B)
def test_clean_b_cases(column_of, given_, wanted):
    assert column_of([given_], text.clean_b) == [wanted]


def random_texts(n, longest, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(longest))) for _ in range(n)]


def test_cleaners_equal_their_models(column_of):
    texts = random_texts(4000, 14) + random_texts(500, 80)
    assert column_of(texts, text.clean_a) == [model_a(t) for t in texts]
    assert column_of(texts, text.clean_b) == [model_b(t) for t in texts]
    assert column_of(texts, text.strip) == [t.strip() for t in texts]
    assert column_of(texts, text.collapse_whitespace) == [re.sub(r"\s+", " ", t) for t in texts]


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"])), max_size=40))
def test_cleaners_take_any_text(column_of, texts):
    texts = [t for t in texts if "\x00" not in t]
    assert column_of(texts, text.clean_a) == [model_a(t) for t in texts]
    assert column_of(texts, text.clean_b) == [model_b(t) for t in texts]


def test_whitespace_class_is_pythons(column_of):
    points = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    spaces = column_of(points, lambda c: c.rlike(f"(?U){text.SPACE}"))
    assert [p for p, hit in zip(points, spaces) if hit] == [p for p in points if p.isspace()]


def test_strip_is_linear_in_inner_runs(column_of):
    long = "a" + " " * 200_000 + "b"
    assert column_of([long], text.strip) == [long]


def test_non_printables(column_of):
    given_ = ["a\nb\tc", "zero​width‍", "soft­hyphen", "plain é 😀"]
    wanted = ["abc", "zerowidth", "softhyphen", "plain é 😀"]
    assert column_of(given_, text.drop_non_printables) == wanted


def test_bad_chars_touch_every_string_column(spark):
    df = spark.createDataFrame([("x‍", "t\n", 1, "s­")], "note string, target string, n int, source string")
    out = text.clean_pairs_b(df, remove_bad_chars=True)
    assert out.columns == ["source", "target", "note", "n"]
    assert out.first() == ("s", "t", "x", 1)
    assert text.clean_pairs_b(df).first()["note"] == "x‍"


def test_cleaning_is_native_and_evaluated_once(spark):
    df = spark.createDataFrame([("a", "b")], "source string, target string")
    clean = text.clean_pairs_a(df).filter("source <> target and length(source) > 1")
    assert "Python" not in plan_of(clean)
    assert optimized(clean).count("“") == 2  # once per column


def test_lower_case_leaves_predictions(spark):
    df = spark.createDataFrame([("A", "B", "C")], "source string, target string, prediction string")
    assert text.lower_columns(df).first() == ("a", "b", "C")


def test_characters_the_jvm_does_not_know_yet_stay(column_of):
    given = ["a\U0001fae0b", "\U0001f600", "x​y͸z", "", "\U000e0001­"]
    assert column_of(given, text.drop_non_printables) == ["a\U0001fae0b", "\U0001f600", "xyz", "", ""]
