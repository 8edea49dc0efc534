"""Tokenisers and n-grams over arrays, as native Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.compute import compute_once

Tokenizer = Callable[[Column], Column]

# Character classes spelled out: Java's (?U)\w also takes combining accents and
# leaves out superscript digits, Python's does neither.
_WORD = r"[\p{L}\p{N}_]"
_DIGIT = r"\p{Nd}"
_LETTER = r"[\p{L}\p{Nl}\p{No}]"

# The alternatives, tried in this order.
WORD_PATTERN = "(?d)" + "|".join(
    (
        rf"(?:{_LETTER}\.)+",  # one-letter abbreviations
        rf"{_DIGIT}+(?:[.,]{_DIGIT}+)*(?:[.,]{_DIGIT}+)",  # grouped numbers
        rf"{_WORD}+(?:\.(?!\.|(?m:$)))?",  # words, with a dot unless it ends the line
        rf"{_DIGIT}+(?:[-\\/]{_DIGIT}+)*",  # dates
        r"\$",
        r"-+",
        r"(?U:[^\s\x1c-\x1f])",
    )
)

# The public 13a rules, as (pattern, replacement) in order. The class
# of the first rule is published with the space in it, which only adds more spaces.
_BLEU_LITERALS = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)
_BLEU_RULES = (
    (r"([\{-\~\[-\`\!-\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def word_tokens(text: Column) -> Column:
    """Portuguese word tokens."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


# White space as Python's str.split sees it.
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32)


def whitespace_tokens(text: Column) -> Column:
    """Every kind of white space becomes a plain space first, which splits without a pattern."""
    plain = F.translate(text, _SPACES, " " * len(_SPACES))
    return F.array_remove(F.split(plain, " "), "")


def bleu_tokens(text: Column) -> Column:
    """mteval-13a tokens."""
    for old, new in _BLEU_LITERALS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, replacement in _BLEU_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return whitespace_tokens(text)


_BLEU_PATTERNS = [(re.compile(p), r.replace("$", "\\")) for p, r in _BLEU_RULES]


def bleu_words(text: str) -> list[str]:
    """mteval-13a tokens of one text, by the same rules, for counting inside a task."""
    for old, new in _BLEU_LITERALS:
        text = text.replace(old, new)
    text = f" {text} "
    for pattern, replacement in _BLEU_PATTERNS:
        text = pattern.sub(replacement, text)
    return text.split()


def word_count(text: Column, tokenizer: Tokenizer = word_tokens) -> Column:
    """Number of tokens; null for a null text."""
    return F.array_size(tokenizer(text))


def with_word_counts(
    df: DataFrame,
    tokenizer: Tokenizer = word_tokens,
    source: str = "source",
    target: str = "target",
) -> DataFrame:
    return compute_once(
        df,
        {
            "src_len": word_count(F.col(source), tokenizer),
            "tgt_len": word_count(F.col(target), tokenizer),
        },
    )


def ngrams(tokens: str, n: int) -> Column:
    """All n-grams of an array column in order, tokens joined by one space; empty when too short.

    Tokens never contain a space, so the joined form is unambiguous. Takes a
    column name: the tokens are looked up once per n-gram and must be stored.
    """
    if n == 1:
        return F.col(tokens)
    t = f"`{tokens}`"
    rest = "".join(f" || ' ' || {t}[i + {k}]" for k in range(1, n))
    return F.expr(
        f"transform(slice({t}, 1, greatest(size({t}) - {n - 1}, 0)), (head, i) -> head{rest})"
    )
