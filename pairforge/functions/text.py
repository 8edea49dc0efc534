"""Text cleaning as native Column expressions (no Python in the data path).

Two cleaners exist on purpose and are not interchangeable: cleaner A prepares a
raw corpus, cleaner B prepares rows for a model. They differ in what a single
right quote becomes and in whether tabs and newlines survive.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.compute import compute_once

# Whitespace as Python's str.strip and re's \s see it. (?U) widens Java's \s to
# Unicode; U+001C..U+001F are separators for Python only.
SPACE = r"[\s\x1c-\x1f]"

# Spellings of a quotation mark, in the order they are replaced.
QUOTES_A = ("``", "` `", "‘‘", "‘ ‘", "’’", "’ ’", "’", "“", "”", "''", "' '", '""')
QUOTES_B = (
    ("``", '"'),
    ("` `", '"'),
    ("‘‘", '"'),
    ("‘ ‘", '"'),
    ("’’", '"'),
    ("’ ’", '"'),
    ("’", "'"),
    ("“", '"'),
    ("”", '"'),
    ("''", '"'),
    ("' '", '"'),
)


def _replace_all(text: Column, rules) -> Column:
    return reduce(lambda c, rule: F.replace(c, F.lit(rule[0]), F.lit(rule[1])), rules, text)


def nbsp_to_space(text: Column) -> Column:
    """No-break space to plain space."""
    return F.replace(text, F.lit("\u00a0"), F.lit(" "))


def strip_caption(text: Column) -> Column:
    """Drop one bracketed caption at the very start; the bracket kinds need not match.

    (?d) keeps ``\\n`` as the only character that ends a caption's reach.
    """
    return F.regexp_replace(text, r"(?d)^[\(\[].*?[\)\]]", "")


def unify_quotes(text: Column) -> Column:
    """Every spelling of a quotation mark becomes ``"`` (cleaner A)."""
    return _replace_all(text, [(q, '"') for q in QUOTES_A])


def drop_stray_quote(text: Column) -> Column:
    """Delete a lone ``"``, or the two that wrap the whole text.

    One anchored pattern says both: either the text is ``"inner"`` with no quote
    inside, or it holds exactly one quote. Anything else is left alone.
    """
    return F.regexp_replace(text, r'\A(?:"([^"]*+)"\z|([^"]*+)"([^"]*+)\z)', "$1$2$3")


def collapse_whitespace(text: Column) -> Column:
    """Every run of whitespace becomes one space."""
    return F.regexp_replace(text, f"(?U){SPACE}+", " ")


def strip(text: Column) -> Column:
    """Unicode strip. The look-behind lets the right-hand pattern start only at the
    first space of a run, so a long inner run costs linear time."""
    return F.regexp_replace(
        text, rf"(?U)\A{SPACE}++|{SPACE}(?<!{SPACE}{SPACE}){SPACE}*+\z", ""
    )


def drop_leading_hyphen(text: Column) -> Column:
    return F.regexp_replace(text, r"\A-", "")


def clean_a(text: Column) -> Column:
    """Corpus cleaner. The order of the steps is the contract.

    After whitespace is collapsed U+0020 is the only whitespace left, so the two
    strips are plain ``trim``.
    """
    text = strip_caption(nbsp_to_space(text))
    text = drop_stray_quote(unify_quotes(text))
    text = F.trim(collapse_whitespace(text))
    return F.trim(drop_leading_hyphen(text))


@lru_cache(maxsize=1)
def _assigned() -> str:
    """Ranges of code points from U+0370 on that are not of category C in this Python's
    tables, as the inside of a Java character class."""
    ranges, start = [], None
    for c in range(0x370, sys.maxunicode + 2):
        known = c <= sys.maxunicode and unicodedata.category(chr(c))[0] != "C"
        if known and start is None:
            start = c
        elif not known and start is not None:
            ranges.append(rf"\x{{{start:x}}}-\x{{{c - 1:x}}}")
            start = None
    return "".join(ranges)


def drop_non_printables(text: Column) -> Column:
    """Drop control, format, private-use and unassigned characters (category C).

    The JVM's tables are older than Python's: characters it takes for unassigned stay
    if Python knows them. They are only looked up for characters of its category C.
    """
    return F.regexp_replace(text, rf"[\p{{C}}&&[^{_assigned()}]]+", "")


def collapse_spaces(text: Column) -> Column:
    """Strip, then squeeze runs of U+0020; tabs and newlines inside stay."""
    return F.regexp_replace(strip(text), " +", " ")


def ascii_quotes(text: Column) -> Column:
    """Curly and doubled quotes to ASCII ones (cleaner B): a single right quote
    becomes an apostrophe."""
    return _replace_all(text, QUOTES_B)


def clean_b(text: Column) -> Column:
    """Row cleaner used when a dataset is loaded for a model."""
    return ascii_quotes(collapse_spaces(text))


def clean_pairs_a(df: DataFrame, columns=("source", "target")) -> DataFrame:
    return compute_once(df, {name: clean_a(F.col(name)) for name in columns})


def clean_pairs_b(
    df: DataFrame, columns=("source", "target"), remove_bad_chars: bool = False
) -> DataFrame:
    """Cleaner B on the role columns, which come first in the result.

    ``remove_bad_chars`` acts on every string column, not only on the roles.
    """
    if remove_bad_chars:
        df = drop_non_printables_everywhere(df)
    rest = [name for name in df.columns if name not in columns]
    return compute_once(df, {name: clean_b(F.col(name)) for name in columns}).select(*columns, *rest)


def drop_non_printables_everywhere(df: DataFrame) -> DataFrame:
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return compute_once(df, {name: drop_non_printables(F.col(name)) for name in strings})


def lower_columns(df: DataFrame, columns=("source", "target")) -> DataFrame:
    """Lower-case sources and references; predictions are left as generated."""
    return df.withColumns({name: F.lower(name) for name in columns})
