"""Entailment labels and similarity attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ENTAILMENT = {"none": 0, "entailment": 1, "paraphrase": 2}
WRONG_LABEL = 3
MAX_SIMILARITY = 5.0


def entailment_code(label: Column, force: bool = False) -> Column:
    """Label text to code. Unknown text gives 3; a missing or empty one gives null, or 3 when forced."""
    text = F.lower(label)
    known = F.coalesce(
        *[F.when(text == name, F.lit(code)) for name, code in ENTAILMENT.items()],
        F.lit(WRONG_LABEL),
    )
    absent = F.lit(WRONG_LABEL if force else None).cast("int")
    return F.when(label.isNull() | (label == ""), absent).otherwise(known)


def entailment_label(code: Column) -> Column:
    """Code to label text; a code without a name gives null."""
    return F.coalesce(*[F.when(code == c, F.lit(name)) for name, c in ENTAILMENT.items()])


def parse_similarity(value: Column, force: bool = False) -> Column:
    """Attribute text to double. Text that is no number fails the job."""
    absent = F.lit(0.0 if force else None).cast("double")
    return F.when(value.isNull() | (value == ""), absent).otherwise(value.cast("double"))


def unit_similarity(similarity: Column) -> Column:
    """A 0..5 similarity on a 0..1 scale."""
    return similarity / F.lit(MAX_SIMILARITY)
