"""Explicit schemas of every table the package reads or writes.

Nothing is inferred: inference would turn an all-digits text column numeric
and costs an extra pass over the input.
"""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


STRINGS = T.ArrayType(T.StringType())

PAIRS = _struct(("source", T.StringType()), ("target", T.StringType()))
KEYED_PAIRS = _struct(
    ("pair_id", T.LongType()), ("source", T.StringType()), ("target", T.StringType())
)
SCORED_PAIRS = _struct(
    ("source", T.StringType()),
    ("target", T.StringType()),
    ("src_len", T.IntegerType()),
    ("tgt_len", T.IntegerType()),
    ("sem_sim", T.DoubleType()),
)
CLUSTERS = _struct(
    ("paraphrase_set_id", T.StringType()),
    ("sentence_id", T.StringType()),
    ("paraphrase", T.StringType()),
    ("lists", STRINGS),
    ("tags", STRINGS),
    ("language", T.StringType()),
)
PREDICTIONS = _struct(
    ("source", T.StringType()),
    ("target", T.StringType()),
    ("prediction", T.StringType()),
)
# XML attributes carry an underscore prefix, as Spark's XML source names them.
XML_PAIRS = _struct(
    ("_id", T.StringType()),
    ("_entailment", T.StringType()),
    ("_similarity", T.StringType()),
    ("t", T.StringType()),
    ("h", T.StringType()),
)
