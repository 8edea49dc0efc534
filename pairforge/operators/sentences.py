"""Sentences by a model that is learned from the texts themselves, and words counted in them.

A period ends a sentence or belongs to an abbreviation. Which words are abbreviations is told
by counts alone, after Kiss and Strunk (2006): a log-likelihood ratio asks whether a word
stands with a period almost always, and is weighed by the word's length, the periods
inside it and its appearances without one. Words that begin sentences much oftener than
chance, by a second ratio, tell where a sentence ends in an abbreviation. Neighbours are counted
in one pass over the texts; what is learned is two lists of words, tables where they are long.

Words inside a sentence are counted by rules of the Penn Treebank's tokenizer: marks are words
of their own, a period only at the end of its sentence, and English contractions are
cut. Null and empty texts have no sentences and no words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.compute import compute_once
from pairforge.functions.tokens import Tokenizer
from pairforge.runtime import durable, ship

ABBREVIATION = 0.3  # least score of an abbreviation
STARTER = 30.0  # least log-likelihood ratio of a word that begins sentences
MOST_WORDS = 50_000  # of a list that goes into a plan; more are joined
MOST_COUNTED = 500_000  # pieces and pairs that a task counts at once
MOST_PIECES = 1 << 30  # more than an array can hold

SPACE = r"[ \t\n\x0B\f\r]+"
# Quotes and brackets around a word.
OPENING, CLOSING = "\"'([{«“‘", "\"')]}»”’"
ASCII_MARKS = b"\"'()[]{}"
# Bytes that a word which may end a sentence ends with.
LAST_BYTES = frozenset(".?!".encode()) | {c.encode()[-1] for c in CLOSING}
MARKED = r"[.?!][\"')\]}»”’]*\z"
UPPER = r"^\p{Lu}"
LETTER = r"^\p{L}\z"
# What the Treebank's rules put spaces around, in order.
MARKS = (
    (r"\.\.\.", " ... "),
    (r"([:,])([^0-9])", r" $1 $2"),
    (r"([:,])\z", r" $1 "),
    (r"([;@#$%&?!\[\](){}<>«»“”\"])", r" $1 "),
    (r"--", " -- "),
    (r"([^.])(\.)([ '’]*)\z", r"$1 $2 $3"),
    (r"('[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T)( |\z)", r" $1 "),
)


def _share(hits: Column, of: Column, p: Column) -> Column:
    """Log-likelihood of ``hits`` in ``of`` trials at chance ``p``; nothing is sure."""
    sure = F.lit(1e-12)
    q = F.least(F.greatest(p, sure), 1 - sure)
    return hits * F.log(q) + (of - hits) * F.log(1 - q)


def _pieces(text: Column) -> Column:
    """What stands between white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _core(piece: Column) -> Column:
    """A piece without the quotes and brackets around it."""
    return F.rtrim(F.ltrim(piece, F.lit(OPENING)), F.lit(CLOSING))


def _word(core: Column) -> Column:
    return F.lower(F.regexp_replace(core, r"\.\z", ""))


def _dot(core: Column) -> Column:
    return F.endswith(core, F.lit(".")) & ~F.endswith(core, F.lit(".."))


def _stop(core: Column) -> Column:
    return F.endswith(core, F.lit("?")) | F.endswith(core, F.lit("!")) | F.endswith(core, F.lit(".."))


def neighbours(df: DataFrame, column: str) -> DataFrame:
    """(a, b, n): how often piece ``b`` stands in the texts, all that is learned from.

    ``a`` is null for all places of ``b``, empty for those where a text begins, and the piece before it
    for those after a piece that ends with a mark. Tasks count before anything is moved, and the
    table is written, so the texts are read once.
    """

    def run(batches):
        seen: Counter = Counter()

        def rows():
            keys = [k if isinstance(k, tuple) else (None, k) for k in seen]
            columns = [[k[0] for k in keys], [k[1] for k in keys]]
            arrays = [*(pa.array(c, pa.binary()) for c in columns), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["a", "b", "n"])

        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                words = (value.as_py() or b"").split()  # at the characters of SPACE
                if words:
                    seen.update(words)
                    seen[b"", words[0]] += 1
                    seen.update([(a, b) for a, b in zip(words, words[1:], strict=False) if a[-1] in LAST_BYTES])
                if len(seen) > MOST_COUNTED:
                    yield rows()
                    seen.clear()
        yield rows()

    ship(df.sparkSession)
    texts = df.select(F.col(column).cast("string").alias("text"))
    counted = texts.mapInArrow(run, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return durable(counted.select(F.col("a").cast("string"), F.col("b").cast("string"), "n"), "neighbours")


def word_counts(counted: DataFrame) -> DataFrame:
    """(word, with_dot, without_dot) of all words that hold a letter, from ``neighbours``."""
    words = counted.filter("a IS NULL").select(_core(F.col("b")).alias("core"), "n").select(
        _word(F.col("core")).alias("word"), _dot(F.col("core")).alias("dot"), "n"
    )
    counts = words.filter(F.col("word").rlike(r"\p{L}")).groupBy("word").agg(
        F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("with_dot"),
        F.sum(F.when(F.col("dot"), 0).otherwise(F.col("n"))).alias("without_dot"),
    )
    return durable(counts, "words")


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``score`` of every word that ever stands with a period."""
    total, dots = counts.agg(F.sum(F.col("with_dot") + F.col("without_dot")), F.sum("with_dot")).first()
    with_dot, without = F.col("with_dot"), F.col("without_dot")
    chance = F.lit(float(dots or 0) / float(total or 1))
    n = with_dot + without
    ratio = -2 * (_share(with_dot, n, chance) - _share(with_dot, n, F.lit(0.99)))
    inside = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    length = F.length("word") - inside
    weighed = ratio * F.exp(-length) * (inside + 1) * F.pow(F.greatest(length, F.lit(1)).cast("double"), -without)
    return counts.filter("with_dot > 0").select("word", weighed.alias("score"))


def starter_scores(counted: DataFrame, abbreviations: DataFrame | Iterable[str]) -> DataFrame:
    """``score`` of every word that stands after the end of a sentence oftener than elsewhere.

    From ``neighbours`` and the abbreviations, a list or a table with a column ``word`` of them, each once.
    """
    short = _table(counted.sparkSession, abbreviations).select(F.col("word").alias("dotted"), F.lit(True).alias("_short"))
    places = counted.select("a", _core(F.col("a")).alias("core"), _word(_core(F.col("b"))).alias("word"), "n")
    places = places.filter(F.col("word").rlike(r"\p{L}"))
    n = F.when(F.col("a").isNull(), F.col("n")).when(F.col("a") == "", -F.col("n")).otherwise(0)
    told = (
        places.select(
            "word",
            n.alias("all"),
            F.when(F.col("a") != "", F.col("n")).otherwise(0).alias("n"),
            F.coalesce(_stop(F.col("core")), F.lit(False)).alias("stop"),
            F.when(_dot(F.col("core")), _word(F.col("core"))).alias("dotted"),  # null where no period tells
        )
        .groupBy("word", "stop", "dotted")
        .agg(F.sum("all").alias("all"), F.sum("n").alias("n"))
        .join(short, "dotted", "left")
    )
    ends = F.col("stop") | (F.col("dotted").isNotNull() & F.col("_short").isNull())
    counts = told.groupBy("word").agg(F.sum(F.when(ends, F.col("n")).otherwise(0)).alias("after"), F.sum("all").alias("n"))
    counts = durable(counts, "starters")
    total, breaks = counts.agg(F.sum("n"), F.sum("after")).first()
    all_, ended = F.lit(float(total or 0)), F.lit(float(breaks or 0))
    after, n = F.col("after"), F.col("n")
    here, there = F.try_divide(after, ended), F.try_divide(n - after, all_ - ended)
    ratio = -2 * (
        _share(after, ended, n / all_) + _share(n - after, all_ - ended, n / all_)
        - _share(after, ended, here) - _share(n - after, all_ - ended, there)
    )
    return counts.filter((after > 0) & (here > there)).select("word", ratio.alias("score"))


@dataclass(frozen=True)
class SentenceModel:
    """What is learned: two lists of lower-case words, in order.

    A list of more than ``MOST_WORDS`` stays a table with a column ``word``.
    """

    abbreviations: tuple[str, ...] | DataFrame
    starters: tuple[str, ...] | DataFrame

    @classmethod
    def learn(cls, df: DataFrame, column: str) -> SentenceModel:
        """From all texts of a column. The same texts give the same model."""
        counted = neighbours(df, column)
        abbreviations = _listed(abbreviation_scores(word_counts(counted)), ABBREVIATION)
        return cls(abbreviations, _listed(starter_scores(counted, abbreviations), STARTER))

    @property
    def in_plan(self) -> bool:
        return isinstance(self.abbreviations, tuple) and isinstance(self.starters, tuple)


def _listed(scores: DataFrame, least: float) -> tuple[str, ...] | DataFrame:
    found = scores.filter(F.col("score") >= least).select("word")
    rows = found.limit(MOST_WORDS + 1).collect()
    return found if len(rows) > MOST_WORDS else tuple(sorted(r["word"] for r in rows))


def _table(spark: SparkSession, words: DataFrame | Iterable[str]) -> DataFrame:
    return words if isinstance(words, DataFrame) else spark.createDataFrame([(w,) for w in words], "word string")


def _among(word: Column, words: Column | Iterable[str]) -> Column:
    return F.array_contains(words, word) if isinstance(words, Column) else word.isin(list(words))


def with_sentences(df: DataFrame, column: str, model: SentenceModel, name: str = "sentences") -> DataFrame:
    """``df`` with the sentences of a text column, by a model of any size.

    Lists that are too long for a plan are joined: to each text go the learned words that it asks for, those
    that stand with a period and those in capitals after them.
    """
    if model.in_plan:
        return compute_once(df, {name: sentences(F.col(column), model)})
    spark, text = df.sparkSession, F.col(column).cast("string")
    few = frozenset(w.encode() for w in model.abbreviations) if isinstance(model.abbreviations, tuple) else None

    def run(batches):
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                words = (value.as_py() or b"").split()
                pairs = {(a, b) for a, b in zip(words, words[1:], strict=False) if a[-1] in LAST_BYTES and b"." in a}
                if few is not None:  # as much as can be told here; the rest goes by the exact rules below
                    pairs = {(a, b) for a, b in pairs if not a.isascii() or len(w := a.strip(ASCII_MARKS).lower()) <= 2 or w.removesuffix(b".") in few}
                if pairs:
                    arrays = [pa.array([key.as_py()] * len(pairs), pa.binary()), *(pa.array(c, pa.binary()) for c in zip(*pairs, strict=True))]
                    yield pa.RecordBatch.from_arrays(arrays, ["_key", "a", "b"])

    ship(spark)
    key = F.unhex(F.md5(text.cast("binary")))
    asked = df.select(key.alias("_key"), text.alias("text")).mapInArrow(run, "_key binary, a binary, b binary")
    core, after = _core(F.col("a").cast("string")), _core(F.col("b").cast("string"))
    asked = asked.filter(_dot(core)).select(
        "_key", _word(core).alias("short"), F.when(after.rlike(UPPER), _word(after)).alias("known")
    )
    listed = _table(spark, model.abbreviations).select(F.col("word").alias("short"), F.lit(True).alias("_listed"))
    starting = _table(spark, model.starters).select(F.col("word").alias("known"), F.lit(True).alias("_starts"))
    found = (
        asked.distinct()
        .join(listed, "short", "left")
        .filter(F.col("_listed") | F.col("short").rlike(LETTER))
        .join(starting, "known", "left")
        .groupBy("_key")
        .agg(
            F.collect_set(F.when(F.col("_listed"), F.col("short"))).alias("_short"),
            F.collect_set(F.when(F.col("_starts"), F.col("known"))).alias("_known"),
        )
    )
    # Texts without such words go past the join.
    here = df.withColumn("_key", key).join(found, "_key", "left")
    none = F.array().cast("array<string>")
    lists = SentenceModel(F.coalesce("_short", none), F.coalesce("_known", none))
    return compute_once(here, {name: sentences(F.col(column), lists)}).select(*df.columns, name)


def sentences(text: Column, model: SentenceModel) -> Column:
    """The sentences of a text, their words joined by one space.

    A sentence ends after ? and !, after an ellipsis before a capital, and after a period
    unless a small letter follows. After an abbreviation or a single letter it ends only
    before a word, in capitals, that is known to begin sentences.
    """
    words = _pieces(text)

    def ends(piece: Column, following: Column) -> Column:
        core, after = _core(piece), _core(following)
        short = _among(_word(core), model.abbreviations) | _word(core).rlike(LETTER)
        known = after.rlike(UPPER) & _among(_word(after), model.starters)
        return (
            F.when(piece.rlike(r"\.\.[\"')\]}»”’]*\z"), after.rlike(UPPER))
            .when(_stop(core), F.lit(True))
            .when(_dot(core), F.when(short, known).otherwise(~after.rlike(r"^\p{Ll}")))
            .otherwise(F.lit(False))
        )

    # A mark that no text holds stands at the ends until the words are joined. Few words end
    # with a mark of their own, and only those are looked at.
    following = F.slice(words, 2, MOST_PIECES)  # one shorter: null follows the last word
    marked = F.zip_with(
        words,
        following,
        lambda w, f: F.when(
            w.rlike(MARKED) & F.coalesce(ends(w, f), F.lit(False)),
            F.concat(w, F.lit("\n")),
        ).otherwise(w),
    )
    joined = F.array_join(marked, " ")
    return F.filter(F.split(joined, "\n ?"), lambda s: s != "")


def treebank_words(sentence: Column) -> Column:
    """The words of one sentence."""
    for pattern, new in MARKS:
        sentence = F.regexp_replace(sentence, pattern, new)
    return F.filter(F.split(sentence, " +"), lambda w: w != "")


def words_of_sentences(sentences: Column) -> Column:
    """Words of all sentences of an array."""
    each = F.transform(sentences, lambda s: F.size(treebank_words(s)))
    return F.aggregate(each, F.lit(0), lambda total, n: total + n)


def sentence_tokenizer(model: SentenceModel) -> Tokenizer:
    """Words by sentences, for every function that takes a tokenizer."""
    return lambda text: F.flatten(F.transform(sentences(text, model), treebank_words))
