"""One query per operator over the generated tables. Keys match ``oracle.ORACLE``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.checks.inputs import (
    conversation_pairs,
    dirty_pairs,
    document_pairs,
    predicted_pairs,
    table,
    vector_pairs,
)
from pairforge.compute import compute_once
from pairforge.functions import arrays, labels, text, tokens, vectors
from pairforge.operators import (
    align,
    batching,
    bleu,
    clusters,
    columns,
    epochs,
    metrics,
    prune,
    ranking,
    sentences,
    stats,
)
from pairforge.operators.counts import Counts
from pairforge.plans import filter_pairs as filtering
from pairforge.plans import generate, parallel_text, profile_corpora
from pairforge.runtime import durable, fresh_path, write_whole
from pairforge.sources import checked, readers, splits, writers
from pairforge.streaming import pairs as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- cleaning and tokens ---------------------------------------------------------


@query
def clean_pairs_a(spark, sf_dir):
    return text.clean_pairs_a(dirty_pairs(spark, sf_dir)).select("pair_id", "source", "target")


@query
def clean_pairs_b(spark, sf_dir):
    rows = dirty_pairs(spark, sf_dir).withColumn(
        "note", F.concat(F.lit("a‍­\t"), F.col("source"), F.lit(" \n"))
    )
    return text.clean_pairs_b(rows.select("pair_id", "source", "target", "note"), remove_bad_chars=True)


@query
def clean_pairs_b_keep_controls(spark, sf_dir):
    return text.clean_pairs_b(dirty_pairs(spark, sf_dir).select("pair_id", "source", "target"))


@query
def word_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    rows = align.stack({"documents": docs, "benchmark": items})
    return rows.select("corpus", "id", tokens.word_count(F.col("text")).cast("long").alias("words"))


@query
def sentence_model(spark, sf_dir):
    """Abbreviations and words that begin sentences, with their scores."""
    docs = table(spark, sf_dir, "documents")
    counted = sentences.neighbours(docs, "text")
    scores = sentences.abbreviation_scores(sentences.word_counts(counted))
    short = scores.filter(F.col("score") >= sentences.ABBREVIATION)
    starters = sentences.starter_scores(counted, short)
    rows = {"abbreviation": short, "starter": starters.filter(F.col("score") >= sentences.STARTER)}
    return _rounded(align.stack(rows).withColumnRenamed("corpus", "kind"), "score", digits=3)


@query
def word_count_sentences(spark, sf_dir):
    """Sentences of all documents by a model learned from them, and the words in them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = sentences.SentenceModel.learn(docs, "text")
    cut = sentences.with_sentences(docs, "text", model)
    return cut.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        sentences.words_of_sentences(F.col("sentences")).cast("long").alias("words"),
    )


@query
def word_token_text(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return items.select(
        "item_id", F.array_join(tokens.word_tokens(F.col("text")), "|").alias("tokens")
    )


@query
def bleu_token_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.array_join(tokens.bleu_tokens(F.col("text")), " ").alias("tokens")
    )


@query
def token_ngrams(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(
        "item_id", tokens.bleu_tokens(F.col("text")).alias("t")
    )
    grams = F.map_from_arrays(
        F.array(*[F.lit(n).cast("long") for n in bleu.ORDERS]),
        F.array(*[tokens.ngrams("t", n) for n in bleu.ORDERS]),
    )
    per_order = items.select("item_id", F.explode(grams).alias("n", "grams"))
    return per_order.select("item_id", "n", F.explode("grams").alias("gram"))


# --- filters and projections -----------------------------------------------------


def _counted(spark, sf_dir):
    rows = text.clean_pairs_a(dirty_pairs(spark, sf_dir))
    return _longs(tokens.with_word_counts(rows), "src_len", "tgt_len").drop("conv_id", "turn")


@query
def prune_length_ratio(spark, sf_dir):
    return prune.prune_length_ratio(_counted(spark, sf_dir))


@query
def drop_identical(spark, sf_dir):
    """Every fourth target is replaced by its source, so there is something to drop."""
    rows = conversation_pairs(spark, sf_dir).withColumn(
        "target", F.when(F.col("conv_id") % 4 == 0, F.col("source")).otherwise(F.col("target"))
    )
    return prune.drop_identical(rows).select("pair_id", "source", "target")


@query
def min_words(spark, sf_dir):
    return prune.min_words(conversation_pairs(spark, sf_dir), "target", 40).select(
        "pair_id", "target"
    )


@query
def clean_and_prune(spark, sf_dir):
    rows = filtering.clean_and_prune(dirty_pairs(spark, sf_dir).drop("conv_id", "turn"))
    return _longs(rows, "src_len", "tgt_len")


@query
def filter_pairs(spark, sf_dir):
    """The whole pair filter: clean, count, prune, attach vectors, threshold."""
    stored = table(spark, sf_dir, "embeddings")
    kept = filtering.filter_pairs(
        document_pairs(spark, sf_dir),
        lambda df: filtering.score_with_vectors(df, stored),
        semantic_threshold=0.55,
    )
    return _rounded(_longs(kept, "src_len", "tgt_len"), "sem_sim")


@query
def positive_pairs(spark, sf_dir):
    marked = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    rows = profile_corpora.positive_pairs(marked, "text", "lang", "quality", 1)
    return rows.select(F.md5("source").alias("source"), "target")


@query
def expr_filter_map(spark, sf_dir):
    rows = prune.filter_rows(conversation_pairs(spark, sf_dir), "length(source) > 60 and turn < 5")
    mapped = columns.map_columns(rows, "n = length(source); twice = n * 2; mark = concat(';', twice)")
    return _longs(mapped.select("pair_id", "n", "twice", "mark"), "n", "twice")


@query
def role_columns(spark, sf_dir):
    rows = predicted_pairs(spark, sf_dir).select("source", "target", "prediction", "pair_id")
    named = columns.select_roles(rows, None, "target", "source", keep=["pair_id"])
    return columns.roles_first(named)


@query
def renamed_roles(spark, sf_dir):
    rows = conversation_pairs(spark, sf_dir).withColumnsRenamed(
        {"source": "premise", "target": "hypothesis"}
    )
    return columns.rename_roles(columns.drop_columns(rows, ["turn"]))


@query
def prefix_source(spark, sf_dir):
    rows = columns.prefix_column(conversation_pairs(spark, sf_dir), "paraphrase: ")
    return rows.select("pair_id", "source")


# --- sampling, splits, order -----------------------------------------------------


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query
def sample_n(spark, sf_dir):
    return ranking.sample_n(_documents(spark, sf_dir), 150, "doc_id", unique=True).select("doc_id", "text")


@query
def sample_fraction(spark, sf_dir):
    return ranking.sample_fraction(_documents(spark, sf_dir), 0.33, "doc_id", unique=True).select("doc_id", "lang")


@query
def split_80_10_10(spark, sf_dir):
    return ranking.split_80_10_10(_documents(spark, sf_dir), None, "doc_id", unique=True).select(
        "doc_id", "text", "split"
    )


@query
def split_sampled(spark, sf_dir):
    return ranking.split_80_10_10(_documents(spark, sf_dir), 155, "doc_id", unique=True).select("doc_id", "split")


@query
def split_remainder(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    taken = ranking.sample_fraction(docs, 0.8, "doc_id", unique=True)
    return align.remainder(docs, taken, "doc_id").select("doc_id", "text")


@query
def first_n(spark, sf_dir):
    return ranking.first_n(_documents(spark, sf_dir), 170, "doc_id", unique=True).select("doc_id", "text")


@query
def shuffle_order(spark, sf_dir):
    rows = ranking.with_shuffle_rank(_documents(spark, sf_dir), "doc_id", seed=7)
    return rows.select("doc_id", "rank")


@query
def shuffle_batches(spark, sf_dir):
    rows = ranking.shuffle_batches(_documents(spark, sf_dir), 64, "doc_id")
    return rows.select("doc_id", "batch_id", "pos")


@query
def key_batches(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 2**32 + F.col("turn")).alias("pair_id")
    )
    return ranking.key_batches(turns, 32)


@query
def sts_batches(spark, sf_dir):
    rows = conversation_pairs(spark, sf_dir).selectExpr(
        "pair_id", "source AS premise", "target AS hypothesis", "turn"
    )
    return generate.sts_batches(rows)


@query
def used_samples(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return align.stack(
        {"capped": align.used_samples(docs, 100), "all": align.used_samples(docs, 10**12)}
    )


def _turns_with_gaps(spark, sf_dir):
    """Conversation turns, whose key has ties, with every seventh key missing."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.when(F.col("conv_id") % 7 > 0, F.col("conv_id")).alias("conv_id"), "turn", "text")


@query
def split_with_ties(spark, sf_dir):
    """Exact sizes on a key with ties and nulls: rows of each key in each split."""
    rows = ranking.split_80_10_10(_turns_with_gaps(spark, sf_dir), 77, "conv_id")
    return rows.groupBy("split", "conv_id").agg(F.count(F.lit(1)).alias("n"))


@query
def first_n_with_ties(spark, sf_dir):
    rows = ranking.first_n(_turns_with_gaps(spark, sf_dir), 45, "conv_id")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query
def shuffle_order_with_ties(spark, sf_dir):
    """Ranks of all rows in random order; rows of one key are next to each other."""
    rows = ranking.with_shuffle_rank(_turns_with_gaps(spark, sf_dir), "conv_id")
    return rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("rank").cast("long").alias("first"),
        F.max("rank").cast("long").alias("last"),
    )


@query
def shuffled_rows(spark, sf_dir):
    """All rows in seeded random order, with their places numbered as they come."""
    shuffled = ranking.shuffle_rows(_documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    at = shuffled.select(
        "doc_id",
        F.md5("text").alias("text_md5"),
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    numbered = ranking.number_rows(durable(at, "shuffled"), ["_part"], "_seq", "place")
    return numbered.select("doc_id", "text_md5", (F.col("place") + 1).alias("place"))


@query
def epoch_batches(spark, sf_dir):
    """Batches of all documents in ten epochs, each in an order of its own, from one scan."""
    numbered = durable(ranking.with_key_rank(_documents(spark, sf_dir).select("doc_id"), "doc_id", "row"), "numbered")
    return epochs.epoch_batches(numbered, numbered.count(), 64, range(10)).select("doc_id", "epoch", "batch_id", "pos")


@query
def padded_batches(spark, sf_dir):
    """Ids of all documents in batches of one padded width within a budget of ids."""
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w))
    rows = _documents(spark, sf_dir).select("doc_id", arrays.truncate(lengths, 512).alias("ids"))
    made = batching.padded_batches(rows, "ids", "doc_id", budget=4096, pad_id=0)
    return made.select(
        "doc_id",
        "batch_id",
        "pos",
        "width",
        F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda n, m: n + m).alias("n_ids"),
    )


# --- joins and clusters ----------------------------------------------------------


def _lines(spark, sf_dir, role):
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == role)
    keyed = turns.select((F.col("conv_id") * 2**32 + F.col("turn")).alias("key"), "text")
    return ranking.with_key_rank(keyed, "key", "line_no").select("line_no", "text")


@query
def aligned_zip(spark, sf_dir):
    return parallel_text.select_pairs(_lines(spark, sf_dir, "user"), _lines(spark, sf_dir, "assistant"))


@query
def aligned_sample_trim(spark, sf_dir):
    return parallel_text.select_pairs(
        _lines(spark, sf_dir, "user"), _lines(spark, sf_dir, "assistant"), 120, 40
    )


@query
def drop_last(spark, sf_dir):
    return align.drop_last(_lines(spark, sf_dir, "user"))


@query
def attach_outputs(spark, sf_dir):
    pairs = conversation_pairs(spark, sf_dir).select("pair_id", "source")
    outputs = predicted_pairs(spark, sf_dir).select("pair_id", "prediction")
    return align.attach_outputs(pairs, outputs)


@query
def missing_vectors(spark, sf_dir):
    pairs = document_pairs(spark, sf_dir).select("source_id", "target_id")
    return align.missing_vectors(pairs, table(spark, sf_dir, "embeddings"))


@query
def cluster_pairs(spark, sf_dir):
    docs = _documents(spark, sf_dir).withColumnRenamed("source", "set_id")
    return clusters.pair_neighbours(docs, "set_id", "text", "doc_id").select(
        "source_id",
        "target_id",
        F.md5("source").alias("source_md5"),
        F.md5("target").alias("target_md5"),
    )


@query
def cluster_pairs_cut(spark, sf_dir):
    """Clusters cut into pieces of a few rows give the pairs of whole ones."""
    docs = _documents(spark, sf_dir).withColumnRenamed("source", "set_id")
    return clusters.pair_neighbours(docs, "set_id", "text", "doc_id", hot_rows=7).select(
        "source_id",
        "target_id",
        F.md5("source").alias("source_md5"),
        F.md5("target").alias("target_md5"),
    )


@query
def cluster_collect_cut(spark, sf_dir):
    """Arrays of five members, from clusters cut into pieces."""
    held = clusters.collect_clusters(
        _documents(spark, sf_dir), "source", "text", "doc_id", hot_rows=7, part_rows=5
    )
    ids = F.array_join(F.transform("members.key", lambda k: k.cast("string")), ",")
    return held.select("source", "part", F.col("n").cast("long").alias("n"), ids.alias("ids"))


@query
def cluster_pairs_by_label(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("text", F.col("vec_id").cast("string"))
    return clusters.pair_neighbours(rows, "label", "text", "vec_id", seed=3).select(
        F.col("label").cast("long").alias("label"), "source_id", "target_id"
    )


@query
def cluster_collect(spark, sf_dir):
    held = clusters.collect_clusters(_documents(spark, sf_dir), "source", "text", "doc_id")
    return held.select(
        "source",
        "part",
        F.col("n").cast("long").alias("n"),
        F.array_join(F.transform("members.key", lambda k: k.cast("string")), ",").alias("ids"),
        F.md5(F.array_join("members.text", "|")).alias("texts"),
    )


# --- vectors ---------------------------------------------------------------------


@query
def semantic_score(spark, sf_dir):
    a, b = F.col("source_vec"), F.col("target_vec")
    scored = vector_pairs(spark, sf_dir).select(
        "pair_id",
        vectors.cosine(a, b).alias("cosine"),
        vectors.unit_cosine(a, b).alias("sem_sim"),
        vectors.paired_cosine_similarity(a, b).alias("paired"),
    )
    return _rounded(scored, "cosine", "sem_sim", "paired")


@query
def semantic_threshold(spark, sf_dir):
    a, b = F.col("source_vec"), F.col("target_vec")
    scored = compute_once(vector_pairs(spark, sf_dir), {"sem_sim": vectors.unit_cosine(a, b)})
    return _rounded(prune.above_similarity(scored.select("pair_id", "sem_sim"), 0.55), "sem_sim")


@query
def mean_pool(spark, sf_dir):
    """Each vector read as 8 tokens of 8 dimensions, masked by token number and vector id."""
    rows = table(spark, sf_dir, "embeddings")
    token_vecs = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8))
    )
    mask = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.when((i + F.col("vec_id")) % 3 > 0, 1).otherwise(0) * F.when(F.col("vec_id") % 50 == 0, 0).otherwise(1),
    )
    pooled = rows.select("vec_id", vectors.mean_pool(token_vecs, mask).alias("v"))
    return _rounded(
        pooled.select("vec_id", F.posexplode("v").alias("dim", "value"))
        .withColumn("dim", F.col("dim").cast("long")),
        "value",
    )


@query
def sts_eval(spark, sf_dir):
    return _rounded(metrics.evaluate(vector_pairs(spark, sf_dir), "sts"), "pearson", "mse")


# --- generation metrics ----------------------------------------------------------


@query
def bleu_corpus(spark, sf_dir):
    return _rounded(bleu.corpus_bleu(predicted_pairs(spark, sf_dir)), "bleu")


@query
def bleu_documents(spark, sf_dir):
    """Whole documents as references: long texts with many repeats."""
    docs = _documents(spark, sf_dir)
    kept = F.filter(F.split("text", " "), lambda _, i: (i + 1) % 5 != 0)
    rows = docs.select(F.col("text").alias("target"), F.array_join(kept, " ").alias("prediction"))
    return _rounded(bleu.corpus_bleu(rows), "bleu")


@query
def self_bleu(spark, sf_dir):
    rows = predicted_pairs(spark, sf_dir)
    return _rounded(bleu.corpus_bleu(rows, reference="source", name="self_bleu"), "self_bleu")


@query
def bleu_smoothed(spark, sf_dir):
    """Against the source, where the higher orders may have no match."""
    return bleu.smoothed_bleu(predicted_pairs(spark, sf_dir), reference="source")


@query
def generation_report(spark, sf_dir):
    pairs = predicted_pairs(spark, sf_dir)
    stored = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # A conversation's vector stands for its target, the next conversation's for the prediction.
    rows = pairs.join(
        stored.select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("reference_vec")), "conv_id"
    ).join(
        stored.select((F.col("vec_id") - 1).alias("conv_id"), F.col("embedding").alias("prediction_vec")), "conv_id"
    )
    scores = metrics.evaluate(rows, "generation", reference="target")
    return metrics.report(scores)


@query
def generation_lower_case(spark, sf_dir):
    rows = predicted_pairs(spark, sf_dir).select("source", "target", "prediction")
    return _rounded(generate.score(rows, lower_case=True), "bleu", "self_bleu")


@query
def gold_report(spark, sf_dir):
    """Sources scored as predictions: self-BLEU must be 1."""
    rows = predicted_pairs(spark, sf_dir).select("source", "target")
    return _rounded(generate.score(rows, "generation", "source", "target", "source"), "bleu")


# --- profiles and histograms -----------------------------------------------------


def _lengths(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "doc_id", tokens.word_count(F.col("text")).cast("long").alias("words")
    )


@query
def length_extremes(spark, sf_dir):
    return stats.extremes(_lengths(spark, sf_dir), "words")


@query
def length_hist(spark, sf_dir):
    pairs = conversation_pairs(spark, sf_dir).select(F.length("source").cast("long").alias("n"))
    return _rounded(stats.length_histogram(pairs, "n").withColumnRenamed("n", "rows"), "density")


def _scores(spark, sf_dir):
    score = vectors.unit_cosine(F.col("source_vec"), F.col("target_vec"))
    return compute_once(vector_pairs(spark, sf_dir).select("pair_id", "source_vec", "target_vec"), {"sem_sim": score})


@query
def score_hist(spark, sf_dir):
    """Over event values, which are the same doubles in both engines."""
    hist = stats.score_histogram(table(spark, sf_dir, "events").select("value"), "value")
    return _rounded(hist, "lo", "hi", "centre", "proportion")


@query
def minmax_score(spark, sf_dir):
    rows = stats.min_max_normalise(_scores(spark, sf_dir).select("pair_id", "sem_sim"), "sem_sim")
    return _rounded(rows, "sem_sim", "normalised")


@query
def corpus_profile(spark, sf_dir):
    docs = document_pairs(spark, sf_dir).select("source", "target")
    talks = conversation_pairs(spark, sf_dir).select("source", "target")
    items = table(spark, sf_dir, "benchmark").select(
        F.col("text").alias("source"), F.upper("text").alias("target")
    )
    return profile_corpora.profile_corpora({"documents": docs, "conversations": talks, "benchmark": items})


# --- labels and arrays -----------------------------------------------------------


@query
def entailment_codes(spark, sf_dir):
    names = F.create_map(
        *[F.lit(x) for x in ("click", "None", "view", "ENTAILMENT", "signup", "Paraphrase", "error", "")]
    )
    label = F.element_at(names, F.col("event_type"))
    attribute = F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 6).cast("string"))
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "purchase", "odd").otherwise(label).alias("label"),
        attribute.alias("similarity"),
    )
    code = labels.entailment_code(F.col("label"))
    similarity = labels.parse_similarity(F.col("similarity"))
    return rows.select(
        "event_id",
        code.cast("long").alias("code"),
        labels.entailment_code(F.col("label"), force=True).cast("long").alias("forced"),
        labels.entailment_label(code).alias("name"),
        labels.unit_similarity(similarity).alias("similarity"),
        labels.parse_similarity(F.col("similarity"), force=True).alias("forced_similarity"),
    )


def _ids(spark, sf_dir):
    """Token ids for benchmark texts: the length of each word; 0 is padding."""
    words = F.split("text", " ")
    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.transform(words, lambda w: F.length(w)).alias("ids")
    )


def _joined(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query
def encode_arrays(spark, sf_dir):
    rows = _ids(spark, sf_dir).select(
        "item_id",
        arrays.encode(F.col("ids"), 30, 0).alias("x"),
        arrays.encode_labels(F.col("ids"), 24, 0).alias("labels"),
    )
    return rows.select(
        "item_id",
        _joined("x.input_ids").alias("input_ids"),
        _joined("x.attention_mask").alias("attention_mask"),
        _joined("labels").alias("labels"),
        _joined(arrays.unmask_labels(F.col("labels"), 0)).alias("unmasked"),
        arrays.count_tokens(F.col("x.input_ids"), 0).cast("long").alias("n_tokens"),
    )


@query
def gen_len(spark, sf_dir):
    rows = _ids(spark, sf_dir).select(arrays.pad(F.col("ids"), 60, 0).alias("ids"))
    return stats.mean_length(rows, "ids", 0)


@query
def labelled_pairs(spark, sf_dir):
    """Annotated pairs that carry at least one label; the others are set apart."""
    rows = conversation_pairs(spark, sf_dir).select(
        F.col("pair_id").cast("string").alias("_id"),
        F.when(F.col("conv_id") % 3 > 0, "Entailment").otherwise("").alias("_entailment"),
        F.when(F.col("turn") % 4 > 0, "2.5").alias("_similarity"),
        F.col("source").alias("t"),
        F.lit("").alias("h"),
    )
    labelled, _ = prune.split_by_labels(readers.annotated_pairs(rows, need_labels=False))
    return _longs(prune.require_labels(labelled), "entailment")


# --- models, files, streams ------------------------------------------------------


# Stand-ins for models are nested functions, so they travel with the plan.


@query
def infer_predictions(spark, sf_dir):
    rows = conversation_pairs(spark, sf_dir).select("pair_id", "source", "target")

    def load():
        return lambda texts: [f" {len(t)} characters " for t in texts]

    return generate.generate(rows, load, "source", "target", "say: ", keep=("pair_id",))


@query
def infer_similarity(spark, sf_dir):
    rows = conversation_pairs(spark, sf_dir).select("pair_id", "source", "target")

    def load():
        return lambda texts: [[float(t.count(c)) for c in "aeion"] for t in texts]

    return _rounded(filtering.score_with_model(rows, load).select("pair_id", "sem_sim"), "sem_sim")


@query
def translate_pairs(spark, sf_dir):
    rows = conversation_pairs(spark, sf_dir).select("pair_id", "source", "target")

    def load():
        return lambda texts: [t.replace("e", "E") for t in texts]

    return parallel_text.translate(rows, load)


@query
def xml_pairs(spark, sf_dir):
    """Written as XML pair elements and read back as annotated pairs."""
    rows = conversation_pairs(spark, sf_dir)
    elements = rows.select(
        F.col("pair_id").cast("string").alias("_id"),
        F.element_at(F.array(*map(F.lit, ("None", "Entailment", "PARAPHRASE", "other"))), (F.col("conv_id") % 4 + 1).cast("int")).alias("_entailment"),
        (F.col("turn") % 6).cast("double").cast("string").alias("_similarity"),
        F.translate("source", "\n", " ").alias("t"),
        F.translate("target", "\n", " ").alias("h"),
    )
    path = fresh_path(spark, "xml")
    elements.write.format("xml").options(rowTag="pair", rootTag="entailment-corpus").save(path)
    return _longs(readers.read_xml(spark, path, need_labels=True), "entailment")


@query
def jsonl_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "jsonl")
    writers.write_jsonl(dirty_pairs(spark, sf_dir).select("source", "target"), path)
    return readers.read_jsonl(spark, path)


@query
def predictions_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "tsv")
    writers.write_predictions(predicted_pairs(spark, sf_dir), path)
    return readers.read_delimited(spark, path)


@query
def lines_roundtrip(spark, sf_dir):
    """Sources written one line each in key order, read back with their line numbers."""
    path = fresh_path(spark, "lines")
    rows = conversation_pairs(spark, sf_dir).withColumn("line", F.translate("source", "\n", " "))
    writers.write_lines(rows, path, "line", order="pair_id")
    return readers.read_stripped_lines(spark, path)


@query
def splits_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "splits")
    rows = conversation_pairs(spark, sf_dir).select("pair_id", "source", "target")
    writers.write_splits(ranking.split_80_10_10(rows), path)
    schema = "pair_id long, source string, target string, split string"
    return readers.read_jsonl(spark, path, schema)


@query
def named_split(spark, sf_dir):
    """A stored table read by name, one split of it."""
    rows = conversation_pairs(spark, sf_dir).select("pair_id", "source", "target")
    path = fresh_path(spark, "named")
    ranking.split_80_10_10(rows).write.partitionBy("split").parquet(path)
    return readers.read_named(spark, path, split="validation").select("pair_id", "source")


@query
def load_prepared(spark, sf_dir):
    """Files per split, cleaned, cut to the first rows, filtered and mapped."""
    rows = dirty_pairs(spark, sf_dir).select("pair_id", "source", "target")
    path = fresh_path(spark, "load") + ".jsonl"
    writers.write_jsonl(rows, path)
    loaded = splits.load_splits(
        spark, {"train": path, "test": path}, "pair_id long, source string, target string"
    )
    ready = splits.prepare(
        loaded,
        max_rows={"train": 60, "test": 10},
        predicate="length(source) > 40",
        mapping="n = length(target)",
    )
    return _longs(
        ready["train"].withColumn("split", F.lit("train")).unionByName(
            ready["test"].withColumn("split", F.lit("test"))
        ),
        "n",
    )


@query
def generate_job(spark, sf_dir):
    """The whole job from a JSON file to a prediction file: clean, cut, filter, map, generate."""
    rows = dirty_pairs(spark, sf_dir).select("pair_id", "source", "target", "conv_id")
    given, made = fresh_path(spark, "given") + ".jsonl", fresh_path(spark, "made")
    writers.write_jsonl(rows, given)
    generate.prepare_and_generate(
        spark,
        made,
        lambda: lambda texts: [f" {t.replace('e', 'E')}\n" for t in texts],
        file=given,
        remove_bad_chars=True,
        max_samples=120,
        predicate="conv_id % 3 > 0",
        mapping="source = concat('q: ', source)",
        source="source",
        target="target",
    )
    return readers.read_delimited(spark, made)


@query
def score_job(spark, sf_dir):
    """A prediction file to a report file of four values; vectors by a small model."""
    given, made = fresh_path(spark, "given"), fresh_path(spark, "report")
    writers.write_predictions(predicted_pairs(spark, sf_dir), given)

    def load():
        return lambda texts: [[float(t.count(c)) for c in "etaoin"] for t in texts]

    return generate.run_score(spark, given, made, load=load)


@query
def skip_existing(spark, sf_dir):
    """Writing twice to one place, the second time other rows and without effect."""
    rows = conversation_pairs(spark, sf_dir).select("pair_id", "source")
    path = fresh_path(spark, "once")
    writers.write_jsonl(rows, path, skip_existing=True)
    writers.write_jsonl(rows.withColumn("source", F.lit("changed")), path, skip_existing=True)
    return readers.read_jsonl(spark, path, "pair_id long, source string")


@query
def whole_output(spark, sf_dir):
    """An output cut short is written anew, a finished one is left alone."""
    rows = conversation_pairs(spark, sf_dir).select("pair_id", "source")
    path = fresh_path(spark, "whole")
    rows.withColumn("source", F.lit("cut short")).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).json(path)
    write_whole(rows, path, writers.write_jsonl)
    write_whole(rows.withColumn("source", F.lit("changed")), path, writers.write_jsonl)
    return readers.read_jsonl(spark, path, "pair_id long, source string")


@query
def rejected_rows(spark, sf_dir):
    """JSON lines of which some are cut short and some lack a side, told apart in one scan."""
    rows = conversation_pairs(spark, sf_dir)
    target = F.when(F.col("conv_id") % 5 != 1, F.col("target"))
    line = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit('{"pair_id": '), F.col("pair_id").cast("string"))).otherwise(
        F.to_json(F.struct("pair_id", "source", target.alias("target")))
    )
    path = fresh_path(spark, "lines")
    rows.select(line.alias("value")).write.text(path)
    found = checked.read_checked_jsonl(
        spark, path, "pair_id long, source string, target string", {"no target": "target IS NOT NULL", "odd turn": "pair_id % 8 < 6"}
    )
    broken = F.when(F.col("reason") == checked.NO_JSON, F.col("text"))
    return found.select("pair_id", "source", "target", "reason", broken.alias("broken"))


@query
def filter_counts(spark, sf_dir):
    """Rows that come to each step of the pair filter, counted in the pass that filters."""
    stored = table(spark, sf_dir, "embeddings")
    counts = Counts()
    durable(
        filtering.filter_pairs(
            document_pairs(spark, sf_dir),
            lambda df: filtering.score_with_vectors(df, stored),
            semantic_threshold=0.55,
            counts=counts,
        ),
        "filtered",
    )
    return spark.createDataFrame(list(counts.result().items()), "step string, rows long")


@query
def stream_clean_pairs(spark, sf_dir):
    """The pair cleaner over a file stream, drained; same rows as the batch plan."""
    source, sink, state = (fresh_path(spark, n) for n in ("arrivals", "cleaned", "state"))
    writers.write_jsonl(dirty_pairs(spark, sf_dir).select("pair_id", "source", "target"), source)
    arriving = stream.read_pair_stream(spark, source)
    stream.write_clean_stream(arriving, sink, state, availableNow=True).awaitTermination()
    schema = "pair_id long, source string, target string, src_len long, tgt_len long"
    return spark.read.schema(schema).json(sink)
