"""One query per operator over the given tables, and SQL twins where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import (
    ball_tree,
    cap_filters,
    decontaminate,
    language,
    minhash,
    packing,
    pii,
    quality,
    runs,
    substrings,
    token_grammar,
    toxicity,
    warc,
)
from pairforge.llm.common import is_fold, table
from pairforge.runtime import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, toxicity.learned_from(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, lexicon).select(
        "doc_id", is_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted", "n_hits"
    )


@query
def op8_decontaminate(spark, sf_dir):
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(listed, 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


_BENCHMARK_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

CONTAMINATION = """
contamination AS (
    WITH d AS (SELECT doc_id, {words} AS w FROM {documents}),
    b AS (SELECT item_id, {words} AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + 12], ' ') AS phrase
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
    ),
    places AS (
        SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
        FROM (
            SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
            FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
        )
    ),
    found AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows v ON p.size = v.size AND p.phrase = v.phrase),
    hit AS (
        SELECT doc_id, count(*) AS n_hit
        FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS pos FROM found) GROUP BY doc_id
    ),
    item AS (
        SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS listed
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM found) GROUP BY doc_id
    )
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
        coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
)
"""

ORACLE["op8_decontaminate"] = (
    "WITH " + CONTAMINATION.format(words=_BENCHMARK_WORDS, documents="documents") + "SELECT * FROM contamination"
)


@query
def op9_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detect(docs).drop("text")


def packed_pieces(docs: DataFrame, cached_words: int = packing.CACHED_WORDS) -> DataFrame:
    """Pieces with a digest in place of their ids."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached_words=cached_words)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op7_packing(spark, sf_dir):
    return packed_pieces(table(spark, sf_dir, "documents"))


@query
def op3_minhash(spark, sf_dir):
    return minhash.near_copies(table(spark, sf_dir, "documents")).drop("row")


@query
def op1_substrings(spark, sf_dir):
    return substrings.repeated_passages(table(spark, sf_dir, "documents")).drop("row")


@query
def op2_embeddings(spark, sf_dir):
    return cap_filters.near_copies(table(spark, sf_dir, "embeddings"))


@query
def op6_warc(spark, sf_dir):
    """Archives written to the shared folder and read back."""
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read_records(spark, path))


ORACLE["op6_warc"] = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS kept FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
    CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM k
"""


@query
def op5_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~is_fold("doc_id", 5, 0)))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", is_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score"
    )


@query
def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~is_fold("doc_id", 4, 2))
    return quality.score(docs, quality.fit(docs, labels)).select(
        "doc_id", is_fold("doc_id", 4, 2).alias("held_out"), "score", "predicted"
    )


@query
def op13_token_grammar(spark, sf_dir):
    """Token files written to the shared folder and read back."""
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    token_grammar.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_grammar.digests(spark, path)


def _planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where, and with what period, the words of one document in ten are repeated. Never without an id."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


@query
def op11_runs(spark, sf_dir):
    return runs.detect(table(spark, sf_dir, "documents"), _planted)


# The checksum of the decimal id, byte by byte and bit by bit.
_CRC32 = """xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(
        list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))))"""

ORACLE["op11_runs"] = f"""
WITH read AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        {_CRC32.format(text="doc_id::VARCHAR")} AS h
    FROM documents
),
planned AS (
    SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM read
),
shaped AS (
    SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) ELSE n + 1 END AS p FROM planned
),
d AS (
    SELECT doc_id, n, CASE WHEN planted
        THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w
    FROM shaped
),
word AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM d),
equal AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM word x JOIN word y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
),
island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM equal),
stretch AS (
    SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM island
    GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)
),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
best AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DECIMAL(38, 20) / period DESC, start, period) AS place FROM run
),
listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
    FROM run GROUP BY doc_id
),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM word ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
    (1000 * length // period)::BIGINT AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN (FROM best WHERE place = 1) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

@query
def op12_ranked_search(spark, sf_dir):
    return ball_tree.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = _BENCHMARK_WORDS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")

ORACLE["op12_ranked_search"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
item AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
counted AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
total AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
weight AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM counted, total GROUP BY term, docs
),
long AS (SELECT doc_id, 100 - 90 + (90 * len(w)::BIGINT * docs) // words AS m FROM d, total),
scored AS (
    SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM item JOIN counted USING (term) JOIN weight USING (term) JOIN long USING (doc_id) GROUP BY item_id, doc_id
),
ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

_REACH = """
reach AS (SELECT id AS x, id AS y FROM nodes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
component AS (SELECT x AS id, min(y) AS component_id FROM reach GROUP BY x)
"""

ORACLE["op2_embeddings"] = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
nodes AS (SELECT vec_id AS id FROM embeddings),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
{_REACH}
SELECT n.id AS vec_id, count(l.y) AS n_links, c.component_id, n.id = c.component_id AS kept
FROM nodes n JOIN component c ON n.id = c.id LEFT JOIN links l ON n.id = l.x GROUP BY n.id, c.component_id
"""

ORACLE["op3_minhash"] = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
nodes AS (SELECT doc_id AS id FROM documents),
both_have AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
    SELECT x, y FROM both_have JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
    WHERE 100 * c >= 85 * (a.n + b.n - c)
),
{_REACH}
SELECT d.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.id = c.component_id AS kept
FROM nodes d JOIN component c ON d.id = c.id LEFT JOIN n ON n.doc_id = d.id
"""
