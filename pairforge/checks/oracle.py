"""DuckDB SQL for the queries, written from the specification and not from the plans."""

from __future__ import annotations

from pairforge.checks.inputs import DIRT
from pairforge.functions.text import QUOTES_A, QUOTES_B
from pairforge.operators.epochs import Permutation

# Whitespace in RE2 terms.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


PAIRS = """
pairs AS (
  SELECT u.conv_id * 4294967296 + u.turn AS pair_id, u.conv_id, u.turn,
         u.text AS source, a.text AS target
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def _dirty(text: str, shift: int) -> str:
    before = ", ".join(_s(d[0]) for d in DIRT)
    after = ", ".join(_s(d[1]) for d in DIRT)
    i = f"((conv_id + turn + {shift}) % {len(DIRT)} + 1)"
    return f"([{before}])[{i}] || {text} || ([{after}])[{i}]"


DIRTY = f"""{PAIRS},
dirty AS (
  SELECT pair_id, conv_id, turn, {_dirty('source', 0)} AS source, {_dirty('target', 1)} AS target
  FROM pairs)"""


def _replaces(expr: str, rules) -> str:
    for old, new in rules:
        expr = f"replace({expr}, {_s(old)}, {_s(new)})"
    return expr


# The quotation marks are those of the cleaners, in their order.
_QUOTES_A = [(q, '"') for q in QUOTES_A]
_QUOTES_B = list(QUOTES_B)


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def _clean_a(out: str, src: str) -> str:
    """CTEs that take table ``src`` to table ``out`` with both texts cleaned."""

    def both(form) -> str:
        return ", ".join(f"{form(c)} AS {c}" for c in ("source", "target"))

    def quoted(c: str) -> str:
        marks = f"(length({c}) - length(replace({c}, '\"', '')))"
        return (
            f"CASE WHEN {marks} = 1 THEN replace({c}, '\"', '') "
            f"WHEN {marks} = 2 AND starts_with({c}, '\"') AND ends_with({c}, '\"') "
            f"THEN substring({c}, 2, length({c}) - 2) ELSE {c} END"
        )

    def caption(c: str) -> str:
        return f"regexp_replace(replace({c}, chr(160), ' '), '^[(\\[][^\\n]*?[)\\]]', '')"

    def spaced(c: str) -> str:
        collapsed = f"regexp_replace({c}, '{WS}+', ' ', 'g')"
        return _strip(f"regexp_replace({_strip(collapsed)}, '^-', '')")

    rest = "* EXCLUDE (source, target)"
    return f"""
{out}_q AS (SELECT {rest}, {both(lambda c: _replaces(caption(c), _QUOTES_A))} FROM {src}),
{out}_f AS (SELECT {rest}, {both(quoted)} FROM {out}_q),
{out} AS (SELECT {rest}, {both(spaced)} FROM {out}_f)"""


def _clean_b(c: str) -> str:
    return _replaces(f"regexp_replace({_strip(c)}, ' +', ' ', 'g')", _QUOTES_B)


# Word tokens without look-ahead: a mark before a dot that must not join the word
# in front of it, then the alternatives with the mark excluded.
_W, _D, _L = r"[\p{L}\p{N}_]", r"\p{Nd}", r"[\p{L}\p{Nl}\p{No}]"
_WORD = "|".join(
    [
        rf"(?:{_L}\.)+",
        rf"{_D}+(?:[.,]{_D}+)*(?:[.,]{_D}+)",
        rf"{_W}+\.?",
        rf"{_D}+(?:[-\\/]{_D}+)*",
        r"\$",
        "-+",
        r"[^\s\x0b\x01\x1c-\x1f\x{85}\p{Z}]",
    ]
)


def _words(c: str) -> str:
    marked = rf"regexp_replace({c}, '(?m)({_W}{_W}|[\p{{Nd}}_])(\.)(\.|$)', e'\\1\x01\\2\\3', 'g')"
    return f"regexp_extract_all({marked}, '{_WORD}')"


def _count(c: str) -> str:
    return f"len({_words(c)})::BIGINT"


def _bleu_tokens(c: str) -> str:
    literal = [
        ("<skipped>", ""), ("-\n", ""), ("\n", " "),
        ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ]
    expr = f"' ' || {_replaces(c, literal)} || ' '"
    for pattern, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        expr = f"regexp_replace({expr}, '{pattern}', '{new}', 'g')"
    return rf"regexp_extract_all({expr}, '[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+')"


def _hash(key: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || {key}::VARCHAR)"


def _ranked(key: str, columns: str = "*", seed: int = 42, table: str = "documents") -> str:
    return (
        f"ranked AS (SELECT {columns}, row_number() OVER (ORDER BY {_hash(key, seed)}, {key}) AS r, "
        f"count(*) OVER () AS n FROM {table})"
    )


PREDICTED = f"""{PAIRS},
predicted AS (
  SELECT *, array_to_string(list_filter(string_split(target, ' '), lambda x, i: i % 5 <> 0), ' ')
    AS prediction
  FROM pairs)"""


def _bleu(out: str, rows: str, prediction: str, reference: str) -> str:
    """CTEs ending in table ``out``: one row m1..m4, p1..p4 (possible), c and r (lengths)."""
    p = f"{out}_"

    def grams(side: str) -> str:
        return f"""
{p}{side}w AS (SELECT id, unnest({side}t) AS w, generate_subscripts({side}t, 1) AS i FROM {p}t),
{p}{side}x AS (
  SELECT id, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
  FROM {p}{side}w WINDOW o AS (PARTITION BY id ORDER BY i)),
{p}{side}g AS (
  SELECT id, n, gram, count(*) AS k FROM (
    SELECT id, unnest([1, 2, 3, 4]) AS n, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3,
           w || ' ' || w2 || ' ' || w3 || ' ' || w4]) AS gram FROM {p}{side}x)
  WHERE gram IS NOT NULL GROUP BY ALL)"""

    return f"""
{p}t AS (SELECT row_number() OVER () AS id, {_bleu_tokens(prediction)} AS pt,
                {_bleu_tokens(reference)} AS rt FROM {rows}),
{p}n AS (SELECT unnest([1, 2, 3, 4]) AS n),
{grams('p')},
{grams('r')},
{p}m AS (SELECT n, sum(least(a.k, b.k)) AS m FROM {p}pg a JOIN {p}rg b USING (id, n, gram) GROUP BY n),
{p}l AS (SELECT sum(len(pt)) AS c, sum(len(rt)) AS r FROM {p}t),
{p}s AS (
  SELECT n, coalesce(m, 0)::DOUBLE AS m,
         (SELECT sum(greatest(len(pt) - n + 1, 0)) FROM {p}t)::DOUBLE AS poss
  FROM {p}n LEFT JOIN {p}m USING (n)),
{out} AS (
  SELECT CASE WHEN min(m) = 0 THEN 0.0
         ELSE exp(avg(ln(CASE WHEN m > 0 THEN m / poss ELSE 1 END)))
              * (SELECT CASE WHEN c > r THEN 1.0 ELSE exp(1 - r / c) END FROM {p}l) END AS bleu
  FROM {p}s)"""


VECTOR_PAIRS = """
vp AS (
  SELECT a.vec_id AS pair_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y,
         CASE WHEN a.label = b.label THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"""

DOCUMENT_PAIRS = """
dp AS (
  SELECT a.doc_id AS source_id, b.doc_id AS target_id, a.text AS source, b.text AS target
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0)"""


def _lines(name: str, role: str) -> str:
    return (
        f"{name} AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no, text "
        f"FROM conversations WHERE role = '{role}')"
    )


def _ratio(threshold: float) -> str:
    return f"abs(src_len - tgt_len) / nullif(greatest(src_len, tgt_len), 0)::DOUBLE < {threshold}"


_COUNTED = f"SELECT pair_id, source, target, {_count('source')} AS src_len, {_count('target')} AS tgt_len"


def _neighbours(cluster: str, key: str, table: str, seed: int, a: str, b: str) -> str:
    return f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY {cluster} ORDER BY {_hash(key, seed)}, {key}) AS rn
           FROM {table})
SELECT {a}, {b} FROM o x JOIN o y ON x.{cluster} = y.{cluster} AND y.rn = x.rn + 1 WHERE x.rn % 2 = 1"""


_BLEU_BOTH = (
    f"WITH {PREDICTED}, {_bleu('b', 'predicted', 'prediction', 'target')}, "
    f"{_bleu('s', 'predicted', 'prediction', 'source')}"
)

TURNS_WITH_GAPS = """t AS (
  SELECT conv_id, md5('42:' || coalesce(conv_id::VARCHAR, '')) AS h
  FROM (SELECT CASE WHEN conv_id % 7 > 0 THEN conv_id END AS conv_id FROM conversations))"""



def _treebank(c: str) -> str:
    """Marks of a sentence set apart by spaces."""
    for pattern, new in (
        (r"\.\.\.", " ... "),
        (r"([:,])([^0-9])", r" \1 \2"),
        (r"([:,])\z", r" \1 "),
        (r"([;@#$%&?!\[\](){}<>«»“”\"])", r" \1 "),
        ("--", " -- "),
        (r"([^.])(\.)([ ''’]*)\z", r"\1 \2 \3"),
        (r"(''[sSmMdD]|''ll|''LL|''re|''RE|''ve|''VE|n''t|N''T)( |\z)", r" \1 "),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return c


def _epoch_keys(n: int) -> str:
    """Keys of the first epochs; how they mix row numbers is said again in SQL."""
    rows = ((epoch, *(v for key in Permutation.of(1, epoch).keys for v in key)) for epoch in range(n))
    return ", ".join(f"({epoch}, {', '.join(f'{v}::BIGINT' for v in keys)})" for epoch, *keys in rows)


_AROUND = """'^["''(\\[{«“‘]+|["'')\\]}»”’]+\\z'"""
# Words with what tells sentences apart, and the model, as numbered words of the texts.
SENTENCE_MODEL = rf"""
piece AS (
  SELECT doc_id, piece, i FROM (
    SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda t: t <> '') AS p FROM documents))),
cored AS (SELECT *, regexp_replace(piece, {_AROUND}, '', 'g') AS core FROM piece),
w AS (
  SELECT doc_id, i, piece, lower(regexp_replace(core, '\.\z', '')) AS word, ends_with(core, '.') AND NOT ends_with(core, '..') AS dot,
    regexp_matches(core, '([?!]|\.\.)\z') AS stop, regexp_matches(core, '^\p{{Lu}}') AS upper, regexp_matches(core, '^\p{{Ll}}') AS low
  FROM cored),
typed AS (SELECT word, count(*) FILTER (dot) AS a, count(*) FILTER (NOT dot) AS b FROM w WHERE regexp_matches(word, '\p{{L}}') GROUP BY word),
chance AS (SELECT sum(a)::DOUBLE / sum(a + b) AS p FROM typed),
abbreviation AS (
  SELECT word, -2 * (a * ln(p) + b * ln(1 - p) - a * ln(0.99) - b * ln(1 - 0.99)) * exp(-(length(word) - inner_dots)) * (inner_dots + 1)
    * pow(greatest(length(word) - inner_dots, 1), -b) AS score
  FROM (SELECT *, length(word) - length(replace(word, '.', '')) AS inner_dots FROM typed WHERE a > 0), chance),
short AS (SELECT * FROM abbreviation WHERE score >= 0.3),
pair AS (
  SELECT y.word, x.stop OR (x.dot AND x.word NOT IN (SELECT word FROM short)) AS ends
  FROM w x JOIN w y ON x.doc_id = y.doc_id AND y.i = x.i + 1 WHERE regexp_matches(y.word, '\p{{L}}')),
follow AS (SELECT word, count(*) FILTER (ends)::DOUBLE AS k, count(*)::DOUBLE AS n FROM pair GROUP BY word),
sums AS (SELECT sum(n) AS total, sum(k) AS ended FROM follow),
rated AS (SELECT *, n / total AS p, k / ended AS p1, (n - k) / (total - ended) AS p2 FROM follow, sums WHERE k > 0),
safe AS (SELECT *, least(greatest(p1, 1e-12), 1 - 1e-12) AS s1, least(greatest(p2, 1e-12), 1 - 1e-12) AS s2 FROM rated WHERE p1 > p2),
starter AS (
  SELECT word, -2 * (k * ln(p) + (ended - k) * ln(1 - p) + (n - k) * ln(p) + (total - ended - n + k) * ln(1 - p)
    - k * ln(s1) - (ended - k) * ln(1 - s1) - (n - k) * ln(s2) - (total - ended - n + k) * ln(1 - s2)) AS score FROM safe),
known AS (SELECT * FROM starter WHERE score >= 30)"""

ORACLE: dict[str, str] = {
    "sentence_model": f"""
WITH {SENTENCE_MODEL}
SELECT 'abbreviation' AS kind, word, round(score, 3) AS score FROM short
UNION ALL SELECT 'starter', word, round(score, 3) FROM known""",
    "word_count_sentences": rf"""
WITH {SENTENCE_MODEL},
next AS (
  SELECT *, lead(upper) OVER o AS next_upper, lead(low) OVER o AS next_low, lead(word) OVER o AS next_word FROM w
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ended AS (
  SELECT doc_id, i, piece, coalesce(CASE
    WHEN regexp_matches(piece, '\.\.["'')\]}}»”’]*\z') THEN next_upper
    WHEN stop THEN true
    WHEN dot AND (word IN (SELECT word FROM short) OR regexp_matches(word, '^\p{{L}}\z'))
      THEN next_upper AND next_word IN (SELECT word FROM known)
    WHEN dot THEN NOT next_low ELSE false END, false) AS ends FROM next),
numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ended),
sentence AS (SELECT doc_id, s, string_agg(piece, ' ' ORDER BY i) AS t FROM numbered GROUP BY doc_id, s),
marked AS (SELECT doc_id, {_treebank('t')} AS t FROM sentence),
counted AS (SELECT doc_id, count(*) AS n, sum(len(list_filter(string_split(t, ' '), lambda x: x <> '')))::BIGINT AS words FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(words, 0)::BIGINT AS words FROM documents LEFT JOIN counted USING (doc_id)""",
    "clean_pairs_a": f"WITH {DIRTY}, {_clean_a('clean', 'dirty')} SELECT pair_id, source, target FROM clean",
    "clean_pairs_b": rf"""
WITH {DIRTY}, bare AS (
  SELECT pair_id, regexp_replace(source, '\p{{C}}', '', 'g') AS source,
         regexp_replace(target, '\p{{C}}', '', 'g') AS target,
         regexp_replace('a' || chr(8205) || chr(173) || chr(9) || source || ' ' || chr(10),
                        '\p{{C}}', '', 'g') AS note FROM dirty)
SELECT pair_id, {_clean_b('source')} AS source, {_clean_b('target')} AS target, note FROM bare""",
    "clean_pairs_b_keep_controls": f"""
WITH {DIRTY} SELECT pair_id, {_clean_b('source')} AS source, {_clean_b('target')} AS target FROM dirty""",
    "word_count": f"""
SELECT 'documents' AS corpus, doc_id AS id, {_count('text')} AS words FROM documents
UNION ALL SELECT 'benchmark', item_id, {_count('text')} FROM benchmark""",
    "word_token_text": f"SELECT item_id, array_to_string({_words('text')}, '|') AS tokens FROM benchmark",
    "bleu_token_text": f"SELECT doc_id, array_to_string({_bleu_tokens('text')}, ' ') AS tokens FROM documents",
    "token_ngrams": f"""
WITH t AS (SELECT item_id, {_bleu_tokens('text')} AS t FROM benchmark),
     n AS (SELECT unnest([1, 2, 3, 4]) AS n)
SELECT item_id, n::BIGINT AS n, unnest(list_transform(range(1, len(t) - n + 2),
       lambda i: array_to_string(t[i:i + n - 1], ' '))) AS gram FROM t, n""",
    "prune_length_ratio": f"""
WITH {DIRTY}, {_clean_a('clean', 'dirty')}, counted AS ({_COUNTED} FROM clean)
SELECT * FROM counted WHERE {_ratio(0.5)}""",
    "drop_identical": f"""
WITH {PAIRS} SELECT pair_id, source, target FROM pairs WHERE conv_id % 4 <> 0 AND source <> target""",
    "min_words": f"WITH {PAIRS} SELECT pair_id, target FROM pairs WHERE {_count('target')} > 40",
    "clean_and_prune": f"""
WITH {DIRTY}, {_clean_a('clean', 'dirty')}, counted AS ({_COUNTED} FROM clean)
SELECT * FROM counted WHERE {_ratio(0.5)} AND source <> target""",
    "filter_pairs": f"""
WITH {DOCUMENT_PAIRS}, {_clean_a('clean', 'dp')},
counted AS (SELECT *, {_count('source')} AS src_len, {_count('target')} AS tgt_len FROM clean),
scored AS (
  SELECT c.*, (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2 AS sim
  FROM counted c JOIN embeddings a ON a.vec_id = c.source_id JOIN embeddings b ON b.vec_id = c.target_id
  WHERE {_ratio(0.5)} AND source <> target)
SELECT source_id, target_id, source, target, src_len, tgt_len, round(sim, 6) AS sem_sim
FROM scored WHERE sim > 0.55""",
    "positive_pairs": """
SELECT md5(text) AS source, lang AS target FROM labels JOIN documents USING (doc_id) WHERE quality = 1""",
    "expr_filter_map": f"""
WITH {PAIRS} SELECT pair_id, length(source)::BIGINT AS n, (length(source) * 2)::BIGINT AS twice,
  ';' || (length(source) * 2)::VARCHAR AS mark FROM pairs WHERE length(source) > 60 AND turn < 5""",
    "role_columns": f"WITH {PAIRS} SELECT source, target, pair_id, source AS prediction FROM pairs",
    "renamed_roles": f"WITH {PAIRS} SELECT source, target FROM pairs",
    "prefix_source": f"WITH {PAIRS} SELECT pair_id, 'paraphrase: ' || source AS source FROM pairs",
    "sample_n": f"WITH {_ranked('doc_id')} SELECT doc_id, text FROM ranked WHERE r <= 150",
    "sample_fraction": f"""
WITH {_ranked('doc_id')} SELECT doc_id, lang FROM ranked WHERE r <= round_even(0.33 * n, 0)""",
    "split_80_10_10": f"""
WITH {_ranked('doc_id')}, c AS (SELECT *, round_even(0.8 * n, 0) AS a FROM ranked)
SELECT doc_id, text, CASE WHEN r <= a THEN 'train' WHEN r <= a + round_even(0.5 * (n - a), 0)
  THEN 'validation' ELSE 'test' END AS split FROM c""",
    # 155 rows: 124 for training, half of the remaining 31 rounds to 16.
    "split_sampled": f"""
WITH {_ranked('doc_id')} SELECT doc_id, CASE WHEN r <= 124 THEN 'train' WHEN r <= 140
  THEN 'validation' ELSE 'test' END AS split FROM ranked WHERE r <= 155""",
    "split_remainder": f"""
WITH {_ranked('doc_id')} SELECT doc_id, text FROM ranked WHERE r > round_even(0.8 * n, 0)""",
    "first_n": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 170",
    "shuffle_order": f"WITH {_ranked('doc_id', seed=7)} SELECT doc_id, r AS rank FROM ranked",
    "shuffle_batches": f"""
WITH {_ranked('doc_id')} SELECT doc_id, (r - 1) // 64 AS batch_id, (r - 1) % 64 AS pos FROM ranked""",
    "key_batches": """
WITH k AS (SELECT conv_id * 4294967296 + turn AS pair_id,
                  row_number() OVER (ORDER BY conv_id, turn) - 1 AS r FROM conversations)
SELECT pair_id, r // 32 AS batch_id, r % 32 AS pos FROM k""",
    "sts_batches": f"""
WITH {PAIRS}, {_ranked('pair_id', table='pairs')}
SELECT pair_id, source, target, (r - 1) // 64 AS batch_id, (r - 1) % 64 AS pos FROM ranked""",
    "used_samples": """
SELECT 'capped' AS corpus, least(100, count(*))::BIGINT AS samples FROM documents
UNION ALL SELECT 'all', count(*) FROM documents""",
    "aligned_zip": f"""
WITH {_lines('u', 'user')}, {_lines('a', 'assistant')}
SELECT line_no, u.text AS source, a.text AS target FROM u JOIN a USING (line_no)
WHERE line_no < (SELECT max(line_no) FROM u) AND line_no < (SELECT max(line_no) FROM a)""",
    "aligned_sample_trim": f"""
WITH {_lines('u', 'user')}, {_lines('a', 'assistant')},
z AS (SELECT line_no, u.text AS source, a.text AS target FROM u JOIN a USING (line_no)
      WHERE line_no < (SELECT max(line_no) FROM u) AND line_no < (SELECT max(line_no) FROM a)),
{_ranked('line_no', table='z')}
SELECT line_no, source, target FROM ranked WHERE r <= 120 AND {_count('target')} > 40""",
    "drop_last": f"""
WITH {_lines('u', 'user')} SELECT * FROM u WHERE line_no < (SELECT max(line_no) FROM u)""",
    "attach_outputs": f"WITH {PREDICTED} SELECT pair_id, source, prediction FROM predicted",
    "missing_vectors": f"""
WITH {DOCUMENT_PAIRS}, ids AS (SELECT source_id AS vec_id FROM dp UNION ALL SELECT target_id FROM dp)
SELECT vec_id, count(*) AS uses FROM ids WHERE vec_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY vec_id""",
    "cluster_pairs": _neighbours(
        "source", "doc_id", "documents", 42,
        "x.doc_id AS source_id, y.doc_id AS target_id",
        "md5(x.text) AS source_md5, md5(y.text) AS target_md5",
    ),
    "split_with_ties": f"""
WITH {TURNS_WITH_GAPS}, r AS (SELECT conv_id, row_number() OVER (ORDER BY h, conv_id NULLS FIRST) AS k, count(*) OVER () AS total FROM t),
z AS (SELECT conv_id, k, least(77, total) AS n FROM r),
a AS (SELECT *, round_even(n * 0.8, 0) AS train FROM z),
b AS (SELECT *, train + round_even((n - train) * 0.5, 0) AS upto FROM a)
SELECT CASE WHEN k <= train THEN 'train' WHEN k <= upto THEN 'validation' ELSE 'test' END AS split, conv_id, count(*) AS n
FROM b WHERE k <= n GROUP BY 1, 2""",
    "first_n_with_ties": f"""
WITH {TURNS_WITH_GAPS}, r AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS LAST) AS k FROM t)
SELECT conv_id, count(*) AS n FROM r WHERE k <= 45 GROUP BY conv_id""",
    "shuffle_order_with_ties": f"""
WITH {TURNS_WITH_GAPS}, r AS (SELECT conv_id, row_number() OVER (ORDER BY h, conv_id NULLS FIRST) AS k FROM t)
SELECT conv_id, count(*) AS n, min(k) AS first, max(k) AS last FROM r GROUP BY conv_id""",
    "shuffled_rows": """
SELECT doc_id, md5(text) AS text_md5, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents""",
    "cluster_pairs_cut": _neighbours(
        "source", "doc_id", "documents", 42,
        "x.doc_id AS source_id, y.doc_id AS target_id",
        "md5(x.text) AS source_md5, md5(y.text) AS target_md5",
    ),
    "cluster_collect_cut": """
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)
SELECT source, k // 5 AS part, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids
FROM r GROUP BY source, k // 5""",
    "cluster_pairs_by_label": _neighbours(
        "label", "vec_id", "embeddings", 3, "x.label::BIGINT AS label",
        "x.vec_id AS source_id, y.vec_id AS target_id",
    ),
    "cluster_collect": """
SELECT source, 0::BIGINT AS part, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids,
       md5(string_agg(text, '|' ORDER BY doc_id)) AS texts FROM documents GROUP BY source""",
    "semantic_score": f"""
WITH {VECTOR_PAIRS}, c AS (SELECT pair_id, list_cosine_similarity(x, y) AS c FROM vp)
SELECT pair_id, round(c, 6) AS cosine, round((c + 1) / 2, 6) AS sem_sim, round(c, 6) AS paired FROM c""",
    "semantic_threshold": f"""
WITH {VECTOR_PAIRS}, c AS (SELECT pair_id, (list_cosine_similarity(x, y) + 1) / 2 AS c FROM vp)
SELECT pair_id, round(c, 6) AS sem_sim FROM c WHERE c > 0.55""",
    "mean_pool": """
WITH d AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings),
k AS (SELECT vec_id, i % 8 AS dim, v::DOUBLE AS v,
             CASE WHEN (i // 8 + vec_id) % 3 > 0 AND vec_id % 50 <> 0 THEN 1 ELSE 0 END AS m FROM d)
SELECT vec_id, dim, round(sum(v * m) / greatest(sum(m), 1e-9), 6) AS value FROM k GROUP BY vec_id, dim""",
    "sts_eval": f"""
WITH {VECTOR_PAIRS}, c AS (SELECT similarity / 5.0 AS g, list_cosine_similarity(x, y) AS c FROM vp)
SELECT round(corr(g, c), 6) AS pearson, round(avg((g - c) * (g - c)), 6) AS mse FROM c""",
    "bleu_corpus": f"WITH {PREDICTED}, {_bleu('b', 'predicted', 'prediction', 'target')} "
    "SELECT round(bleu, 6) AS bleu FROM b",
    "bleu_documents": f"""
WITH cut AS (SELECT text AS target, array_to_string(list_filter(string_split(text, ' '),
               lambda x, i: i % 5 <> 0), ' ') AS prediction FROM documents),
{_bleu('b', 'cut', 'prediction', 'target')} SELECT round(bleu, 6) AS bleu FROM b""",
    "self_bleu": f"WITH {PREDICTED}, {_bleu('s', 'predicted', 'prediction', 'source')} "
    "SELECT round(bleu, 6) AS self_bleu FROM s",
    "bleu_smoothed": f"""
WITH {PREDICTED}, st AS (SELECT {_strip('prediction')} AS prediction, {_strip('source')} AS source FROM predicted),
{_bleu('s', 'st', 'prediction', 'source')},
e AS (SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS misses FROM s_s)
SELECT round_even(CASE WHEN max(m) = 0 OR min(poss) = 0 THEN 0.0 ELSE
   (SELECT CASE WHEN c < r THEN exp(1 - r / c) ELSE 1.0 END FROM s_l)
   * exp(avg(ln(CASE WHEN m > 0 THEN 100 * m / poss ELSE 100 / (pow(2, misses) * poss) END))) END, 4) AS bleu
FROM e""",
    "generation_report": f"""
WITH {PAIRS},
joined AS (
  SELECT p.*, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS c,
         array_to_string(list_filter(string_split(target, ' '), lambda x, i: i % 5 <> 0), ' ') AS prediction
  FROM pairs p JOIN embeddings r ON r.vec_id = p.conv_id JOIN embeddings q ON q.vec_id = p.conv_id + 1),
{_bleu('b', 'joined', 'prediction', 'target')}, {_bleu('s', 'joined', 'prediction', 'source')},
v AS (SELECT b.bleu AS b, s.bleu AS s, (SELECT avg(c) FROM joined) AS c FROM b, s)
SELECT 'bleu' AS metric, round_even(b * 100, 3) AS value FROM v
UNION ALL SELECT 'self_bleu', round_even(s * 100, 3) FROM v
UNION ALL SELECT 'ibleu', round_even(round_even(0.7 * b - 0.3 * s, 3) * 100, 3) FROM v
UNION ALL SELECT 'sbert', round_even(c * 100, 3) FROM v""",
    "generation_lower_case": f"""
WITH {PREDICTED}, lo AS (SELECT lower(source) AS source, lower(target) AS target, prediction FROM predicted),
{_bleu('b', 'lo', 'prediction', 'target')}, {_bleu('s', 'lo', 'prediction', 'source')}
SELECT round(b.bleu, 6) AS bleu, round(s.bleu, 6) AS self_bleu,
       round_even(0.7 * b.bleu - 0.3 * s.bleu, 3) AS ibleu FROM b, s""",
    "gold_report": f"""
WITH {PREDICTED}, {_bleu('b', 'predicted', 'source', 'target')}
SELECT round(bleu, 6) AS bleu, 1.0::DOUBLE AS self_bleu, round_even(0.7 * bleu - 0.3, 3) AS ibleu FROM b""",
    "length_extremes": f"""
SELECT min(w) AS min, max(w) AS max FROM (SELECT {_count('text')} AS w FROM documents)""",
    "length_hist": f"""
WITH {PAIRS}, v AS (SELECT length(source)::BIGINT AS n FROM pairs),
b AS (SELECT unnest(range(min(n), max(n))) AS bin, max(n) AS hi FROM v)
SELECT bin, bin + 1 AS hi,
  (SELECT count(*) FROM v WHERE n = bin OR (bin = b.hi - 1 AND n = b.hi)) AS rows,
  round((SELECT count(*) FROM v WHERE n = bin OR (bin = b.hi - 1 AND n = b.hi))
        / (SELECT count(*) FROM v)::DOUBLE, 6) AS density
FROM b""",
    "score_hist": """
WITH g AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events),
e AS (SELECT i AS bin, lo + i * ((hi - lo) / 100) AS a,
             CASE WHEN i = 99 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 100) END AS z, n AS total
      FROM g, range(100) t(i)),
k AS (SELECT bin, count(*) AS n FROM events JOIN e ON value >= a AND (value < z OR (bin = 99 AND value <= z)) GROUP BY bin)
SELECT bin, round(a, 6) AS lo, round(z, 6) AS hi, round((a + z) * 0.5, 6) AS centre,
       coalesce(n, 0) AS n, round(coalesce(n, 0) / total::DOUBLE, 6) AS proportion
FROM e LEFT JOIN k USING (bin)""",
    "minmax_score": f"""
WITH {VECTOR_PAIRS}, c AS (SELECT pair_id, (list_cosine_similarity(x, y) + 1) / 2 AS c FROM vp)
SELECT pair_id, round(c, 6) AS sem_sim,
       round((c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()), 6) AS normalised FROM c""",
    "corpus_profile": f"""
WITH {DOCUMENT_PAIRS}, {PAIRS}, r AS (
  SELECT 'documents' AS corpus, {_count('source')} AS a, {_count('target')} AS b FROM dp
  UNION ALL SELECT 'conversations', {_count('source')}, {_count('target')} FROM pairs
  UNION ALL SELECT 'benchmark', {_count('text')}, {_count('upper(text)')} FROM benchmark)
SELECT corpus, round_even(avg(a), 3) AS src_len, round_even(avg(b), 3) AS tgt_len FROM r GROUP BY corpus""",
    "entailment_codes": """
WITH r AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'none' WHEN 'view' THEN 'entailment'
           WHEN 'signup' THEN 'paraphrase' WHEN 'error' THEN NULL ELSE 'odd' END AS l,
         CASE WHEN event_id % 3 > 0 THEN (event_id % 6)::DOUBLE END AS s FROM events)
SELECT event_id,
  CASE l WHEN 'none' THEN 0 WHEN 'entailment' THEN 1 WHEN 'paraphrase' THEN 2 WHEN 'odd' THEN 3 END::BIGINT AS code,
  CASE l WHEN 'none' THEN 0 WHEN 'entailment' THEN 1 WHEN 'paraphrase' THEN 2 ELSE 3 END::BIGINT AS forced,
  CASE WHEN l <> 'odd' THEN l END AS name,
  s / 5 AS similarity, coalesce(s, 0.0::DOUBLE) AS forced_similarity FROM r""",
    "labelled_pairs": f"""
WITH {PAIRS} SELECT pair_id::VARCHAR AS id, source AS t, NULL::VARCHAR AS h,
  CASE WHEN conv_id % 3 > 0 THEN 1::BIGINT END AS entailment,
  CASE WHEN turn % 4 > 0 THEN 2.5::DOUBLE END AS similarity
FROM pairs WHERE conv_id % 3 > 0 OR turn % 4 > 0""",
    "encode_arrays": """
WITH w AS (SELECT item_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids FROM benchmark),
p AS (SELECT item_id, ids, list_resize(ids[1:30], 30, 0) AS x, list_resize(ids[1:24], 24, 0) AS y FROM w)
SELECT item_id, array_to_string(x, ',') AS input_ids,
  array_to_string(list_transform(range(30), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ',') AS attention_mask,
  array_to_string(list_transform(y, lambda v: CASE WHEN v = 0 THEN -100 ELSE v END), ',') AS labels,
  array_to_string(y, ',') AS unmasked,
  len(list_filter(x, lambda v: v <> 0))::BIGINT AS n_tokens FROM p""",
    "gen_len": """
SELECT round_even(avg(len(list_filter(string_split(text, ' '), lambda x: length(x) > 0))), 4) AS gen_len
FROM benchmark""",
    "infer_predictions": f"""
WITH {PAIRS} SELECT pair_id, source, target, (length(source) + 5)::VARCHAR || ' characters' AS prediction FROM pairs""",
    "infer_similarity": f"""
WITH {PAIRS}, c AS (SELECT pair_id,
  list_transform(['a', 'e', 'i', 'o', 'n'], lambda c: (length(source) - length(replace(source, c, '')))::DOUBLE) AS x,
  list_transform(['a', 'e', 'i', 'o', 'n'], lambda c: (length(target) - length(replace(target, c, '')))::DOUBLE) AS y
  FROM pairs)
SELECT pair_id, round((list_cosine_similarity(x, y) + 1) / 2, 6) AS sem_sim FROM c""",
    "translate_pairs": f"WITH {PAIRS} SELECT pair_id, replace(source, 'e', 'E') AS source, target FROM pairs",
    "xml_pairs": f"""
WITH {PAIRS} SELECT pair_id::VARCHAR AS id, translate(source, chr(10), ' ') AS t,
  translate(target, chr(10), ' ') AS h, (conv_id % 4)::BIGINT AS entailment,
  (turn % 6)::DOUBLE AS similarity FROM pairs""",
    "jsonl_roundtrip": f"WITH {DIRTY} SELECT source, target FROM dirty",
    "predictions_roundtrip": f"WITH {PREDICTED} SELECT source, target, prediction FROM predicted",
    "lines_roundtrip": f"""
WITH {PAIRS} SELECT row_number() OVER (ORDER BY pair_id) - 1 AS line_no,
  {_strip("translate(source, chr(10), ' ')")} AS text FROM pairs""",
    "splits_roundtrip": f"""
WITH {PAIRS}, {_ranked('pair_id', table='pairs')}, c AS (SELECT *, round_even(0.8 * n, 0) AS a FROM ranked)
SELECT pair_id, source, target, CASE WHEN r <= a THEN 'train' WHEN r <= a + round_even(0.5 * (n - a), 0)
  THEN 'validation' ELSE 'test' END AS split FROM c""",
    "named_split": f"""
WITH {PAIRS}, {_ranked('pair_id', table='pairs')}, c AS (SELECT *, round_even(0.8 * n, 0) AS a FROM ranked)
SELECT pair_id, source FROM c WHERE r > a AND r <= a + round_even(0.5 * (n - a), 0)""",
    "load_prepared": f"""
WITH {DIRTY}, o AS (SELECT *, row_number() OVER (ORDER BY pair_id) AS r FROM dirty),
c AS (SELECT pair_id, r, {_clean_b('source')} AS source, {_clean_b('target')} AS target FROM o)
SELECT pair_id, source, target, length(target)::BIGINT AS n, s.split FROM c
JOIN (SELECT 'train' AS split, 60 AS k UNION ALL SELECT 'test', 10) s ON r <= k
WHERE length(source) > 40""",
    "generate_job": rf"""
WITH {DIRTY}, o AS (SELECT *, row_number() OVER (ORDER BY pair_id) AS r FROM dirty),
bare AS (SELECT conv_id, regexp_replace(source, '\p{{C}}', '', 'g') AS source,
                regexp_replace(target, '\p{{C}}', '', 'g') AS target FROM o WHERE r <= 120),
c AS (SELECT 'q: ' || {_clean_b('source')} AS source, {_clean_b('target')} AS target FROM bare WHERE conv_id % 3 > 0)
SELECT source, target, {_strip("replace(source, 'e', 'E')")} AS prediction FROM c""",
    "score_job": f"""
WITH {PREDICTED}, {_bleu('b', 'predicted', 'prediction', 'target')}, {_bleu('s', 'predicted', 'prediction', 'source')},
k AS (SELECT
  list_transform(['e', 't', 'a', 'o', 'i', 'n'], lambda c: (length(prediction) - length(replace(prediction, c, '')))::DOUBLE) AS x,
  list_transform(['e', 't', 'a', 'o', 'i', 'n'], lambda c: (length(target) - length(replace(target, c, '')))::DOUBLE) AS y
  FROM predicted),
v AS (SELECT b.bleu AS b, s.bleu AS s, (SELECT avg(list_cosine_similarity(x, y)) FROM k) AS c FROM b, s)
SELECT 'bleu' AS metric, round_even(b * 100, 3) AS value FROM v
UNION ALL SELECT 'self_bleu', round_even(s * 100, 3) FROM v
UNION ALL SELECT 'ibleu', round_even(round_even(0.7 * b - 0.3 * s, 3) * 100, 3) FROM v
UNION ALL SELECT 'sbert', round_even(c * 100, 3) FROM v""",
    "skip_existing": f"WITH {PAIRS} SELECT pair_id, source FROM pairs",
    "whole_output": f"WITH {PAIRS} SELECT pair_id, source FROM pairs",
    "rejected_rows": f"""
WITH {PAIRS}, r AS (
  SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'no JSON of this form' WHEN conv_id % 5 = 1 OR target IS NULL THEN 'no target'
    WHEN turn % 8 >= 6 THEN 'odd turn' END AS reason FROM pairs)
SELECT CASE WHEN conv_id % 5 <> 0 THEN pair_id END AS pair_id, CASE WHEN conv_id % 5 <> 0 THEN source END AS source,
  CASE WHEN conv_id % 5 > 1 THEN target END AS target, reason,
  CASE WHEN conv_id % 5 = 0 THEN '{{"pair_id": ' || pair_id END AS broken FROM r""",
    "filter_counts": f"""
WITH {DOCUMENT_PAIRS}, {_clean_a('clean', 'dp')},
counted AS (SELECT *, {_count('source')} AS src_len, {_count('target')} AS tgt_len FROM clean WHERE source <> target),
near AS (SELECT * FROM counted WHERE {_ratio(0.5)}),
scored AS (
  SELECT (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2 AS sim
  FROM near JOIN embeddings a ON a.vec_id = source_id JOIN embeddings b ON b.vec_id = target_id)
SELECT 'in' AS step, count(*) AS rows FROM dp UNION ALL SELECT 'not_identical', count(*) FROM counted
UNION ALL SELECT 'length_ratio', count(*) FROM near UNION ALL SELECT 'scored', count(*) FROM scored
UNION ALL SELECT 'out', count(*) FROM scored WHERE sim > 0.55""",
    "padded_batches": """
WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x))[1:512] AS ids FROM documents),
c AS (SELECT *, greatest(8, 8 * ((len(ids) + 7) // 8))::BIGINT AS width FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY width ORDER BY doc_id) - 1 AS k, greatest(1, 4096 // width) AS room FROM c),
b AS (SELECT width, max(k // room) + 1 AS n FROM r GROUP BY width),
o AS (SELECT width, coalesce(sum(n) OVER (ORDER BY width ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b)
SELECT doc_id, before + k // room AS batch_id, k % room AS pos, width,
  md5(array_to_string(list_resize(ids, width, 0), ',')) AS ids_md5, len(ids)::BIGINT AS n_ids FROM r JOIN o USING (width)""",
    "epoch_batches": f"""
WITH RECURSIVE total AS (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM documents),
size AS (SELECT n, a, (n + a - 1) // a AS b FROM total),
keys(epoch, {', '.join(f'f{i}, s{i}' for i in range(6))}) AS (VALUES {_epoch_keys(10)}),
walk AS (
  SELECT doc_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY doc_id) - 1 AS x, 0 AS step FROM documents, keys
  UNION ALL
  SELECT doc_id, epoch, y, step + 1 FROM (
    SELECT doc_id, epoch, step, b, x // b AS l0, x % b AS r0,
      (l0 + (r0 * f0 + s0) % 2147483647) % a AS l1, (r0 + (l1 * f1 + s1) % 2147483647) % b AS r1,
      (l1 + (r1 * f2 + s2) % 2147483647) % a AS l2, (r1 + (l2 * f3 + s3) % 2147483647) % b AS r2,
      (l2 + (r2 * f4 + s4) % 2147483647) % a AS l3, (r2 + (l3 * f5 + s5) % 2147483647) % b AS r3, l3 * b + r3 AS y
    FROM walk JOIN keys USING (epoch), size WHERE step = 0 OR x >= n))
SELECT doc_id, epoch, x // 64 AS batch_id, x % 64 AS pos FROM walk, size WHERE step > 0 AND x < n""",
    "stream_clean_pairs": f"""
WITH {DIRTY}, {_clean_a('clean', 'dirty')}, counted AS ({_COUNTED} FROM clean)
SELECT * FROM counted WHERE {_ratio(0.5)} AND source <> target""",
}
