"""Toxicity, language, quality, personal data, packing, decontamination, archives."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairforge.llm import decontaminate, language, packing, pii, quality, toxicity, warc
from pairforge.runtime import fresh_path

ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "x" * 200_000), (904, "a b " * 40_000), (904, "a b " * 40_000), (None, "null id")]

# --- personal data ---------------------------------------------------------------

_PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in _PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 12 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda s: (s[0], list(_PLAIN).index(s[1])))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab0123.@-+ ()é%\n٣", max_size=50))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4396177793418310", "4396 1777-9341 8310", "+1 (386) 555-3733", "1.2.3.4.5.6.7.8", "300.1.1.1", "a@b.c@d.e@f.g", "x@y", "@a.b", "00255.0.0.1", " ", ",", "9", "+", "é"]), max_size=8))
def test_base_spans_of_joined_parts(parts):
    assert pii.base_spans("".join(parts)) == plain_base("".join(parts))


@pytest.fixture(scope="module")
def crf():
    return pii.train(pii.training_table())


def test_the_tagger_finds_spans_of_unseen_values(crf):
    table = pii.training_table(seed=77, copies=3)
    right = sum(
        [s for s in pii.spans_of([text], crf)[0][1] if s[1] in ("secret", "id")] == spans for text, spans in table
    )
    assert right >= 0.97 * len(table)


def test_viterbi_finds_the_best_path(crf):
    rng = np.random.default_rng(0)
    sequences = [rng.standard_normal((n, len(pii.TAGS))) * 3 for n in (1, 2, 4, 5, 1, 6)]
    for scores, path in zip(sequences, crf.decode(sequences), strict=True):
        def total(p, scores=scores):
            return sum(scores[t, k] for t, k in enumerate(p)) + sum(crf.move[a, b] for a, b in zip(p, p[1:], strict=False))

        paths = np.array(np.meshgrid(*[range(len(pii.TAGS))] * len(scores))).reshape(len(scores), -1).T
        assert total(path.tolist()) == pytest.approx(max(total(p) for p in paths.tolist()))


def test_detection_over_documents(documents, crf):
    rows = [(1, "mail a.b@c.de or 10.0.0.1\nkey é +1 (386) 555-3733"), (2, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (3, "nothing here")]
    got = {(r.doc_id, r.text): r for r in pii.detect(documents(rows + ODD), crf).collect()}
    assert len(got) == len(rows) + len(ODD) - 1  # one row is there twice
    for (_, text), r in got.items():
        own = plain_base(text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in own) for k in pii.BASE_KINDS]
        joined = ",".join(f"{k}:{s}:{e}" for s, k, e in own)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert {*joined.split(",")} <= {*r.spans.split(","), ""}
    assert got[2, rows[1][1]].spans == "secret:9:49"
    assert pii.detect(documents([]), crf).collect() == []


def test_redaction(documents, crf):
    rows = [(1, "mail a.b@c.de now"), (2, "clean text")]
    got = {r.doc_id: r for r in pii.redacted(documents(rows + ODD), crf).collect()}
    assert (got[1].text, got[1].n_chars) == ("mail <EMAIL> now", 16)
    assert (got[2].text, got[2].n_chars) == ("clean text", 10)
    assert got[900].text is None and got[901].text == ""
    assert pii.redact("0123456789", [(1, "ip", 4), (3, "card", 6), (8, "id", 9)]) == "0<IP>67<ID>9"


# --- packing ---------------------------------------------------------------------


def test_cuts_are_powers_of_two_without_a_gap():
    for n in [*range(1, 70), 2047, 2048, 2049, 4095, 5000]:
        pieces = list(packing.cuts(n))
        assert [s for s, _ in pieces] == [sum(k for _, k in pieces[:i]) for i in range(len(pieces))]
        assert sum(k for _, k in pieces) == n and all(k & (k - 1) == 0 and k <= 2048 for _, k in pieces)


def test_pieces_join_to_the_ids_of_the_tokenizer(documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(3)
    odd = ["a\x0bb\x0cc\x1cd\x85e\xa0f g　h é it's THEY'LL 's <|endoftext|> <|ENDOFTEXT|> x", "a!?!, b--- É, É's, —, a—, 3, (a) 'a,", "İ ΑΣ ΑΣ' ́a ́", "﻿a"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(50 + i, " ".join(rng.choice(["The,", "thing", "über.", "12", "x's"]) for _ in range(900 * i))) for i in range(4)]
    rows += [r for r in ODD if r[0] != 904]
    pieces = packing.pack(documents(rows), path).collect()
    tokenizer = Tokenizer.from_file(path)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for doc_id, text in rows:
        mine = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(p.ids for p in mine), "<u4").tolist() == want
        assert {p.doc_tokens for p in mine} == {len(want)} and all(p.offset == 0 for p in mine)
        assert all(p.length & (p.length - 1) == 0 and p.length * 4 == len(p.ids) for p in mine)
    assert packing.pack(documents([]), path).collect() == []
    with pytest.raises(ValueError):
        packing.pack(documents([]), path, longest=1000)


def test_buckets_count_sequences(documents):
    pieces = packing.pack(documents([(1, "a b c"), (2, "a")]), public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r.length, r.sequences, r.tokens) for r in packing.buckets(pieces).collect()) == [(2, 1, 2), (4, 1, 4)]


# --- decontamination -------------------------------------------------------------


def plain_hits(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item_id, passage in items:
            v = words(passage)
            size = min(13, len(v))
            for window in {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else ():
                for i in range(len(w) - size + 1):
                    if tuple(w[i : i + size]) == window:
                        hit |= set(range(i, i + size))
                        names |= {item_id} - {None}
        out.append((doc_id, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_hits_equal_the_plain_rule(spark, documents, block_words):
    rng = random.Random(2)
    vocabulary = ["the", "of", "a", "über", "x1", *(f"w{i}" for i in range(30))]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(i, text(rng.randrange(5, 40))) for i in range(8)]
    items += [(20, items[0][1]), (21, "short one"), (22, ""), (23, None), (None, text(20)), (24, "the the the the the the the the the the the the the the")]
    docs = [(i, text(60)) for i in range(20)]
    docs += [(30 + i, text(30) + " " + passage.upper() + ", " + text(10)) for i, (_, passage) in enumerate(items) if passage]
    docs += [(60, "the " * 50), (61, "A short, one. THE"), (62, items[0][1][: len(items[0][1]) // 2]), *ODD[:3], ODD[-1]]
    table = spark.createDataFrame([(*i, 1, "q") for i in items], "item_id long, text string, row long, term string")
    found = decontaminate.find(documents(docs), table, block_words=block_words).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in found), key=str)
    assert got == plain_hits(docs, items)
    assert any(r.n_hit for r in found)


def test_decontamination_of_empty_tables_and_repeated_rows(spark, documents):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.find(documents([(1, "a b"), (1, "a b")]), empty).collect()] == [0, 0]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.find(documents([]), some).collect() == []
    assert [r.n_hit for r in decontaminate.find(documents([(1, "a b"), (1, "a b")]), some).collect()] == [2, 2]


def test_proximity_finds_words_in_any_order(spark, documents):
    docs = documents([(1, "red green blue"), (2, "blue x red y green"), (3, "red green")])
    queries = decontaminate.Queries.of([{"text": "red green blue", "item_id": 1}], 13)
    filed = decontaminate._filed(queries, decontaminate.term_counts(docs, queries.terms))
    marked = np.zeros(len(queries.terms), bool)
    marked[filed[0][1]] = True
    index = decontaminate.build_index(docs, queries.terms, marked)
    windows = spark.createDataFrame(filed, decontaminate.WINDOWS)
    assert {r.doc_id for r in decontaminate.phrase_matches(index, windows).collect()} == {1}
    assert {r.doc_id for r in decontaminate.proximity_matches(index, windows).collect()} == {1, 2}


# --- classifiers -----------------------------------------------------------------


def vocabulary_text(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_lexicon_hits():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "lowei*": 1.0, "clown": 1.5})
    def hit(text):
        folded = toxicity.fold(text)
        return [folded[a:b] for a, b, _ in lexicon.hits(folded)]

    assert hit("You IDIOT!") == ["idiot"]
    assert hit("1d10t, ıdiot idi­ot іdiоt ídïot") == ["idiot", "idiot", "idiot", "idiot"]
    assert hit("idiots unidiot") == []
    assert hit("loweichen xlowei") == ["lowei"]
    assert hit("a clown fish, a clown") == ["clown"]
    assert lexicon.features(None) == lexicon.features("") == (0.0, 0.0)
    assert toxicity.Lexicon({}).hits("x") == []


def test_toxicity_learns_from_labels(spark, documents):
    rng = random.Random(1)
    plain = [f"word{chr(97 + i)}{chr(97 + i // 5)}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = vocabulary_text(rng, 60, plain)
        rows.append((i, text + (" nastyone " + rng.choice(["vileish", "vilemost"]) if toxic else "")))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (1, None), (399, 7)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = documents(rows + ODD)
    lexicon = toxicity.fit(docs, toxicity.learned_from(table))
    assert "nastyone" in lexicon.weights
    got = toxicity.score(docs, lexicon).collect()
    assert len(got) == len(rows) + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels[:400])
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.98
    kept = toxicity.score(docs, lexicon, keep_below=0.5)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in got)
    nothing = toxicity.fit(docs, table.filter("toxic = 0"))
    assert not nothing.weights and toxicity.score(documents([]), nothing).collect() == []


def test_language_learns_and_says_when_there_is_no_letter(documents):
    rng = random.Random(5)
    words = {"aa": ["thing", "the", "ing", "ether"], "bb": ["über", "schön", "ein", "keit"], "cc": ["ción", "que", "los", "rra"]}
    rows, langs = [], {}
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, vocabulary_text(rng, 30, words[lang])))
        langs[i] = lang
    docs = documents(rows + ODD + [(950, "123 !!")], langs)
    model = language.fit(docs)
    assert model.languages == ["aa", "bb", "cc"] and (model.weights == 0).mean() > 0.5
    got = language.predict(docs, model).collect()
    assert all(r.lang_pred == langs[r.doc_id] for r in got if r.doc_id in langs)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902, 950)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got) and len(got) == docs.count()
    nothing = language.fit(documents([(1, "abc")]))
    assert [r.lang_pred for r in language.predict(documents([(1, "abc")]), nothing).collect()] == ["und"]
    assert language.predict(documents([]), model).collect() == []


def test_temperature_lowers_the_loss_of_overconfident_margins():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    margins = np.where(rng.random((500, 1)) < 0.8, np.eye(2)[y], 1 - np.eye(2)[y]) * 10
    assert language._temperature(margins, y) > 2


def test_quality_learns_from_bags(spark, documents):
    rng = random.Random(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        lines = [vocabulary_text(rng, 20, words) for _ in range(4)]
        if bad:  # one telling passage among good ones
            lines[rng.randrange(4)] = vocabulary_text(rng, 20, words).upper().replace(" ", "!! ")
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad)))
    table = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, quality int")
    docs = documents(rows + ODD)
    model = quality.fit(docs, table)
    got = quality.score(docs, model).collect()
    truth = dict(labels)
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got) and len(got) == docs.count()
    # The attention points at the telling passage.
    bag = quality.describe("\n".join([*rows[1][1].split("\n")[:3], "ONE!! TWO!! THREE!! FOUR!!"]))
    x = (bag - model.mean) / model.scale
    assert model.attend(x, np.array([0]))["a"].argmax() == 3
    one = quality.fit(docs, table.filter("quality = 1"))
    assert [r.score for r in quality.score(documents([(1, "a")]), one).collect()] == [1.0]
    assert quality.score(documents([]), model).collect() == []


def test_a_long_document_does_not_end_the_sample(spark, documents, monkeypatch):
    """Bags beyond the bound are thinned out or left out; later ones are still learned from."""
    rng = random.Random(7)
    monkeypatch.setattr(quality, "SAMPLE_OF_ONE", 6)
    monkeypatch.setattr(quality, "SAMPLE_PASSAGES", 120)
    rows = [(i, "\n".join(("LOUD!! " if i % 2 else "calm words here ") * 20 for _ in range(rng.choice([1, 2, 90])))) for i in range(60)]
    table = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = documents(rows)
    got = quality.score(docs, quality.fit(docs, table)).collect()
    assert len({round(r.score, 6) for r in got}) > 1
    assert np.mean([(r.score >= 0.5) == r.doc_id % 2 for r in got]) > 0.95


def test_attention_equals_the_formula_over_padded_bags():
    rng = np.random.default_rng(3)
    bags = [rng.standard_normal((n, quality.WIDTH)).astype(np.float32) for n in (1, 4, 7)]
    model = quality.train(bags, np.array([1.0, 0.0, 1.0]), epochs=5)
    p, most = model.p, max(map(len, bags))
    x = np.zeros((len(bags), most, quality.WIDTH))
    real = np.zeros((len(bags), most), bool)
    for i, bag in enumerate(bags):
        x[i, : len(bag)], real[i, : len(bag)] = (bag - model.mean) / model.scale, True
    h = np.maximum(x @ p["E"] + p["e"], 0)
    gated = np.tanh(h @ p["V"] + p["v"]) / (1 + np.exp(-(h @ p["U"] + p["u"])))
    weight = np.where(real, np.exp(gated @ p["w"]), 0)
    weight /= weight.sum(axis=1, keepdims=True)
    bag = (weight[:, :, None] * h).sum(axis=1)
    assert np.allclose(model.scores(bags), 1 / (1 + np.exp(-(bag @ p["c"] + p["b"]))), atol=1e-9)


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(2)
    bags = [rng.standard_normal((n, quality.WIDTH)).astype(np.float32) for n in (1, 3, 5, 2)]
    y = np.array([0.0, 1.0, 1.0, 0.0])
    model = quality.train(bags, y, epochs=150, rate=1e-2)
    assert np.abs(model.scores(bags) - y).max() < 0.1


# --- archives --------------------------------------------------------------------


@given(st.binary(max_size=200), st.integers(1, 20))
@settings(max_examples=300, deadline=None)
def test_chunks_cover_a_payload(payload, size):
    spans = list(warc.chunk_spans(payload, size))
    assert [s for s, _ in spans] == [0, *[e for _, e in spans[:-1]]] and spans[-1][1] == len(payload)


def test_chunks_end_between_characters_and_inside_marks():
    payload = ("é€😀" * 50 + warc.MARK * 3).encode()
    for size in (4, 7, 64):
        parts = [payload[a:b] for a, b in warc.chunk_spans(payload, size)]
        assert all(len(p) <= max(size, 4) and warc.MARK.encode() not in p for p in parts)
        assert "".join(p.decode() for p in parts) == payload.decode()


@pytest.mark.parametrize("size", [warc.CHUNK_BYTES, 97])
def test_archives_round_trip(spark, size):
    big, mark = "<p>é€</p>\r\n\r\n" * 200, "a" * 1200 + warc.MARK + "WARC-Type: x\r\n\r\n" + warc.MARK
    pages = [
        (1, "http://a/ö?q=\r\nX: y", big), (2, None, big), (3, "u", big), (3, "u", big), (4, "u", mark), (5, "u", mark),
        (6, "u", "small"), (7, "u", "small"), (8, "u", None), (9, "u", ""), (10, "u", "y" * 300_000), (None, "u", big), (None, "u", "n" * 2000),
    ]
    table = spark.createDataFrame([(*p, 1, "z") for p in pages], "page_id long, url string, html string, chunk int, type string")
    path = fresh_path(spark, "warc")
    warc.write_archives(table.repartition(3), path, size)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(warc.read_records(spark, path)).collect())
    kept = {big: 3, mark: 5}
    want = []
    for page, _, html in pages:
        raw = (html or "").encode()
        revisit = html in kept and page != kept[html]
        want.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", kept[html] if revisit else None))
    assert got == sorted(want, key=str) or sorted(map(str, got)) == sorted(map(str, want))
    chunks = warc.read_chunks(spark, path).collect()
    assert all(len(c.payload) <= max(size, 4) for c in chunks)
    by_page = {}
    for c in sorted(chunks, key=lambda c: c.chunk):
        by_page.setdefault(c.record, b"")
        by_page[c.record] += c.payload
    assert ("y" * 300_000).encode() in by_page.values()


def test_archives_of_no_pages(spark):
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolved(warc.read_records(spark, path)).collect() == []


def test_crc_of_ids_is_unsigned(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.crc32(F.lit(b"\x01\x00\x00\x00").cast("binary"))).first()[0] == zlib.crc32(b"\x01\x00\x00\x00")
