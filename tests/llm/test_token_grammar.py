"""Token ids in shards compressed by a grammar."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairforge.llm import token_grammar as G
from pairforge.llm.word_ids import WordIds, word_ids
from pairforge.runtime import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def unpacked(ids):
    first, rules, symbols = G.compress(ids)
    lengths = G.rule_lengths(first, rules)
    return first, rules, symbols, lengths, G.expand(symbols, first, rules, lengths)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=600), st.integers(1, 6), st.integers(0, 70_000))
def test_what_is_compressed_expands_to_itself(ids, times, offset):
    ids = np.array(ids * times, np.uint32) + np.uint32(offset)
    first, rules, symbols, lengths, back = unpacked(ids)
    assert back.dtype == np.uint32 and (back == ids).all()
    assert (rules < first + np.arange(len(rules))[:, None]).all()  # a rule uses older symbols only
    for start, stop in ((0, len(ids)), (3, 17), (len(ids) // 2, len(ids) + 9), (5, 5)):
        part = G.expand_range(symbols, first, rules, lengths, start, stop)
        assert (part == ids[start:stop]).all()


def test_repeats_shrink():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 49_408, 50)
    ids = np.concatenate([phrase if rng.random() < 0.8 else rng.integers(0, 49_408, 50) for _ in range(4000)]).astype(np.uint32)
    first, rules, symbols, _, back = unpacked(ids)
    assert (back == ids).all() and symbols.dtype == np.uint16
    assert len(symbols) + 3 * len(rules) < 0.45 * len(ids)
    first, rules, symbols, _, back = unpacked(np.zeros(100_000, np.uint32))
    assert len(symbols) < 100_000 / 14 and not back.any()
    wide = np.array([1 << 31, 7] * 5000, np.uint32)
    assert (unpacked(wide)[-1] == wide).all()


@given(st.binary(max_size=60), st.binary(max_size=60))
def test_checksums_of_parts_add_up(a, b):
    assert zlib.crc32(a + b) == G.crc_before(zlib.crc32(a), len(b)) ^ zlib.crc32(b)


ODD = ["a\x0bb\x0cc\x1cd\x85e\xa0f g\u3000h é it's THEY'LL 's <|endoftext|> <|ENDOFTEXT|> x", "a!?!, b--- É, É's, —, a—, 3, (a) 'a,", "İ ΑΣ ΑΣ' ́a ́", "\ufeffa"]


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyzABZéßİΣ 0129'.,!-—<|>\t\n\x0b\x1c\x85\xa0\u0301", max_size=60))
def test_words_are_encoded_like_texts(text):
    encoder = word_ids(PATH)
    assert encoder.apart
    assert encoder.encode(text.encode()) == encoder.whole(text)


def test_words_of_the_tables_are_encoded_like_texts(spark):
    encoder = word_ids(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text]
    for text in texts + ODD:
        assert encoder.encode(text.encode()) == encoder.whole(text)


def test_other_vocabularies_are_used_on_whole_texts():
    encoder = word_ids(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encoder.apart
    for text in ODD:
        assert encoder.encode(text.encode()) == encoder.whole(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="abcxyzABZéÉßñÿ÷×ªİΣσς 0129'.,!-—<|>\t\n\x0b\x1c\x85\xa0\u0301", max_size=40), max_size=8))
def test_columns_are_encoded_like_texts(texts):
    encoder = WordIds(PATH, cached=5) if len(texts) % 2 else word_ids(PATH)
    got = encoder.encode_all(pa.array(texts, pa.string()))
    assert [g.tobytes() for g in got] == [encoder.whole(t or "") for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_columns_are_encoded_like_texts(name):
    encoder = WordIds(public_tokenizers.path(name))
    for texts in (ODD, [None, *ODD, "", " "], ["", None], [], ["x" * 100 + "é" * 100 + ", " + "12.5 3-4, é). ñ|"] * 3):
        column = pa.array(["cut off", *texts], pa.string())[1:]
        for _ in range(2):
            assert [g.tobytes() for g in encoder.encode_all(column)] == [encoder.whole(t or "") for t in texts]


def test_a_column_looks_a_word_up_once_whatever_follows_it(monkeypatch):
    encoder = WordIds(PATH, cached=4)
    words = ["zuenöüclich", "entäßtè", "ñracoue", "erlyblest"]
    texts = [" ".join([w + marks for w in words]) for marks in ("", ",", ".", "!!", ")", "$$$") * 9]
    want = [encoder.whole(t) for t in texts]
    calls = []
    monkeypatch.setattr(WordIds, "whole", lambda self, text, whole=WordIds.whole: calls.append(text) or whole(self, text))
    assert [g.tobytes() for g in encoder.encode_all(pa.array(texts))] == want
    assert not [c for c in calls if c[0].isalpha()]  # letters go to the model alone
    assert len(calls) <= 5 * len(words)


def plain(rows):
    """Every document's ids in the order of the file set."""
    tokenizer = Tokenizer.from_file(PATH)
    return [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]


@pytest.mark.parametrize("shard_tokens", [64, 1 << 20])
def test_files_give_back_what_the_tokenizer_gives(spark, documents, shard_tokens):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["The,", "thing", "über.", "12", "x's"]) for _ in range(rng.randrange(120)))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "x" * 20_000), (904, "a b " * 4_000), (-5, "<|endoftext|> <|ENDOFTEXT|> x")]
    rng.shuffle(rows)
    folder = fresh_path(spark, "tokens")
    G.write_tokens(documents(rows, parts=4), PATH, folder, shard_tokens)
    want, start = {}, 0
    everything = []
    for i, ids in plain(sorted(rows)):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        everything += ids
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in G.digests(spark, folder).collect()}
    assert got == want
    pieces = G.read_pieces(spark, folder).collect()
    joined = b"".join(p.ids for p in sorted(pieces, key=lambda p: (p.start, p.offset)))
    assert joined == np.array(everything, "<u4").tobytes()
    assert max(p.length for p in pieces) <= shard_tokens
    for a, b in ((0, 10), (700, 1500), (start - 5, start + 5), (start, start + 1)):
        found = sorted(G.read_range(spark, folder, a, b).collect(), key=lambda r: r.start)
        assert b"".join(r.ids for r in found) == np.array(everything[a:b], "<u4").tobytes()


def test_equal_and_null_ids_and_repeated_rows(spark, documents):
    rows = [(7, "one two")] * 40 + [(7, "another text")] * 3 + [(None, "no id"), (None, None), (3, "before")]
    folder = fresh_path(spark, "tokens")
    G.write_tokens(documents(rows, parts=5), PATH, folder)
    got = sorted(G.digests(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 2 + [3] + [7] * 43
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    of = {t: zlib.crc32(np.array(ids, "<u4").tobytes()) for t, (_, ids) in zip([t for _, t in rows], plain(rows), strict=True)}
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == sorted((i or -1, of[t]) for i, t in rows)


def test_empty_table(spark, documents):
    folder = fresh_path(spark, "tokens")
    G.write_tokens(documents([]), PATH, folder)
    assert G.digests(spark, folder).collect() == [] and G.read_range(spark, folder, 0, 9).collect() == []


def _repeated(symbols):
    """Pairs that occur twice without overlap."""
    seen, last = {}, {}
    for i, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)):
        if last.get(pair, -2) + 1 < i:
            seen[pair] = seen.get(pair, 0) + 1
            last[pair] = i
    return {p for p, n in seen.items() if n > 1}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=500), st.sampled_from([0, 65_000, 65_530, 70_000]))
def test_no_pair_is_left_that_occurs_twice(ids, offset):
    _, rules, symbols, _, back = unpacked(np.array(ids, np.uint32) + np.uint32(offset))
    assert (back == np.array(ids) + offset).all() and not _repeated(symbols)
    assert len(np.unique(rules, axis=0)) == len(rules)


def test_numbers_beyond_two_bytes_do_not_end_the_grammar():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.2, 400_000), 49_408).astype(np.uint32)
    first, rules, symbols, _, back = unpacked(ids)
    assert (back == ids).all() and not _repeated(symbols)
    assert first + len(rules) > 1 << 16 and symbols.dtype == np.uint32


def test_a_round_numbers_more_pairs_than_two_bytes_hold():
    ids = np.repeat(np.random.default_rng(4).integers(0, 65_500, (1, 40_000)), 2, axis=0).ravel().astype(np.uint16)
    symbols, _, pairs = G._round(ids, np.arange(len(ids) - 1), 2, 65_500)
    assert symbols.dtype == np.uint32 and len(pairs) > 36
    lengths = G.rule_lengths(65_500, pairs)
    assert (G.expand(symbols, 65_500, pairs, lengths) == ids).all()


def test_lone_pairs_do_not_stay_open(monkeypatch):
    rng = np.random.default_rng(6)
    ids = np.minimum(rng.zipf(1.3, 200_000) + rng.integers(0, 3000, 200_000), 49_408).astype(np.uint32)
    left = []
    rounds = G._round

    def watched(symbols, open_, *more):
        left.append(len(open_) / len(symbols))
        return rounds(symbols, open_, *more)

    monkeypatch.setattr(G, "_round", watched)
    _, _, symbols, _, back = unpacked(ids)
    assert (back == ids).all() and not _repeated(symbols)
    assert left[-1] < 0.05
