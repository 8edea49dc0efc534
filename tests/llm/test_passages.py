"""Repeated passages against a plain rule over all runs of words of all texts."""

import random
import re

import numpy as np
import pytest

from pairforge import runtime
from pairforge.llm import substrings


def words(rng, n, kinds=3000):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def units_of(text, least):
    """Char spans of all words; (normalised words, first word) of every run and shorter line."""
    at = [m.span() for m in re.finditer(r"\S+", text)]
    w = [text[s:e].lower() for s, e in at]
    out, i = [(tuple(w[i : i + least]), i) for i in range(len(w) - least + 1)], 0
    for line in text.split("\n"):
        n = len(line.split())
        if 0 < n < least:
            out.append((tuple(w[i : i + n]), i))
        i += n
    return at, out


def plain(rows, least=substrings.LEAST_WORDS):
    """Spans (doc_id, start, end, n_words) of repeated runs, for unique ids."""
    first, out = {}, set()
    for i, text in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        at, runs = units_of(text, least)
        marks = set()
        for unit, word in runs:
            j, begin = first.setdefault(unit, (i, word))
            if (j, begin) != (i, word):
                marks |= set(range(max(word, begin + len(unit)) if i == j else word, word + len(unit)))
        for word in sorted(marks):
            if word - 1 not in marks:
                stop = word
                while stop in marks:
                    stop += 1
                out.add((i, at[word][0], at[stop - 1][1], stop - word))
    return out


def found(docs, text_of):
    out = set()
    for r in substrings.repeated_passages(docs).collect():
        start = r.start + len(text_of[r.doc_id][r.start :]) - len(text_of[r.doc_id][r.start :].lstrip())
        out.add((r.doc_id, start, r.end, r.n_words))
        # What is said to be kept reads like the span begins.
        kept, span = text_of[r.kept_doc_id][r.kept_start :].lower().split(), text_of[r.doc_id][start : r.end].lower().split()
        if r.kept_doc_id != r.doc_id:
            assert r.kept_doc_id < r.doc_id and kept[0] == span[0]
    return out


@pytest.mark.parametrize("ends", [".", ""])
def test_every_pasted_passage_of_51_words_is_found_whole(documents, ends):
    rng = random.Random(5)
    rows, where = [], {}
    for k in range(120):
        passage = " ".join(w.capitalize() + ends if rng.random() < 0.15 else w for w in words(rng, 51, 10**6))
        for copy in (0, 1):
            before, after = (" ".join(words(rng, rng.randrange(20, 60), 10**6)) for _ in range(2))
            rows.append((2 * k + copy, f"{before} {passage} {after}"))
        where[2 * k + 1] = (len(before) + 1, len(before) + 1 + len(passage), 51)
    assert found(documents(rows), dict(rows)) == {(i, *span) for i, span in where.items()}


def test_passages_equal_the_plain_rule(documents):
    rng = random.Random(6)
    shared = [words(rng, n) for n in (24, 25, 26, 40, 90)]
    rows = []
    for i in range(60):
        text = words(rng, rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            part = rng.choice(shared)
            a = rng.randrange(len(part))
            text[rng.randrange(len(text) + 1) : 0] = rng.choice([part, part[a:], part[:a], [w.upper() for w in part]])
        rows.append((i, "".join(w + rng.choice([" ", "\n", ". "]) for w in text)))
    rows += [(90, rows[7][1]), (91, rows[7][1]), (92, rows[7][1].upper()), (93, "Same. " * 400), (94, "ab " * 31)]
    rows += [(95, None), (96, ""), (97, " \n"), (98, " ".join(shared[4] * 3)), (99, "x" * 9000)]
    assert found(documents(rows), dict(rows)) == plain(rows)


def test_passages_of_repeated_rows_and_null_ids(documents):
    text = " ".join(words(random.Random(1), 80))
    got = substrings.repeated_passages(documents([(3, text), (3, text), (None, text)], parts=1)).collect()
    assert sorted((str(r.doc_id), r.kept_doc_id, r.n_words) for r in got) == [("3", 3, 80), ("None", 3, 80)]
    assert substrings.repeated_passages(documents([])).collect() == []


@pytest.mark.parametrize("gap", ["\r\n\r\n", "\n\n\n", "\n        ", ".     "])
def test_wide_white_space_does_not_part_a_passage(documents, gap):
    rng = random.Random(8)
    passage = gap.join(" ".join(words(rng, 15, 10**6)) for _ in range(4))
    rows = [(i, gap.join([" ".join(words(rng, 12, 10**6)), passage, " ".join(words(rng, 12, 10**6))])) for i in range(3)]
    begin = {i: (t.index(passage), t.index(passage) + len(passage + gap.rstrip())) for i, t in rows}
    whole = found(documents(rows), dict(rows))
    assert {(i, s, e) for i, s, e, _ in whole} == {(i, *begin[i]) for i in (1, 2)}
    if "\n" in gap:  # lines are units
        coarse = substrings.repeated_spans(documents(rows)).collect()
        assert {(r.doc_id, r.start, r.end) for r in coarse} == {(i, *begin[i]) for i in (1, 2)}


def test_whole_lines_and_short_texts_are_repeated_at_any_length(documents):
    rng = random.Random(4)
    footer, three = " ".join(words(rng, 12)), "see also below"
    rows = [(i, "\n".join([" ".join(words(rng, 30, 10**6)), "  " + (footer.upper() if i == 2 else footer) + " ", " ".join(words(rng, 9, 10**6))])) for i in range(4)]
    rows += [(10, "a short text"), (11, "A short  text\n"), (12, "a short text"), (13, "one a short text"), (20, three + "\nz1 z2"), (21, "y1\n" + three)]
    got = found(documents(rows), dict(rows))
    assert got == plain(rows)
    assert {(i, n) for i, _, _, n in got} == {(1, 12), (2, 12), (3, 12), (11, 3), (12, 3), (21, 3)}
    long = substrings.repeated_passages(documents(rows), least_line_words=10).collect()
    assert {(r.doc_id, r.n_words) for r in long} == {(1, 12), (2, 12), (3, 12)}


def test_the_session_is_as_before_once_a_table_is_there(spark):
    before = spark.conf.get(runtime.SHUFFLES_GO, None)
    assert runtime.durable(spark.range(1000).selectExpr("id % 7 AS k").distinct(), "counts").count() == 7
    assert spark.conf.get(runtime.SHUFFLES_GO, None) == before


def test_runs_that_follow_each_other_move_as_blocks(documents, monkeypatch):
    rng = random.Random(12)
    passage = words(rng, 4000, 10**6)
    rows = [(i, " ".join([*words(rng, 40, 10**6), *passage, *words(rng, 40, 10**6)])) for i in range(3)]
    written = {}

    def counted(df, name="table"):
        out = runtime.durable(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(substrings, "durable", counted)
    got = found(documents(rows), dict(rows))
    assert {(i, n) for i, _, _, n in got} == {(1, 4000), (2, 4000)}
    # A row for each of the 3 * 3976 runs would be four times as many.
    assert max(written.values()) < 3000


def test_texts_that_differ_in_single_words_equal_the_plain_rule(documents):
    rng = random.Random(13)
    passage = words(rng, 300)
    rows = []
    for i in range(25):
        text = list(passage)
        for _ in range(rng.randrange(12)):
            text[rng.randrange(300)] = rng.choice(["new", "NEW", f"n{i}", "İx", "ΑΣ"])
        text = text * 2 if i % 6 == 5 else text
        rows.append((i, "".join(w + rng.choice([" ", "  ", " ", "\n", "\u2003", "\x1c"]) for w in text)))
    rows += [(60, "a b " * 90), (61, "b a " * 40 + "\n" + "a b\nc " * 30), (62, "x " * 24 + "y " * 24 + "x " * 24)]
    assert found(documents(rows), dict(rows)) == plain(rows)


def test_words_of_several_texts_are_those_of_each():
    texts = ["One two\n\nthree", "", " \n ", "İstanbul ΑΣ ΑΣ'\nx\x85y\xa0z", "x" * 70_000 + " y\r\n", "\u200b \U0001f600a"]
    got = substrings._Words(texts, 3)
    flat = [w for t in texts for w in t.lower().split()]
    assert got.counts.tolist() == [len(t.split()) for t in texts]
    at = [m.span() for t in texts for m in re.finditer(r"\S+", t)]
    assert list(zip((got.starts - got.begins[got.text]).tolist(), (got.ends - got.begins[got.text]).tolist(), strict=True)) == at
    assert len(set(flat)) == len(np.unique(got.h)) == len(set(zip(flat, got.h.tolist(), strict=True)))
    lines = [w for t in texts for line in t.split("\n") if (w := len(line.split()))]
    assert got.line_words.tolist() == lines
