"""Pairs from XML in pieces, against a parser that sees the whole file."""

import io
import random
from xml.etree import ElementTree

import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from pairforge.sources import readers
from pairforge.sources.xml_scan import Cutter, Lanes, Scanner, compose

TEXTS = ["a", " b ", "&lt;", "&amp;gt;", "é", ">", "<!-- </pair> <pair> -->", "<![CDATA[</pair><!-- ]] >]]>", "<?p </pair> ?>", "\n", "'", '"', "]]", "--"]
BETWEEN = ["", "\n", "<!-- <pair id='c'><t>x</t><h>y</h></pair> -->", "<!---->", "<?go <pair> ?>", "<note a='>' b=\"<\"/>".replace("<\"", "&lt;\""), "<pairs/>", "<x><pair-of/></x>", "<![CDATA[<pair>]]>"]
VALUES = ["1", "a>b", "/", "&lt;pair&gt;", "it''s".replace("''", "&apos;"), "x/>"]


def element(rng_choice):
    quote = rng_choice(['"', "'"])
    attributes = f" id={quote}{rng_choice(VALUES)}{quote}" + rng_choice(["", "\n", " similarity='2.5'", ' entailment="None" '])
    if rng_choice([0, 0, 0, 1]):
        return f"<pair{attributes}{rng_choice(['', ' '])}/>"
    inner = [f"<{tag}{rng_choice(['', ' '])}>{''.join(rng_choice(TEXTS) for _ in range(rng_choice([0, 1, 3])))}</{tag}{rng_choice(['', ' ', chr(10)])}>" for tag in "th"]
    return f"<pair{attributes}>{rng_choice(['', ' ', '<!-- > -->'])}{inner[0]}{inner[1]}</pair{rng_choice(['', ' ', chr(10)])}>"


def document(rng_choice, n):
    head = rng_choice(["", "<?xml version='1.0' encoding='UTF-8'?>\n", "<!DOCTYPE corpus SYSTEM 'a>b'>"])
    body = "".join(element(rng_choice) + rng_choice(BETWEEN) for _ in range(n))
    return f"{head}<corpus>{rng_choice(BETWEEN)}{body}</corpus>{rng_choice(['', chr(10), '<!-- end -->'])}"


def whole(text):
    """(id, entailment, similarity, t, h) of every pair, by one parse of everything."""
    out = []
    for pair in ElementTree.parse(io.BytesIO(text.encode())).getroot().iter("pair"):
        t, h = pair.find("t"), pair.find("h")
        out.append((pair.get("id"), pair.get("entailment"), pair.get("similarity"), None if t is None else t.text, None if h is None else h.text))
    return out


def parses(text):
    try:
        return whole(text) is not None
    except ElementTree.ParseError:
        return False


def in_pieces(text, cuts):
    """The same from records dealt to splits at the given places, by scan, composition and cutting."""
    records = text.split(">")
    if records[-1] == "":
        records.pop()
    edges = sorted({0, len(records), *(c % (len(records) + 1) for c in cuts)})
    splits = [records[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    scanner, summaries = Scanner("pair"), []
    for split in splits:
        lanes = Lanes(scanner)
        lanes.feed(split)
        summaries.append(lanes.lanes)
    out, over = [], {}
    for split, lanes, start in zip(splits, summaries, compose(summaries, "f"), strict=True):
        cutter = Cutter(scanner, start)
        out += cutter.feed(split)
        for place, record in enumerate(split):
            if place <= start.head:
                over.setdefault(start.begun - 1, []).append(record)
            elif start.tail is not None and place >= start.tail:
                over.setdefault(start.begun + lanes[start.state].begun - 1, []).append(record)
    out += [(t := ">".join(r) + ">")[t.index("<") :] for r in over.values()]
    return [tuple(r.values()) for r in readers._parsed(out).to_pylist()]


def order(row):
    return tuple((x is None, x or "") for x in row)


@settings(max_examples=1500, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(0, 6), st.lists(st.integers(0, 1000), max_size=12))
def test_pieces_give_what_a_parser_gives(rng, n, cuts):
    text = document(rng.choice, n)
    try:
        want = whole(text)
    except ElementTree.ParseError:  # the marks of two texts may meet, as in ]]>
        assume(False)
    assert sorted(in_pieces(text, cuts), key=order) == sorted(want, key=order)


@pytest.mark.parametrize(
    "text",
    [
        "<c><pair id='1'><t>a</t><h>b</h></c>",
        "<c><pair id='1'><pair id='2'/></pair></c>",
        "<c></pair></c>",
        "<!DOCTYPE c [<!ENTITY x 'y'>]><c></c>",
        "<?xml version='1.0' encoding='latin-1'?><c></c>",
        "<c><!-- <pair/> </c>",
        "<c>< pair/></c>",
    ],
)
def test_broken_markup_is_told(text):
    with pytest.raises(ValueError):
        in_pieces(text, [])


@pytest.fixture
def tiny_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_in_any_number_of_splits(spark, tmp_path, tiny_splits):
    rng = random.Random(3)
    want = []
    for name, n in zip("abc", (1, 300, 900)):
        body = [document(rng.choice, 1) for _ in range(n)]
        text = "<all>" + "".join(t[t.index("<corpus>") :] for t in body if parses(t)) + "</all>"
        (tmp_path / f"{name}.xml").write_text(text, encoding="utf-8", newline="")
        want += whole(text)
    for size in ("300", "4000", "100000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = readers.read_xml(spark, str(tmp_path), need_labels=False)
        rows = [(r.id, r.t, r.h) for r in got.collect()]
        assert sorted(rows, key=order) == sorted([(i, t or None, h or None) for i, _, _, t, h in want], key=order)


def test_pairs_that_used_to_vanish(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<c>" + "".join(f'<pair id="{i}"><t>a{i}</t><h>b</h></pair >' for i in range(3)) + "</c>")
    assert sorted(r.id for r in readers.read_xml(spark, str(tmp_path), False).collect()) == ["0", "1", "2"]


def test_a_file_cut_short_fails(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<c><pair id='1'><t>a</t><h>b</h>")
    with pytest.raises(ValueError, match="ends inside"):
        readers.read_xml(spark, str(tmp_path), False)
