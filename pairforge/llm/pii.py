"""Personal data: four fixed patterns, and a linear-chain CRF that adds spans.

The CRF reads word shapes. It is trained on a small table of labelled sentences
(``training_table``) and decoded by Viterbi over many lines at once. It marks
credentials (``secret``) and personal numbers (``id``) that the patterns do not
describe. A span of the CRF must hold a digit and must not touch a span of a
pattern; so lines without a digit need no decoding.

Positions count code points, ends are exclusive. Null and empty texts have no spans.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairforge.llm.common import added, slices, with_columns

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "id")
Span = tuple[int, str, int]  # start, kind, end

# --- the fixed patterns ----------------------------------------------------------
# Possessive repeats and the look-behind change no match; they keep long runs linear.

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All matches of the four patterns, by start and then kind as listed."""
    spans: list[Span] = []
    if "@" in text:
        free = 0  # where the next address may begin
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                spans.append((start, "email", m.end()))
                free = m.end()
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            spans.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                spans.append((m.start(), "phone", m.end()))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


# --- tokens and features ---------------------------------------------------------

TAGS = ("O", "B-secret", "I-secret", "B-id", "I-id")
_TOKEN = re.compile(r"""[^\s=:"'<>,;()\[\]{}]+|[=:"'<>,;()\[\]{}]""")
_CUES = frozenset(
    "token password passwd pwd secret key apikey api_key access bearer credential login "
    "ssn passport iban id no number nr dni nie tax insurance social security licence".split()
)
BUCKETS = 1 << 12


def _shape(token: str) -> str:
    kinds = ["d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in token[:48]]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])


def features(token: str) -> list[str]:
    """Shape features of one token; only cue words are seen by name."""
    shape = _shape(token)
    core = token.strip(".!?#&%$*-")
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    hexes = sum(c in "0123456789abcdef" for c in core)
    size = min(len(core), 50)
    out = [
        f"shape={shape[:12]}",
        f"turns={min(len(shape), 12) // 2}",
        f"size={size if size < 10 else 10 + size // 5}",
        f"digits={'none' if not digits else 'all' if digits == len(core) else 'some'}",
        f"mixed={digits > 0 and letters > 0}",
        f"kind={shape[:1]}",
    ]
    if digits:
        out.append(f"digits={min(digits, 12)}")
    if digits and letters and hexes == len(core) and size >= 12:
        out.append("hex")
    if digits and letters and size >= 12 and core.isalnum():
        out.append("long-code")
        if core.isupper():
            out.append("long-upper-code")
    if core.lower() in _CUES:
        out.append(f"cue={core.lower()}")
        out.append("cue")
    return out


def _bucket(feature: str, place: int) -> int:
    digest = hashlib.blake2b(f"{place}|{feature}".encode(), digest_size=4).digest()
    return int.from_bytes(digest, "little") % BUCKETS


def _rows_of(token: str) -> list[list[int]]:
    names = features(token)
    return [[_bucket(f, place) for f in names] for place in (-1, 0, 1)]


# --- the labelled table ----------------------------------------------------------

# Sentences with marked spans. {h40} and the like are filled with made-up values.
_MARKED = (
    'token = "[secret|{h40}]"',
    'api_key = "[secret|{h32}]"',
    "password=[secret|{h18}] and",
    "passwd: [secret|{m12}] .",
    "the access key [secret|AKIA{u16}] was found",
    "[secret|AKIA{u16}]",
    "on the [secret|AKIA{u16}] of it",
    "secret = [secret|{m24}]",
    "Bearer [secret|{m32}]",
    'key: "[secret|{m40}]"',
    "login with password [secret|{m10}] here",
    "his ssn [id|{d3}-{d2}-{d4}] is",
    "SSN: [id|{d3}-{d2}-{d4}]",
    "social security number [id|{d3}-{d2}-{d4}] .",
    "passport no [id|{U2}{d7}] of",
    "iban [id|{U2}{d20}] is",
    "IBAN: [id|{U2}{d18}]",
    "dni [id|{d8}{U1}] es",
    "tax id [id|{d2}-{d7}] was",
)
_PLAIN = (
    "the and of thing were there for it",
    "Then edinth. Is thndor, thonndon ernd reer thor.",
    "THERHAOU!! OUSHED!! INGND!! ERERTION,!! THE!! IT!! HE.",
    "In.&&& Of%%% edorat$$$ the### reor*** a&&& to%%% eder*** hation###",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0.",
    "the number is {d1} or {d2} in {d4}",
    "on {d4}-{d2}-{d2} at {d2}:{d2} there were {d3} of them",
    "costs ${d2}.{d2} or {d3},{d3} for {d1}.",
    "mail bost.{d2}@mail{d1}.example.com to it",
    "from {d2}.{d3}.{d2}.{d3} on port {d4}",
    "call +{d1} ({d3}) {d3}-{d4} now",
    "card {d4} {d4} {d4} {d4} is",
    "card {d16} of the",
    "version {d1}.{d1}.{d2} build {d5}",
    "room {U1}{d2} and {d3}{x2} of the x{d2}",
    "see https://the.example.org/p{d3}/q?id={d4}",
    "key to the thing is that it is on the table",
    "the password was not there and the token is gone",
    "der die das und {d2} ein schöner über straße",
    "más allá de la ción número {d2} que",
    "chapter {d2}, page {d3}; figure {d1}",
    "a 3rd and 42nd of the 1990s in covid19 or mp3 and h2o",
)
_SLOT = re.compile(r"\{([a-zA-Z])(\d+)\}")
_ALPHABETS = {
    "h": "0123456789abcdef",
    "d": "0123456789",
    "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "x": "abcdefghijklmnopqrstuvwxyz",
    "m": "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789",
}


def training_table(copies: int = 12, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """The labelled sentences: each template filled ``copies`` times, with its spans."""
    rng = np.random.default_rng(seed)

    def fill(m: re.Match) -> str:
        letters = _ALPHABETS[m[1]]
        made = "".join(letters[i] for i in rng.integers(0, len(letters), int(m[2])))
        if m[1] in "hum" and int(m[2]) > 8:  # such codes hold a digit
            made = made[:3] + str(rng.integers(0, 10)) + made[4:]
        return made

    rows = []
    for template in (*_MARKED, *_PLAIN):
        for _ in range(copies):
            filled, text, spans = _SLOT.sub(fill, template), "", []
            for part in re.split(r"(\[(?:secret|id)\|[^\]]*\])", filled):
                if part.startswith(("[secret|", "[id|")):
                    kind, value = part[1:-1].split("|", 1)
                    spans.append((len(text), kind, len(text) + len(value)))
                    text += value
                else:
                    text += part
            rows.append((text, spans))
    return rows


# --- the model -------------------------------------------------------------------


@dataclass
class Crf:
    """``emit`` (buckets x tags) and ``move`` (tag to tag) in log space."""

    emit: np.ndarray
    move: np.ndarray
    _cache: dict = field(default_factory=dict, repr=False, compare=False)
    cache_size: int = 50_000

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": {}}

    def parts(self, token: str) -> np.ndarray:
        """What a token adds to the tag scores of its left neighbour, itself and its right one."""
        got = self._cache.get(token)
        if got is None:
            if len(self._cache) >= self.cache_size:
                self._cache.clear()
            got = np.array([self.emit[rows].sum(axis=0) for rows in _rows_of(token)])
            self._cache[token] = got
        return got

    def scores(self, tokens: list[str]) -> np.ndarray:
        parts = np.array([self.parts(t) for t in tokens])  # tokens x 3 x tags
        out = parts[:, 1].copy()
        out[:-1] += parts[1:, 0]
        out[1:] += parts[:-1, 2]
        return out

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi paths. Sequences of like length are padded and decoded together."""
        paths: list[np.ndarray] = [np.zeros(0, np.int8)] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        start = 0
        while start < len(order):
            stop, least = start, len(scores[order[start]])
            while stop < len(order) and len(scores[order[stop]]) <= least * 1.3 + 8 and (stop - start) < 4096:
                stop += 1
            some = order[start:stop]
            start = stop
            longest = len(scores[some[-1]])
            if not longest:
                continue
            lengths = np.array([len(scores[i]) for i in some])
            batch = np.zeros((longest, len(some), len(TAGS)))
            for k, i in enumerate(some):
                batch[: len(scores[i]), k] = scores[i]
            back = np.zeros(batch.shape, np.int8)
            best = batch[0]
            ends = np.zeros((len(some), len(TAGS)))
            ends[lengths == 1] = best[lengths == 1]
            for t in range(1, longest):
                through = best[:, :, None] + self.move
                back[t] = through.argmax(axis=1)
                best = through.max(axis=1) + batch[t]
                done = lengths == t + 1
                if done.any():
                    ends[done] = best[done]
            tag = ends.argmax(axis=1)
            walked = np.zeros((longest, len(some)), np.int8)
            for t in range(longest - 1, -1, -1):
                alive = lengths > t
                walked[t, alive] = tag[alive]
                inner = alive & (t > 0)
                tag = np.where(inner, np.take_along_axis(back[t], tag[:, None].astype(np.int64), 1)[:, 0], tag)
            for k, i in enumerate(some):
                paths[i] = walked[: lengths[k], k]
        return paths


# Tags that may follow each other: I- only after B- or I- of its kind.
_ALLOWED = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in TAGS] for a in TAGS])


def _tag_ids(text: str, spans: list[Span]) -> tuple[list[str], np.ndarray]:
    tokens, tags = [], []
    for m in _TOKEN.finditer(text):
        tag = 0
        for start, kind, end in spans:
            if start <= m.start() and m.end() <= end:
                tag = TAGS.index(f"{'B' if m.start() == start else 'I'}-{kind}")
        tokens.append(m[0])
        tags.append(tag)
    return tokens, np.array(tags)


def train(rows: list[tuple[str, list[Span]]], epochs: int = 60, rate: float = 0.3, l2: float = 1e-4) -> Crf:
    """Maximum likelihood by AdaGrad over the whole padded table, forward-backward in log space."""
    data = [d for d in (_tag_ids(*r) for r in rows) if d[0]]
    n, longest, k = len(data), max(len(t) for t, _ in data), len(TAGS)
    lengths = np.array([len(t) for t, _ in data])
    gold = np.zeros((longest, n), np.int64)
    index, owner, step = [], [], []
    for i, (tokens, tags) in enumerate(data):
        gold[: len(tags), i] = tags
        for t, token in enumerate(tokens):
            for place, rows_ in zip((-1, 0, 1), _rows_of(token), strict=True):
                if 0 <= t + place < len(tokens):
                    index += rows_
                    owner += [i] * len(rows_)
                    step += [t + place] * len(rows_)
    index, owner, step = (np.array(x) for x in (index, owner, step))
    mask = np.arange(longest)[:, None] < lengths
    emit, move = np.zeros((BUCKETS, k)), np.where(_ALLOWED, 0.0, -1e4)
    seen_e, seen_m = np.full(emit.shape, 1e-8), np.full(move.shape, 1e-8)
    onehot = np.eye(k)[gold] * mask[:, :, None]
    pairs = np.zeros((k, k))
    inner = mask[1:]
    np.add.at(pairs, (gold[:-1][inner], gold[1:][inner]), 1.0)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(epochs):
        score = np.zeros((longest, n, k))
        np.add.at(score, (step, owner), emit[index])
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[0] = score[0]
        for t in range(1, longest):
            moved = lse(alpha[t - 1][:, :, None] + move, 1) + score[t]
            alpha[t] = np.where(mask[t][:, None], moved, alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            moved = lse(move[None] + (score[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[t + 1][:, None], moved, 0.0)
        total = lse(alpha[-1], 1)
        marginal = np.exp(alpha + beta - total[None, :, None]) * mask[:, :, None]
        expected = np.zeros((k, k))
        for t in range(1, longest):
            joint = alpha[t - 1][:, :, None] + move + (score[t] + beta[t])[:, None, :] - total[:, None, None]
            expected += (np.exp(np.minimum(joint, 0)) * mask[t][:, None, None]).sum(axis=0)
        grad = np.zeros_like(emit)
        np.add.at(grad, index, (onehot - marginal)[step, owner])
        grad -= l2 * n * emit
        seen_e += grad**2
        emit += rate * grad / np.sqrt(seen_e)
        change = np.where(_ALLOWED, pairs - expected - l2 * n * np.where(_ALLOWED, move, 0), 0.0)
        seen_m += change**2
        move = move + rate * change / np.sqrt(seen_m)
    return Crf(emit, move)


# --- over documents --------------------------------------------------------------

_DIGIT = re.compile(r"[0-9]")


def _lines_with_digits(text: str):
    """(start, line) of every line that holds a digit."""
    at = 0
    while (m := _DIGIT.search(text, at)) is not None:
        start = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.start())
        end = len(text) if end < 0 else end
        yield start, text[start:end]
        at = end


def spans_of(texts: list[str | None], crf: Crf | None) -> list[tuple[list[Span], list[Span]]]:
    """Per text: the spans of the patterns, and all spans with those the CRF adds."""
    base = [base_spans(t) if t else [] for t in texts]
    if crf is None:
        return [(b, b) for b in base]
    owners, starts, places, scores = [], [], [], []
    for i, text in enumerate(texts):
        for start, line in _lines_with_digits(text) if text else ():
            found = list(_TOKEN.finditer(line))
            owners.append(i)
            starts.append(start)
            places.append([m.span() for m in found])
            scores.append(crf.scores([m[0] for m in found]))
    extra: list[list[Span]] = [[] for _ in texts]
    for i, start, place, path in zip(owners, starts, places, crf.decode(scores), strict=True):
        if not path.any():
            continue
        open_span = None
        for (a, b), tag in zip([*place, (0, 0)], [*path.tolist(), 0], strict=True):
            name = TAGS[tag]
            if open_span and name != f"I-{open_span[1]}":
                extra[i].append(tuple(open_span))
                open_span = None
            if name.startswith("B-"):
                open_span = [start + a, name[2:], start + b]
            elif open_span:
                open_span[2] = start + b
    out = []
    for text, own, more in zip(texts, base, extra, strict=True):
        taken = [(s, e) for s, _, e in own]
        good = []
        for s, kind, e in more:
            while e > s + 1 and text[e - 1] in ".!?#&%$*":
                e -= 1
            if e - s >= 6 and _DIGIT.search(text, s, e) and not any(s < y and x < e for x, y in taken):
                good.append((s, kind, e))
        out.append((own, sorted([*own, *good], key=lambda x: (x[0], KINDS.index(x[1])))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; spans that overlap become one."""
    out, at, until = [], 0, -1
    for start, kind, end in spans:
        if start < until:
            until = max(until, end)
            at = until
            continue
        out += [text[at:start], f"<{kind.upper()}>"]
        at = until = end
    return "".join([*out, text[at:]])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame, crf: Crf | None = None, text: str = "text") -> DataFrame:
    """Adds counts per kind, the digest of the pattern spans, and all spans.

    The added columns replace columns of those names.
    """
    crf = crf or train(training_table())
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches):
        for batch in slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = spans_of(texts, shared.value)
            counts = {
                f"n_{kind}": pa.array([sum(s[1] == kind for s in own) for own, _ in found], pa.int64())
                for kind in BASE_KINDS
            }
            digests = [hashlib.sha256(joined(own).encode()).hexdigest() for own, _ in found]
            yield with_columns(
                batch,
                counts | {
                    "base_sha256": pa.array(digests, pa.string()),
                    "spans": pa.array([joined(every) for _, every in found], pa.string()),
                },
            )

    return docs.mapInArrow(run, added(docs, FOUND))


def redacted(
    docs: DataFrame, crf: Crf | None = None, text: str = "text", size: str = "n_chars"
) -> DataFrame:
    """The same rows with every span in ``text`` replaced, and ``size``, where there is
    such a column, counted anew. Rows without a span stay as they are."""
    crf = crf or train(training_table())
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches):
        for batch in slices(batches, text):
            names = batch.schema.names
            texts = batch.column(names.index(text)).to_pylist()
            new = [
                redact(t, every) if every else t
                for t, (_, every) in zip(texts, spans_of(texts, shared.value), strict=True)
            ]
            arrays = dict(zip(names, batch.columns, strict=True))
            if size in arrays:
                old = arrays[size].to_pylist()
                counted = [s if n is t else len(n) for s, n, t in zip(old, new, texts, strict=True)]
                arrays[size] = pa.array(counted, arrays[size].type)
            arrays[text] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names)

    return docs.mapInArrow(run, docs.schema)
