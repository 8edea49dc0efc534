"""Texts to token ids, word by word where the vocabulary allows it.

A vocabulary whose tokens never span white space encodes a text like its words one by
one, so common words are looked up. Whether that holds is read from the vocabulary file:
it must fold case, treat white space alike and drop it, and cut words by a known pattern.
Any other file is used as it is, on whole texts.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_WORDS = 600_000  # encoded words a worker keeps, the first it meets
CACHED_BYTES = 64  # longer words are encoded anew

# The steps of a vocabulary file that keep words apart.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
CUT = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Lower-case letters of Latin-1: nothing to fold, and one piece for the model.
_PLAIN = "^[a-zß-öø-ÿ]+$"
# Punctuation after a letter or digit is encoded apart, without an apostrophe and special tokens.
_CLOSED = r"[a-z0-9ß-öø-ÿ][!-&(-/:-@\[-`{-~]+$"
_BOUND = r"'|<\|"


def _byte_letters() -> np.ndarray:
    """The letters that stand for bytes in a byte-level vocabulary; a space, between words, stays."""
    letters = np.arange(256, dtype="<u4")
    others = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]
    letters[others] = 256 + np.arange(len(others))
    letters[ord(" ")] = ord(" ")
    return letters


_AS_LETTERS = _byte_letters()


def _listed(words: pa.Array) -> list[bytes]:
    """Words without white space, as bytes."""
    joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words.cast(pa.binary())), b" ")
    return joined[0].as_py().split(b" ") if len(words) else []


def keeps_words_apart(vocabulary: dict) -> bool:
    """Whether a vocabulary file (as read from JSON) encodes words one by one."""
    cut = (vocabulary.get("pre_tokenizer") or {}).get("pretokenizers")
    fold = (vocabulary.get("normalizer") or {}).get("normalizers")
    specials = [t["content"] for t in vocabulary.get("added_tokens", [])]
    return fold == NORMALIZERS and cut == [CUT, BYTES] and all(t.startswith("<|") and " " not in t for t in specials)


class WordIds(dict):
    """Words, as bytes, to their ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, cached: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.cached = cached
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.apart = keeps_words_apart(json.loads(self.tokenizer.to_str()))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        if core != word and core[-1:].isalnum() and b"'" not in word and b"<|" not in word:
            # Letters and the punctuation after them are encoded apart by the vocabulary too.
            ids = self[core] + self[word[len(core) :]]
        elif word.isalpha() and word.islower():
            # a-z only: nothing to fold, and one piece for the model.
            ids = array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        else:
            ids = self.whole(word.decode("utf-8", "replace"))
        if len(word) <= CACHED_BYTES and len(self) < self.cached:
            self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if not self.apart:
            return self.whole(text.decode("utf-8", "replace"))
        # The vocabulary folds case itself; only its special tokens are told by case.
        text = text if b"<|" in text else text.lower()
        return b"".join([self[w] for w in text.split()])

    def _encoded(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words. What stands before closing punctuation is kept, not each of its forms."""
        closed = pc.and_not(pc.match_substring_regex(words, _CLOSED), pc.match_substring_regex(words, _BOUND))
        cut = pc.if_else(closed, pc.ascii_rtrim(words, _MARKS.decode()), words)
        found = cut.dictionary_encode()
        place, cut = found.indices.to_numpy(), found.dictionary
        cores, plain = _listed(cut), pc.match_substring_regex(cut, _PLAIN).to_numpy(zero_copy_only=False)
        ids = list(map(self.get, cores))
        new = [i for i, known in enumerate(ids) if known is None]
        # One text for all plain words, as the model takes them.
        letters = [i for i in new if plain[i]]
        text = np.frombuffer(b" ".join([cores[i] for i in letters]), np.uint8)
        for i, word in zip(letters, _AS_LETTERS[text].tobytes().decode("utf-32-le").split(" "), strict=False):
            ids[i] = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        for i in new:
            if ids[i] is None:
                ids[i] = self.whole(cores[i].decode("utf-8", "replace"))
            if len(cores[i]) <= CACHED_BYTES and len(self) < self.cached:
                self[cores[i]] = ids[i]
        found = [ids[i] for i in place.tolist()]
        closed = np.flatnonzero(closed.to_numpy(zero_copy_only=False))
        for i, word in zip(closed.tolist(), _listed(words.take(pa.array(closed))), strict=True):
            found[i] += self[word[len(cores[place[i]]) :]]
        return found

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text of a string column; null is empty. A word is looked up once in the whole column."""
        texts = texts.fill_null("")
        if not self.apart:
            return [np.frombuffer(self.whole(t.decode("utf-8", "replace")), "<u4") for t in texts.cast(pa.binary()).to_pylist()]
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids = pa.array(self._encoded(words.dictionary), pa.large_binary()).take(words.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(ids) + 1] // 4
        stops = ends[np.cumsum(pc.list_value_length(split).to_numpy())].tolist()
        data = np.frombuffer(data or b"", "<u4")
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]


_KEPT: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, cached: int = CACHED_WORDS) -> WordIds:
    """The encoder of a vocabulary file, the last one kept for later tasks of the same worker."""
    if (path, cached) not in _KEPT:
        _KEPT.clear()
        _KEPT[path, cached] = WordIds(path, cached)
    return _KEPT[path, cached]
