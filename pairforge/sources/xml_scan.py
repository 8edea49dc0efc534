"""Elements of XML files that are read in pieces.

The text is cut at ``>`` by Spark's own line reader, across input splits. A comment, a CDATA
section, a processing instruction and a tag all end in that character, so one record is
one step of an automaton whose states say where in the markup a record begins. What
state a split begins in is only known once all splits before it are, so

1. every split is scanned from every state at once (``summarise``); the result is one
   short row that says, for each first state, the last one and what was met;
2. these rows are composed in order of file and place (``compose``), which gives every
   split its state, its depth and the number of its first element;
3. every split is scanned once more from that state and cuts out the elements that lie in it
   (``cut``). Records of an element that goes on in the next split are told by their
   numbers, and are brought together by element.

An element cut out is parsed by Python's XML parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

TEXT, COMMENT, CDATA, INSTRUCTION = 0, 1, 2, 3
# Inside a quoted value of a start tag of the element, or of any other tag.
OWN_DOUBLE, OWN_SINGLE, OTHER_DOUBLE, OTHER_SINGLE = 4, 5, 6, 7
BROKEN = 8
STATES = 9
_QUOTE = {OWN_DOUBLE: '"', OTHER_DOUBLE: '"', OWN_SINGLE: "'", OTHER_SINGLE: "'"}
_NAME = re.compile(r"[^\s/]*")
_ENCODING = re.compile(r"""encoding\s*=\s*["']([^"']*)""")

# What a record does: nothing, begin an element, end one, begin and end one.
NOTHING, BEGIN, END, BOTH = 0, 1, 2, 3


class Scanner:
    """Steps of the automaton for elements of one name."""

    def __init__(self, name: str) -> None:
        self.name = name

    def step(self, state: int, record: str) -> tuple[int, int]:
        """(state, event) after a record and the ``>`` that ends it."""
        if state == TEXT:
            at = record.find("<")
            if at < 0:
                return TEXT, NOTHING  # a > in a text
            mark = record[at + 1 : at + 2]
            if mark == "!":
                return self._declaration(record[at:])
            if mark == "?":
                return self._instruction(record[at:])
            if mark == "/":
                closes = record[at + 2 :].rstrip() == self.name
                return TEXT, END if closes else NOTHING
            name = _NAME.match(record, at + 1)[0]
            if not name:
                return BROKEN, NOTHING
            own = name == self.name
            state, event = self._tag(record, at + 1 + len(name), own)
            if not own:
                return state, NOTHING
            return state, BOTH if event == END else BEGIN
        if state == COMMENT:
            return (TEXT if record.endswith("--") else COMMENT), NOTHING
        if state == CDATA:
            return (TEXT if record.endswith("]]") else CDATA), NOTHING
        if state == INSTRUCTION:
            return (TEXT if record.endswith("?") else INSTRUCTION), NOTHING
        if state == BROKEN:
            return BROKEN, NOTHING
        at = record.find(_QUOTE[state])
        if at < 0:
            return state, NOTHING
        return self._tag(record, at + 1, state in (OWN_DOUBLE, OWN_SINGLE))

    @staticmethod
    def _tag(record: str, at: int, own: bool) -> tuple[int, int]:
        """From inside a tag, outside quotes, to its end or to an open quote."""
        while True:
            double, single = record.find('"', at), record.find("'", at)
            if double < 0 and single < 0:
                return TEXT, END if own and record.endswith("/") else NOTHING
            is_double = single < 0 or 0 <= double < single
            end = record.find('"' if is_double else "'", (double if is_double else single) + 1)
            if end < 0:
                return (OWN_DOUBLE if is_double else OWN_SINGLE) + (0 if own else 2), NOTHING
            at = end + 1

    @staticmethod
    def _declaration(markup: str) -> tuple[int, int]:
        if markup.startswith("<!--"):
            return (TEXT if len(markup) >= 6 and markup.endswith("--") else COMMENT), NOTHING
        if markup.startswith("<![CDATA["):
            return (TEXT if len(markup) >= 11 and markup.endswith("]]") else CDATA), NOTHING
        # A document type with declarations of its own may define entities.
        return (BROKEN, NOTHING) if "[" in markup else Scanner._tag(markup, 2, False)

    @staticmethod
    def _instruction(markup: str) -> tuple[int, int]:
        if markup.startswith("<?xml") and (found := _ENCODING.search(markup)) and found[1].lower() not in ("utf-8", "utf8", "us-ascii"):
            return BROKEN, NOTHING
        return (TEXT if len(markup) >= 3 and markup.endswith("?") else INSTRUCTION), NOTHING


@dataclass
class Summary:
    """What a split does from one state: where it ends and what it meets. Numbers are of records in the split."""

    state: int
    begun: int = 0
    depth: int = 0  # elements begun less elements ended
    lowest: int = 0
    highest: int = 0
    first_end: int = -1  # record with the first end of an element
    last_begin: int = -1  # record in which the last element begins

    def meet(self, event: int, number: int) -> None:
        if event & BEGIN:
            self.begun += 1
            self.depth += 1
            self.highest = max(self.highest, self.depth)
            self.last_begin = number
        if event & END:
            self.depth -= 1
            self.lowest = min(self.lowest, self.depth)
            if self.first_end < 0:
                self.first_end = number


class Lanes:
    """A scan of one split from all states."""

    def __init__(self, scanner: Scanner) -> None:
        self.scanner = scanner
        self.lanes = [Summary(s) for s in range(STATES)]
        self.number = 0

    def feed(self, records: Iterable[str]) -> None:
        lanes, step, number = self.lanes, self.scanner.step, self.number
        for record in records:
            known: dict[int, tuple[int, int]] = {}
            for lane in lanes:
                after = known.get(lane.state)
                if after is None:
                    after = known[lane.state] = step(lane.state, record)
                lane.state = after[0]
                if after[1]:
                    lane.meet(after[1], number)
            number += 1
        self.number = number


@dataclass
class Start:
    """Where a split begins: its state, whether an element is open, and the elements begun before it."""

    state: int
    depth: int
    begun: int
    # Records that belong to elements which go over a border: up to ``head`` and from ``tail``.
    head: int = -1
    tail: int | None = None


def compose(splits: list[list[Summary]], file: str) -> list[Start]:
    """Starts of the splits of one file, in order."""
    out = []
    now = Start(TEXT, 0, 0)
    for lanes in splits:
        lane = lanes[now.state]
        if now.depth + lane.lowest < 0 or now.depth + lane.highest > 1 or lane.state == BROKEN:
            raise ValueError(f"{file}: elements inside one another, a tag that ends nothing, or markup that is not supported")
        after = now.depth + lane.depth
        head = -1
        if now.depth:
            head = lane.first_end if lane.first_end >= 0 else 1 << 62
        tail = lane.last_begin if after and lane.last_begin >= 0 else None
        out.append(Start(now.state, now.depth, now.begun, head, tail))
        now = Start(lane.state, after, now.begun + lane.begun)
    if now.depth or now.state != TEXT:
        raise ValueError(f"{file} ends inside an element or its markup")
    return out


@dataclass
class Cutter:
    """Cuts whole elements out of the records of one split."""

    scanner: Scanner
    start: Start
    state: int = field(init=False)
    held: list[str] | None = None

    def __post_init__(self) -> None:
        self.state = self.start.state

    def feed(self, records: Iterable[str]) -> Iterator[str]:
        state, held, step = self.state, self.held, self.scanner.step
        for record in records:
            state, event = step(state, record)
            if event & BEGIN:
                held = [record[record.index("<") :]]
            elif held is not None:
                held.append(record)
            if event & END:
                if held is not None:
                    yield ">".join(held) + ">"
                held = None
        self.state, self.held = state, held
