"""Secret scans with one combined automaton over the bytes of a text.

The rules' heads are parsed, turned into one nondeterministic automaton, made
deterministic by subset construction, minimised by partition refinement, and laid
out as a transition array.  One pass over the bytes marks the places where a rule's
head ends; the same construction on the reversed head finds where it started, and
the run of tail characters behind it ends the match.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import slices

CHUNK = 1024  # bytes that one lane of the scan takes
BLOCK = 8 << 20  # bytes whose states are held at once


@dataclass(frozen=True)
class Rule:
    """Matches ``head`` followed by the longest run of ``tail`` characters.

    ``head`` ends with the first character of the run (or its first few, where the
    head is the run itself); ``least`` is the fewest characters of the run, counted
    from ``tail_from`` characters before the head's end.  Matches of a rule are taken
    from the left and don't overlap; one that is too short is dropped after it has
    taken its place.  ``most`` ends the run after so many characters.
    """

    kind: str
    head: str
    tail: str
    tail_from: int
    least: int
    ignore_case: bool = False
    most: int = 1 << 30
    base: bool = False
    armoured: bool = False  # the match goes on to the line that ends the armour


# The three base rules, then rules for well-known public token formats.
RULES = (
    Rule(
        "assign",
        "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]",
        "A-Za-z0-9+/_.=-", 1, 12, True, base=True,
    ),
    Rule("access", "AKIA[A-Z0-9]", "A-Z0-9", 5, 18, base=True),
    Rule("hex", "[0-9a-f]{16}", "0-9a-f", 16, 16, base=True),
    Rule("github", "gh(p|o|u|s|r)_[A-Za-z0-9]", "A-Za-z0-9", 1, 36),
    Rule("slack", "xox(a|b|p|r|s)-[A-Za-z0-9-]", "A-Za-z0-9-", 1, 20),
    Rule("google", "AIza[A-Za-z0-9_-]", "A-Za-z0-9_-", 1, 35, most=35),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]", "A-Za-z0-9_.-", 1, 16),
    Rule("private", "-----BEGIN\\x20([A-Z]+\\x20)*PRIVATE\\x20KEY-----", "", 0, 0, armoured=True),
)


def _class(text: str) -> frozenset[int]:
    out: set[int] = set()
    i = 0
    while i < len(text):
        if i + 2 < len(text) and text[i + 1] == "-":
            out.update(range(ord(text[i]), ord(text[i + 2]) + 1))
            i += 3
        else:
            out.add(ord(text[i]))
            i += 1
    return frozenset(out)


def _folded(chars: frozenset[int]) -> frozenset[int]:
    letters = {c ^ 32 for c in chars if chr(c).isascii() and chr(c).isalpha()}
    return chars | frozenset(letters)


def parse(pattern: str, fold: bool = False) -> tuple:
    """Tree of a pattern: literals, ``[..]``, ``(..|..)``, ``? * + {n}``, ``\\xHH``.

    Nodes: ("set", bytes), ("cat", items), ("alt", items), ("star", item).
    """
    place = 0

    def alternatives() -> tuple:
        nonlocal place
        options = [sequence()]
        while place < len(pattern) and pattern[place] == "|":
            place += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("alt", tuple(options))

    def sequence() -> tuple:
        nonlocal place
        items: list[tuple] = []
        while place < len(pattern) and pattern[place] not in "|)":
            item = atom()
            mark = pattern[place : place + 1]
            if mark and mark in "?*+":
                place += 1
                star = ("star", item)
                item = {"?": ("alt", (item, ("cat", ()))), "*": star, "+": ("cat", (item, star))}[mark]
            elif mark == "{":
                end = pattern.index("}", place)
                item = ("cat", (item,) * int(pattern[place + 1 : end]))
                place = end + 1
            items.append(item)
        return ("cat", tuple(items))

    def atom() -> tuple:
        nonlocal place
        char = pattern[place]
        place += 1
        if char == "(":
            inner = alternatives()
            place += 1
            return inner
        if char == "[":
            end = pattern.index("]", place)
            chars = _class(pattern[place:end])
            place = end + 1
        elif char == "\\":
            chars = frozenset([int(pattern[place + 1 : place + 3], 16)])
            place += 3
        else:
            chars = frozenset([ord(char)])
        return ("set", _folded(chars) if fold else chars)

    return alternatives()


def _reversed(tree: tuple) -> tuple:
    if tree[0] == "set":
        return tree
    if tree[0] == "star":
        return ("star", _reversed(tree[1]))
    items = tuple(map(_reversed, tree[1]))
    return (tree[0], items[::-1] if tree[0] == "cat" else items)


@dataclass
class _Nfa:
    """States with byte-set edges and empty edges."""

    edges: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Append what ``tree`` matches behind ``start``; returns the end state."""
        if tree[0] == "set":
            end = self.state()
            self.edges[start].append((tree[1], end))
            return end
        if tree[0] == "cat":
            for item in tree[1]:
                start = self.add(item, start)
            return start
        end = self.state()
        if tree[0] == "star":
            self.empty[start].append(end)
            self.empty[self.add(tree[1], end)].append(end)
            return end
        for item in tree[1]:
            self.empty[self.add(item, start)].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        found = set(todo)
        while todo:
            for state in self.empty[todo.pop()]:
                if state not in found:
                    found.add(state)
                    todo.append(state)
        return frozenset(found)


@dataclass
class Automaton:
    """``following[state, byte]``; ``accepts[state]`` has a bit for each rule; state 0 is the start."""

    following: np.ndarray
    accepts: np.ndarray


def compiled(trees: list[tuple], anywhere: bool) -> Automaton:
    """Subset construction over all trees, minimised.  ``anywhere``: a match may start at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {}
    for bit, tree in enumerate(trees):
        own = nfa.state()
        nfa.empty[start].append(own)
        ends[nfa.add(tree, own)] = 1 << bit
    first = nfa.closure({start})
    numbers = {first: 0}
    order = [first]
    rows: list[list[int]] = []
    accepts: list[int] = []
    for subset in order:
        accepts.append(sum(ends.get(s, 0) for s in subset))
        moves: list[set[int]] = [{start} if anywhere else set() for _ in range(256)]
        for state in subset:
            for chars, target in nfa.edges[state]:
                for c in chars:
                    moves[c].add(target)
        memo: dict[frozenset[int], int] = {}
        row = []
        for targets in moves:
            key = frozenset(targets)
            if key not in memo:
                closed = nfa.closure(targets)
                if closed not in numbers:
                    numbers[closed] = len(order)
                    order.append(closed)
                memo[key] = numbers[closed]
            row.append(memo[key])
        rows.append(row)
    return minimised(np.array(rows), np.array(accepts))


def minimised(following: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Merge states that accept alike and lead to merged states alike (partition refinement)."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        signature = np.concatenate([block[:, None], block[following]], axis=1)
        _, refined = np.unique(signature, axis=0, return_inverse=True)
        refined = refined.ravel()
        if refined.max() == block.max():
            break
        block = refined
    _, sample = np.unique(block, return_index=True)
    rank = np.empty(len(sample), int)
    order = [block[0], *(b for b in range(len(sample)) if b != block[0])]  # the start comes first
    rank[order] = np.arange(len(order))
    picked = sample[order]
    return Automaton(rank[block[following[picked]]].astype(np.int32), accepts[picked].astype(np.int64))


_BODY = re.compile(rb"(?:\s*[A-Za-z0-9+/=]{16,})*")


def armour_end(data: bytes, at: int, last: int) -> int:
    """End of a key whose opening line ends at ``at``: behind its closing line or, where that is missing, its body."""
    dashes = data.find(b"-----", at, last)  # a body has none, so each stretch is searched once
    if dashes >= 0 and data.startswith(b"-----END ", dashes):
        close = data.find(b"-----", dashes + 9, min(last, dashes + 128))
        if close >= 0:
            return close + 5
    return _BODY.match(data, at, last).end()


class Scanner:
    """The compiled rules; finds spans in texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [parse(rule.head, rule.ignore_case) for rule in rules]
        self.forward = compiled(trees, anywhere=True)
        self.backward = [compiled([_reversed(tree)], anywhere=False) for tree in trees]
        self.dead = [int(np.flatnonzero((b.following == np.arange(len(b.following))[:, None]).all(1) & (b.accepts == 0))[0]) for b in self.backward]
        self.tails = [frozenset(_class(rule.tail)) for rule in rules]
        self.rows = self.forward.following.tolist()
        self.flat = (self.forward.following * 256).astype(np.int32).ravel()
        self.marked = self.forward.accepts > 0

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(place of the head's last byte, rule bits) in one pass over the bytes.

        The bytes are cut into lanes that advance together from the start state; the
        first bytes of a lane are then repeated from the state in which the lane
        before it ended, until both agree.  The states are those of a single pass.
        """
        found: list[tuple[int, int]] = []
        last = 0
        for at in range(0, len(data), BLOCK):
            last = self._block(data[at : at + BLOCK], at, last, found)
        return found

    def _block(self, data: bytes, base: int, last: int, found: list[tuple[int, int]]) -> int:
        n = len(data)
        lanes = -(-n // CHUNK)
        buffer = np.zeros(lanes * CHUNK, np.uint8)
        buffer[:n] = np.frombuffer(data, np.uint8)
        columns = np.ascontiguousarray(buffer.reshape(lanes, CHUNK).T)
        states = np.empty((CHUNK, lanes), np.int32)
        now = np.zeros(lanes, np.int32)
        for i in range(CHUNK):
            now = self.flat.take(now + columns[i])
            states[i] = now
        states >>= 8
        rows = self.rows
        finals = states[-1].tolist()
        for lane in range(lanes):
            if last:
                state, at = last, lane * CHUNK
                for i in range(min(CHUNK, n - at)):
                    state = rows[state][data[at + i]]
                    if states[i, lane] == state:
                        break
                    states[i, lane] = state
                else:
                    finals[lane] = state
            last = finals[lane]
        line, lane = np.nonzero(self.marked[states])
        places = lane * CHUNK + line
        order = np.argsort(places, kind="stable")
        bits = self.forward.accepts[states[line, lane]]
        found += [(base + int(places[i]), int(bits[i])) for i in order if places[i] < n]
        return last

    def resolve(self, data: bytes, first: int, last: int, ends: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Matches (start, end, rule) as byte places within ``data[first:last]``."""
        found = []
        for number, rule in enumerate(self.rules):
            free = first
            back, dead, tail = self.backward[number], self.dead[number], self.tails[number]
            for place, bits in ends:
                if not bits >> number & 1 or place < free:
                    continue
                state, start, i = 0, -1, place
                while i >= free:
                    state = int(back.following[state, data[i]])
                    if state == dead:
                        break
                    if back.accepts[state]:
                        start = i
                    i -= 1
                if start < 0:
                    continue
                run = place + 1 - rule.tail_from
                end = place + 1
                while end < last and end - run < rule.most and data[end] in tail:
                    end += 1
                if rule.armoured:
                    end = armour_end(data, end, last)
                free = end
                if end - run >= rule.least:
                    found.append((start, end, number))
        return sorted(found, key=lambda x: (x[0], x[2]))

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Spans (start, end, rule) of each text in code points, by start, then rule."""
        raw = [text.encode() if text else b"" for text in texts]
        gap = b"\x00"  # no rule has it, so no match crosses two texts
        data = gap.join(raw)
        starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
        ends = self.ends(data)
        owner = np.searchsorted(starts, [e[0] for e in ends], side="right") - 1
        by: dict[int, list[tuple[int, int]]] = {}
        for which, end in zip(owner.tolist(), ends, strict=True):
            by.setdefault(which, []).append(end)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for which, own in by.items():
            base = int(starts[which])
            spans = self.resolve(data, base, base + len(raw[which]), own)
            if len(raw[which]) == len(texts[which]):
                out[which] = [(s - base, e - base, r) for s, e, r in spans]
            elif spans:
                chars = np.cumsum((np.frombuffer(raw[which], np.uint8) & 0xC0) != 0x80)
                before = np.concatenate([[0], chars])
                out[which] = [(int(before[s - base]), int(before[e - base]), r) for s, e, r in spans]
        return out


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[r].kind}:{s}:{e}" for s, e, r in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    """``text`` with every run of overlapping spans replaced by the first one's kind in brackets."""
    out, place = [], 0
    for start, end, rule in spans:
        if start >= place:
            out += [text[place:start], f"[{rules[rule].kind}]"]
        place = max(place, end)
    return "".join([*out, text[place:]])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, redact: bool = False) -> DataFrame:
    """One row per input row: doc_id, counts of the base kinds, base_sha256, spans and n_spans.

    ``spans`` lists kind:start:end of all matches (code points, end exclusive) by start,
    then by the order of the rules; ``base_sha256`` hashes that list of the base rules
    alone.  ``redact`` adds the texts with the spans replaced.  Map-only.  A null or
    empty text has no spans (a null one stays null); null keys and repeated rows are
    kept as they are; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = [i for i, rule in enumerate(rules) if rule.base]
    names = [f"n_{rules[i].kind}" for i in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            found = scanner.scan(texts)
            own = [[s for s in spans if rules[s[2]].base] for spans in found]
            columns = [
                batch.column("doc_id"),
                *(pa.array([sum(s[2] == i for s in spans) for spans in own], pa.int64()) for i in base),
                pa.array([hashlib.sha256(joined(spans, rules).encode()).hexdigest() for spans in own]),
                pa.array([joined(spans, rules) for spans in found], pa.string()),
                pa.array([len(spans) for spans in found], pa.int64()),
            ]
            if redact:
                columns.append(
                    pa.array([t and redacted(t, spans, rules) for t, spans in zip(texts, found, strict=True)], pa.string())
                )
            labels = ["doc_id", *names, "base_sha256", "spans", "n_spans", *(["text"] if redact else [])]
            yield pa.RecordBatch.from_arrays(columns, names=labels)

    schema = f"doc_id {kind}, {''.join(f'{n} long, ' for n in names)}base_sha256 string, spans string, n_spans long"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", text string" if redact else ""))


def without_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` with every secret in ``text`` replaced and ``n_chars``, if there, counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            found = scanner.scan(texts)
            at = batch.schema.get_field_index("text")
            new = [redacted(t, spans, rules) if spans else t for t, spans in zip(texts, found, strict=True)]
            batch = batch.set_column(at, "text", pa.array(new, pa.string()))
            if "n_chars" in batch.schema.names and any(found):
                counts = batch.column("n_chars").to_pylist()
                counts = [len(t) if spans else n for t, n, spans in zip(new, counts, found, strict=True)]
                at = batch.schema.get_field_index("n_chars")
                batch = batch.set_column(at, "n_chars", pa.array(counts, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
