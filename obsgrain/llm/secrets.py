"""Secret scans: Boolean trigram queries from each rule's regex, postings of an inverted index, verified candidates."""

from __future__ import annotations

import hashlib
import itertools
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgrain.llm.common import buffers, lean, slices, texts

#: Fixed values: (kind, pattern, group whose length counts, least length). The first three are the base kinds. A pattern that
#: begins with an open run looks behind for the run's start, so that a long run is tried once and not at each of its places.
RULES = [
    ("assign", r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("maps", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("login", r"(?<![a-z])[a-z]+://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@:]+@", 0, 0),
]
BASE = ("assign", "access", "hex")

#: Alternatives kept apart in a pattern before its trigrams are gathered.
_MOST = 64


#: A node of a parsed pattern: (kind, value). Kinds: chars (the characters that may stand there, None if many), group (its
#: alternatives, each a list of nodes), repeat (least, most, node) and empty (what matches no text: anchors, look-arounds).
Node = tuple[str, object]


class _Parser:
    """Reads the part of the pattern language that rules use; raises ValueError at anything else."""

    _TAKE = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "0": "\0"}

    def __init__(self, pattern: str):
        self.s, self.at = pattern, 0

    def peek(self, n: int = 1) -> str:
        return self.s[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        got = self.peek(n)
        if len(got) < n:
            raise ValueError("the pattern ends too early")
        self.at += n
        return got

    def whole(self) -> list[list[Node]]:
        out = self.alternatives()
        if self.peek():
            raise ValueError("a bracket too many")
        return out

    def alternatives(self) -> list[list[Node]]:
        out: list[list[Node]] = [[]]
        while self.peek() not in ("", ")"):
            if self.peek() == "|":
                self.take()
                out.append([])
            else:
                out[-1].append(self.repeated(self.atom()))
        return out

    def repeated(self, node: Node) -> Node:
        found = re.compile(r"([*+?]|\{(\d*)(,?)(\d*)\})[?+]?").match(self.s, self.at)
        if not found or (found[1][0] == "{" and not (found[2] or found[4])):
            return node
        self.at = found.end()
        if found[1][0] != "{":
            return "repeat", ({"*": 0, "+": 1, "?": 0}[found[1]], 1 if found[1] == "?" else None, node)
        low = int(found[2] or 0)
        return "repeat", (low, (int(found[4]) if found[4] else None) if found[3] else low, node)

    def atom(self) -> Node:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return "chars", self.klass()
        if c in "^$":
            return "empty", None
        if c == ".":
            return "chars", None
        if c == "\\":
            if self.peek() and self.peek() in "bBAZ":
                self.take()
                return "empty", None
            return "chars", self.escaped()
        if c in "*+?":
            raise ValueError("nothing to repeat")
        return "chars", {c}

    def escaped(self) -> set[str] | None:
        c = self.take()
        if c in "dDwWsS":
            return None
        if c in "xu":
            return {chr(int(self.take(2 if c == "x" else 4), 16))}
        if c in self._TAKE:
            return {self._TAKE[c]}
        if c in string.ascii_letters + string.digits:
            raise ValueError(f"\\{c} is not read")
        return {c}

    def klass(self) -> set[str] | None:
        """The characters of a class if they are few; a negated or open one is None."""
        negated = self.peek() == "^"
        if negated:
            self.take()
        out: set[str] = set()
        many, first = negated, True
        while first or self.peek() != "]":
            first = False
            low = {c} if (c := self.take()) != "\\" else self.escaped()
            if self.peek() == "-" and self.peek(2) != "-]" and low:
                self.take()
                high = {c} if (c := self.take()) != "\\" else self.escaped()
                if not high:
                    raise ValueError("a range to a class")
                a, b = ord(min(low)), ord(min(high))
                many |= b - a >= 8
                low = {chr(x) for x in range(a, min(b, a + 8) + 1)}
            many |= low is None
            out |= low or set()
        self.take()
        return None if many or len(out) > 16 else out

    def group(self) -> Node:
        kind = re.compile(r"\?(?:P<\w+>|([a-z]+):|(:)|(<?[=!])|>)|(?!\?)").match(self.s, self.at)
        # letters beyond ASCII may fold to ASCII ones unless the flag a is set
        if not kind or (kind[1] and ("i" in kind[1]) and "a" not in kind[1]) or (kind[1] and "x" in kind[1]):
            raise ValueError("a group that is not read")
        self.at = kind.end()
        inner = self.alternatives()
        if self.take() != ")":
            raise ValueError("a bracket too few")
        return ("empty", None) if kind[3] else ("group", inner)


def trigram_query(pattern: str) -> list[frozenset[bytes]] | None:
    """A disjunction of trigram sets, lower case: whatever matches has all trigrams of one set. None: no trigram is mandatory.

    Literals and small character classes extend the known strings, alternatives multiply them, anything open ends them. Only
    ASCII letters are folded, in the index as here. A pattern that the parser does not read has no mandatory trigrams.
    """

    def trigrams(s: bytes) -> frozenset[bytes]:
        return frozenset(s[i : i + 3] for i in range(len(s) - 2))

    def stop(states: list[tuple[frozenset[bytes], bytes]]) -> list[tuple[frozenset[bytes], bytes]]:
        return [(have | trigrams(s), b"") for have, s in states]

    def walk(nodes: list[Node], states: list[tuple[frozenset[bytes], bytes]]) -> list[tuple[frozenset[bytes], bytes]]:
        """states: (trigrams so far, the string known to end here)."""
        for kind, value in nodes:
            if kind == "chars":
                said = sorted({lower(c) for c in value}) if value else []
                states = [(have, s + c) for (have, s), c in itertools.product(states, said)] if 0 < len(said) <= 8 else stop(states)
            elif kind == "group":
                states = [x for branch in value for x in walk(branch, states)]
            elif kind == "repeat":
                low, high, inner = value
                if (low, high) == (0, 1):
                    states = states + walk([inner], states)
                else:
                    for _ in range(min(low, 8)):
                        states = walk([inner], states)
                    if high != low or low > 8:
                        states = stop(states)
            states = list(dict.fromkeys(states))
            if len(states) > _MOST:
                states = list(dict.fromkeys(stop(states)))
        return states

    def lower(c: str) -> bytes:
        return (c.lower() if c in string.ascii_uppercase else c).encode()

    try:
        parsed = _Parser(pattern).whole()
    except ValueError:
        return None
    sets = {have | trigrams(s) for have, s in walk([("group", parsed)], [(frozenset(), b"")])}
    return None if frozenset() in sets else sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


class Index:
    """Inverted index of one block of texts: for each trigram of the rules' queries, the texts that hold it."""

    _LOWER = np.arange(256, dtype=np.uint8)
    _LOWER[0x41:0x5B] += 0x20

    def __init__(self, wanted: np.ndarray, numbers: dict[bytes, int], data: np.ndarray, offs: np.ndarray):
        n = len(offs) - 1
        self.all, self.numbers = np.arange(n), numbers
        self.postings: list[np.ndarray] = [np.empty(0, np.int64)] * len(numbers)
        if data.size < 3:
            return
        low = self._LOWER[data].astype(np.uint32)
        hit = wanted[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(hit)
        text = np.searchsorted(offs, at, "right") - 1
        inside = at + 3 <= offs[text + 1]
        pairs = np.unique(hit[at][inside].astype(np.int64) * n + text[inside])
        cuts = np.searchsorted(pairs, np.arange(len(numbers) + 1) * n + n)
        self.postings = [pairs[a:b] % n for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def candidates(self, query: list[frozenset[bytes]] | None) -> np.ndarray:
        if query is None:
            return self.all
        found = []
        for conjunction in query:
            lists = sorted((self.postings[self.numbers[t] - 1] for t in conjunction), key=len)
            both = lists[0]
            for other in lists[1:]:
                both = np.intersect1d(both, other, assume_unique=True)
            found.append(both)
        return np.unique(np.concatenate(found))


def matches(rule: re.Pattern, group: int, least: int, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches in code points; those too short are dropped after they have consumed their text."""
    return [m.span() for m in rule.finditer(text) if m.end(group) - m.start(group) >= least]


def secrets(docs: DataFrame, rules: list[tuple[str, str, int, int]] | None = None) -> DataFrame:
    """Scans every whole text; one row per row of docs, no shuffle: each block of texts is indexed, asked and verified where it lies.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_extra. A null or empty text has no spans: counts 0,
    the digest of the empty string, spans ''. A null doc_id stays null; repeated rows give repeated rows; columns of docs
    other than doc_id and text are not read. Every rule reads a text once from end to end, so a very long text costs time in
    proportion; it is held in memory as a whole. An index serves one block of texts (about 2 MB) and is dropped with it.
    """
    rules = RULES if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(pattern) for _, pattern, _, _ in rules]
        numbers = {t: k + 1 for k, t in enumerate(sorted({t for q in queries if q for s in q for t in s}))}
        wanted = np.zeros(1 << 24, np.uint16)
        for t, k in numbers.items():
            wanted[(t[0] << 16) | (t[1] << 8) | t[2]] = k
        # a run of one class with a least length is matched as such: the same spans, but the scan skips short runs at once
        compiled = [re.compile(re.sub(r"^(\[[^\]]*\])\+$", rf"\1{{{least},}}", pattern) if not group else pattern) for _, pattern, group, least in rules]
        order = {kind: k for k, (kind, *_) in enumerate(rules)}
        for batch in batches:
            for part in slices(batch, 1 << 21):
                data, offs = buffers(part.column("text"))
                index = Index(wanted, numbers, data, offs)
                said = part.column("text").to_pylist()
                found: list[list[tuple[int, int, str, int]]] = [[] for _ in said]
                for (kind, _, group, least), rule, query in zip(rules, compiled, queries, strict=True):
                    for i in index.candidates(query).tolist():
                        found[i] += [(start, order[kind], kind, end) for start, end in matches(rule, group, least, said[i])]
                columns: list[list] = [[] for _ in range(6)]
                for spans in found:
                    spans.sort()
                    base = [x for x in spans if x[2] in BASE]
                    show = lambda xs: ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in xs)
                    for column, x in zip(columns, (*(sum(s[2] == k for s in base) for k in BASE), hashlib.sha256(show(base).encode()).hexdigest(), show(spans), len(spans) - len(base)), strict=True):
                        column.append(x)
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_extra"])

    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(lean(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_extra long")
