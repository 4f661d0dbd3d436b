"""Query grammar: text -> tree of clauses; anything that does not parse falls back to its bare terms.

    bare terms (any may match)   +must   -not   AND OR NOT ( )   "phrase"~slop   field:term
    size:[a TO b] modified:{2024-01-01T00:00:00Z TO *]   field: IN [a b]   clause^boost   *
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

TEXT_FIELDS = ("path", "filename", "dir", "content")
RAW_FIELDS = ("extension", "path_exact")
NUMBER_FIELDS = ("size",)
#: Dates are RFC 3339 with a zone, compared to the nanosecond.
DATE_FIELDS = ("modified",)


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Leaf:
    """One term, or the terms of a phrase, in one field."""

    field: str
    terms: tuple[str, ...]
    slop: int = 0


@dataclass(frozen=True)
class Range:
    field: str
    low: str | None
    high: str | None
    low_open: bool = False
    high_open: bool = False


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Nothing:
    pass


@dataclass(frozen=True)
class Bool:
    """must all match; of should at least one, if there is no must; must_not none."""

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()


@dataclass(frozen=True)
class Boost:
    clause: object
    by: float


Node = Leaf | Range | All | Nothing | Bool | Boost


_DATE = re.compile(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)$", re.I)


def number(name: str, raw: str) -> int:
    """The value of a number or date field as it is compared: a whole number, or nanoseconds since 1970."""
    if name in NUMBER_FIELDS:
        if not raw.isdigit():
            raise QueryError(f"{name} takes whole numbers")
        return int(raw)
    m = _DATE.match(raw)
    if not m:
        raise QueryError(f"{name} takes dates such as 2024-01-31T12:00:00Z")
    try:
        at = dt.datetime.fromisoformat(m[1] + m[3].upper().replace("Z", "+00:00"))
    except ValueError as e:
        raise QueryError(str(e)) from e
    return int(at.timestamp()) * 10**9 + int((m[2] or "0").ljust(9, "0"))


def words(text: str, limit: int = 40) -> list[str]:
    """The index's own tokens of a text."""
    # \w without the underscore is letters and digits; marks that count as letters are left to the index side.
    return [w for w in re.findall(r"[^\W_]+", text.lower()) if len(w.encode()) <= limit]


_TOKEN = re.compile(
    r"\s*(?:(?P<op>AND|OR|NOT)(?=[\s()]|$)|(?P<par>[()])|(?P<sign>[+-])(?=\S)"
    r"|(?:(?P<field>[A-Za-z_]+):(?:\s+(?=IN\s*\[))?)?(?:\"(?P<phrase>(?:\\.|[^\"\\])*)\"(?:~(?P<slop>\d+))?|(?P<range>[\[{]\s*\S+\s+TO\s+\S+?\s*[\]}])|(?P<set>IN\s*\[[^\]]*\])|(?P<star>\*)(?=[\s)^]|$)|(?P<word>[^\s()\"^\[\]{}:`]+))"
    r"|\^(?P<boost>\d+(?:\.\d+)?))"
)


@dataclass
class _Parser:
    text: str
    defaults: tuple[str, ...]
    tokens: list[re.Match] = field(default_factory=list)
    at: int = 0

    def parse(self) -> Node:
        pos = 0
        while self.text[pos:].strip():
            m = _TOKEN.match(self.text, pos)
            if not m or m.end() == pos:
                raise QueryError(f"can't read {self.text[pos:]!r}")
            self.tokens.append(m)
            pos = m.end()
        if not self.tokens:
            return Nothing()
        tree = self.either()
        if self.at < len(self.tokens):
            raise QueryError("unbalanced parenthesis")
        return tree

    def peek(self, name: str, value: str | None = None) -> bool:
        if self.at >= len(self.tokens):
            return False
        got = self.tokens[self.at][name]
        return got is not None and (value is None or got == value)

    def either(self) -> Node:
        """Clauses side by side, OR between ANDs."""
        must, should, must_not = [], [], []
        while self.at < len(self.tokens) and not self.peek("par", ")"):
            if self.peek("op", "OR"):
                self.at += 1
                continue
            sign, clause = self.both()
            (must if sign == "+" else must_not if sign == "-" else should).append(clause)
        if not (must or should):
            raise QueryError("nothing to look for")
        if not must and not must_not and len(should) == 1:
            return should[0]
        return Bool(tuple(must), tuple(should), tuple(must_not))

    def both(self) -> tuple[str, Node]:
        sign, first = self.signed()
        if not self.peek("op", "AND"):
            return sign, first
        parts = [(sign, first)]
        while self.peek("op", "AND"):
            self.at += 1
            parts.append(self.signed())
        return "", Bool(tuple(c for s, c in parts if s != "-"), (), tuple(c for s, c in parts if s == "-"))

    def signed(self) -> tuple[str, Node]:
        sign = ""
        if self.peek("sign"):
            sign = self.tokens[self.at]["sign"]
            self.at += 1
        elif self.peek("op", "NOT"):
            sign = "-"
            self.at += 1
        return sign, self.boosted()

    def boosted(self) -> Node:
        clause = self.single()
        while self.peek("boost"):
            clause = Boost(clause, float(self.tokens[self.at]["boost"]))
            self.at += 1
        return clause

    def single(self) -> Node:
        if self.at >= len(self.tokens):
            raise QueryError("the query ends too early")
        m = self.tokens[self.at]
        self.at += 1
        if m["par"] == "(":
            inner = self.either()
            if not self.peek("par", ")"):
                raise QueryError("unbalanced parenthesis")
            self.at += 1
            return inner
        if m["star"] and not m["field"]:
            return All()
        if m["op"] or m["par"] or m["sign"] or m["boost"]:
            raise QueryError("misplaced operator")
        fields = (m["field"],) if m["field"] else self.defaults
        if any(f not in (*TEXT_FIELDS, *RAW_FIELDS, *NUMBER_FIELDS, *DATE_FIELDS) for f in fields):
            raise QueryError(f"no such field: {m['field']}")
        if m["range"]:
            raw = m["range"]
            low, high = re.split(r"\s+TO\s+", raw[1:-1].strip())
            bound = lambda x: None if x == "*" else x
            for f, x in ((f, x) for f in fields if f in (*NUMBER_FIELDS, *DATE_FIELDS) for x in (low, high) if x != "*"):
                number(f, x)
            return _any(tuple(Range(f, bound(low), bound(high), raw[0] == "{", raw[-1] == "}") for f in fields))
        if m["set"]:
            return _any(tuple(self.leaf(f, w) for w in m["set"][m["set"].index("[") + 1 : -1].split() for f in fields))
        if m["star"]:
            raise QueryError("a field can't be matched whole")
        raw = m["word"] if m["phrase"] is None else re.sub(r"\\(.)", r"\1", m["phrase"])
        return _any(tuple(self.leaf(f, raw, int(m["slop"] or 0)) for f in fields))

    def leaf(self, name: str, raw: str, slop: int = 0) -> Node:
        if name in (*NUMBER_FIELDS, *DATE_FIELDS):
            number(name, raw)
            return Range(name, raw, raw)
        if name in RAW_FIELDS:
            return Leaf(name, (raw,))
        found = tuple(words(raw))
        return Leaf(name, found, slop) if found else Nothing()


def _any(clauses: tuple) -> Node:
    return clauses[0] if len(clauses) == 1 else Bool(should=clauses)


def parse(text: str, defaults: tuple[str, ...]) -> Node:
    return _Parser(text, defaults).parse()


def fallback(text: str, defaults: tuple[str, ...]) -> Node:
    """Every bare term in every field, any may match; no term: nothing matches."""
    leaves = tuple(Leaf(f, (w,)) for w in words(text) for f in defaults)
    return _any(leaves) if leaves else Nothing()


def lenient(text: str, defaults: tuple[str, ...]) -> Node:
    try:
        return parse(text, defaults)
    except QueryError:
        return fallback(text, defaults)


def leaves(node: Node) -> list[Leaf]:
    if isinstance(node, Leaf):
        return [node]
    if isinstance(node, Boost):
        return leaves(node.clause)
    if isinstance(node, Bool):
        return [x for part in (node.must, node.should, node.must_not) for c in part for x in leaves(c)]
    return []
