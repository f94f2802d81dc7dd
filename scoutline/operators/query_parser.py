"""Reads the syntax of text search into the nodes of a Boolean tree, a row each; what can't be understood is left out.

A query is a list of clauses: a word, a "phrase", a (group), a range, a set or * for every document, after field: or not. A clause
after + must match, after - or NOT must not, any other may. AND binds neighbours that must match together, OR and a space separate what may. A word
of several tokens is a phrase. ^2.5 after a clause multiplies its score. "a b"~2 lets up to two words stand between those of a phrase, "a b"* takes the last as a beginning.
Ranges and sets need a field: [a TO b] with its ends, {a TO b} without them, * for no end, also >a, >=a, <a and <=a; IN [a b c].
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pandas as pd

LONGEST_TOKEN = 40
#: Parentheses nested deeper are passed over: their clauses belong to the group around them.
DEEPEST = 16

NODES = "qid long, node int, parent int, depth int, occur string, kind string, boost double, field string, tokens array<string>, slop int, low string, low_in boolean, high string, high_in boolean, branch int, need string, denied boolean"

_SPACE = re.compile(r"\s*")
_FIELD = re.compile(r"([A-Za-z_][A-Za-z0-9_.]*):(?=\S|\s*IN\s+\[)")
_WORD = re.compile(r'(?:\\.|[^\s()"^\\])+')
_QUOTED = re.compile(r'"((?:\\.|[^"\\])*)"?', re.S)
_AFTER = re.compile(r"~(\d{1,4})|(\*)")
_BOOST = re.compile(r"\^(\d+(?:\.\d+)?)?")
_RANGE = re.compile(r"([\[{])\s*(\S+)\s+TO\s+([^\s\]}]+)\s*([\]}])")
_BESIDE = re.compile(r'(>=|<=|>|<)\s*([^\s()"^]+)')
_SET = re.compile(r"\s*IN\s+\[([^\]]*)\]?")
_OPERATOR = re.compile(r"(AND|OR|NOT)(?=[\s()\"+-]|$)")


@dataclass(frozen=True)
class Node:
    """A group with children (occur, node), or a leaf of the kind text, prefix, range, set or all."""

    kind: str
    field: str | None = None
    tokens: tuple[str, ...] = ()
    slop: int = 0
    boost: float = 1.0
    low: tuple[str | None, bool] = (None, True)
    high: tuple[str | None, bool] = (None, True)
    children: tuple[tuple[str, Node], ...] = ()


def tokens(text: str) -> tuple[str, ...]:
    """As the index has them."""
    return tuple(t for t in re.findall(r"[^\W_]+", text.lower()) if len(t.encode()) <= LONGEST_TOKEN)


class _Reader:
    def __init__(self, text: str, fields: Iterable[str]):
        self.text, self.fields, self.at, self.passed = text, set(fields), 0, 0

    def take(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def group(self, inside: str | None, depth: int) -> Node | None:
        """Clauses up to the end or to the parenthesis that closes the group."""
        rows: list[list[tuple[str, Node]]] = []
        joined = negated = False
        while True:
            self.take(_SPACE)
            rest = self.text[self.at : self.at + 1]
            if rest == ")" and self.passed:
                self.passed -= 1
                self.at += 1
                continue
            if not rest or rest == ")":
                break
            if word := self.take(_OPERATOR):
                negated = word[1] == "NOT" or (negated and word[1] != "OR")
                joined = word[1] == "AND" or (joined and word[1] == "NOT")
                continue
            sign = rest if rest in "+-" and self.text[self.at + 1 : self.at + 2].replace(")", "").strip() else ""
            self.at += len(sign)
            node = self.operand(inside, depth)
            if node is not None:
                occur = "-" if negated or sign == "-" else sign
                if joined and rows:
                    rows[-1].append((occur, node))
                else:
                    rows.append([(occur, node)])
            joined = negated = False
        both = [[(occur or "+", n) for occur, n in row] if len(row) > 1 else row for row in rows]
        children = both[0] if len(both) == 1 else [row[0] if len(row) == 1 else ("", Node("group", children=tuple(row))) for row in both]
        return Node("group", children=tuple(children)) if children else None

    def operand(self, inside: str | None, depth: int) -> Node | None:
        start = self.at
        named = self.take(_FIELD)
        if named and named[1] not in self.fields:
            named, self.at = None, start
        node = self.leaf(named[1] if named else inside, named is not None, depth)
        if (boost := self.take(_BOOST)) and boost[1] and node is not None:
            node = replace(node, boost=node.boost * float(boost[1]))
        return node

    def leaf(self, name: str | None, named: bool, depth: int) -> Node | None:
        if self.text.startswith("(", self.at):
            self.at += 1
            if depth == DEEPEST:
                self.passed += 1
                return None
            found = self.group(name, depth + 1)
            self.at += self.text.startswith(")", self.at)
            return found
        if quoted := self.take(_QUOTED):
            own = tokens(re.sub(r"\\(.)", r"\1", quoted[1]))
            after = self.take(_AFTER)
            if after and after[2]:
                return Node("prefix", name, own) if len(own) > 1 else None
            return Node("text", name, own, int(after[1]) if after and len(own) > 1 else 0) if own else None
        for pattern in (_RANGE, _BESIDE, _SET):
            if (pattern is not _SET or named) and (m := self.take(pattern)):
                return self.many(name, m, pattern)
        if self.text.startswith("*", self.at) and not self.text[self.at + 1 : self.at + 2].strip(")^ \t\n"):
            self.at += 1
            return Node("all", name)
        if word := self.take(_WORD):
            own = tokens(re.sub(r"\\(.)", r"\1", word[0]))
            return Node("text", name, own) if own else None
        self.at += 1
        return None

    @staticmethod
    def many(name: str | None, m: re.Match, pattern: re.Pattern) -> Node | None:
        """A range or a set; nothing if it names no field, or an end is not one token."""
        if name is None:
            return None
        if pattern is _SET:
            own = tuple(dict.fromkeys(t for x in m[1].split() for t in tokens(x) if len(tokens(x)) == 1))
            return Node("set", name, own) if own else None
        if pattern is _RANGE:
            ends = [(m[2], m[1] == "["), (m[3], m[4] == "]")]
        else:
            ends = [(m[2], "=" in m[1]), ("*", True)]
            ends = ends if m[1][0] == ">" else ends[::-1]
        read = [(None, True) if x == "*" else (tokens(x)[0], closed) if len(tokens(x)) == 1 else None for x, closed in ends]
        return None if None in read else Node("range", name, (), 0, 1.0, *read)


def parse(text: str | None, fields: Iterable[str]) -> Node | None:
    """The tree of a query; None if nothing of it can be read."""
    reader = _Reader(text or "", fields)
    found: list[tuple[str, Node]] = []
    while reader.at < len(reader.text):
        more = reader.group(None, 0)
        found += more.children if more else ()
        reader.at += 1  # a parenthesis that closes nothing
    return Node("group", children=tuple(found)) if found else None


def rows(qid: int, root: Node | None) -> Iterator[tuple]:
    """NODES of a tree, the root first. A node's branch is the root's child that it is in, need that one's occur; it is denied where it or a group around it is after -."""
    count = 0

    def emit(node: Node, parent: int | None, depth: int, occur: str, branch: int | None, need: str, denied: bool) -> Iterator[tuple]:
        nonlocal count
        own = count
        count += 1
        branch, need, denied = (own, occur, occur == "-") if depth == 1 else (branch, need, denied or occur == "-")
        yield qid, own, parent, depth, occur, node.kind, node.boost, node.field, [*node.tokens], node.slop, *node.low, *node.high, branch, need, denied
        for inner, child in node.children:
            yield from emit(child, own, depth + 1, inner, branch, need, denied)

    if root is not None:
        yield from emit(root, None, 0, "", None, "", False)


def parsed(fields: list[str]):
    """For mapInPandas: the nodes of queries (qid, query)."""
    names = [c.split(" ")[0] for c in NODES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([r for qid, text in zip(f["qid"], f["query"], strict=True) for r in rows(qid, parse(text, fields))], columns=names)

    return run
