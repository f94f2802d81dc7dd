"""Symbols and references of Rust sources, by a scanner of items in Python workers.

The scanner blanks comments and strings, walks the code once, and knows items by their keyword and
bodies by their braces. Every file is parsed by itself; a file that can't be read is a row with an error.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rust keywords, which are no references.
KEYWORDS = frozenset(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type "
    "unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try".split()
)
# Names of primitive types, which are no references where they stand for a type.
PRIMITIVES = frozenset("u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool char str".split())
#: What stands before a type.
TYPED = re.compile(r"(?:(?<!:):|->|<|&|\bas)\s*(?:'\w+\s+)?(?:mut\s+|dyn\s+)?$")
KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "const": "const", "static": "static", "type": "type", "mod": "module"}
BODIES = frozenset(("function", "method", "struct", "enum", "trait", "impl", "macro"))
MOST_BYTES = 500
NOISE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|b?r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|b?'(?:\\.[^']*|[^'\\\n])'", re.DOTALL)
VIS = r"(?P<vis>pub(?:\s*\([^)]*\))?\s+)?"
ITEM = re.compile(
    rf"(?<![\w.]){VIS}(?:default\s+|async\s+|unsafe\s+|extern\s+(?:\"\s*\"\s+)?|const\s+(?=fn\b|async\b|unsafe\b))*"
    r"(?:(?P<key>fn|struct|enum|trait|const|static|type|mod)\s+(?:mut\s+)?(?P<name>[A-Za-z_]\w*)|(?P<impl>impl)\b|(?P<macro>macro_rules)\s*!\s*(?P<mname>[A-Za-z_]\w*))"
)
FIELD = re.compile(rf"(?:^|[{{,])\s*(?:#\s*\[[^\]]*\]\s*)*{VIS}(?P<name>[a-z_]\w*)\s*:(?!:)")
VARIANT = re.compile(r"(?:^|[{,])\s*(?:#\s*\[[^\]]*\]\s*)*(?P<name>[A-Z]\w*)")
WORD = re.compile(r"[A-Za-z_]\w*")

COLUMNS = ("file", "name", "kind", "line", "col", "byte_offset", "byte_length", "visibility", "parent", "signature", "doc_comment", "content", "error")
SCHEMA = "file string, name string, kind string, line int, col int, byte_offset long, byte_length long, visibility string, parent string, signature string, doc_comment string, content string, error string"
REF_SCHEMA = "name string, file string, line int, col int, byte_offset long, byte_length long, context string"


def blanked(code: str) -> str:
    """The code with comments and literals as spaces; newlines stay, and so do all positions."""
    return NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


class Places:
    def __init__(self, code: str):
        self.code = code
        self.starts = [0, *(m.end() for m in re.finditer("\n", code))]
        # Bytes before each character; None where they are its position.
        self.bytes = None if code.isascii() else [0, *accumulate(1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in code)]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def col(self, at: int) -> int:
        return self.byte(at) - self.byte(self.starts[self.line(at) - 1]) + 1

    def byte(self, at: int) -> int:
        return at if self.bytes is None else self.bytes[at]


def matching(code: str, at: int) -> int:
    """Position after the brace that closes the one at ``at``; the end if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def visibility(text: str | None) -> str:
    flat = re.sub(r"\s+", "", text or "")
    return flat if flat in ("pub", "pub(crate)", "pub(super)") else ""


def clipped(body: str) -> str:
    """The first 500 bytes on a character boundary; if cut, back to white space and dots."""
    data = body.encode()
    if len(data) <= MOST_BYTES:
        return body
    text = data[:MOST_BYTES].decode("utf-8", "ignore")
    space = max((i for i, c in enumerate(text) if c.isspace()), default=len(text))
    return text[:space].rstrip() + "..."


def docs_above(lines: list[str], line: int) -> str | None:
    """The /// lines over a line; attributes between are skipped, blank lines only before the first doc line from below."""
    out: list[str] = []
    for i in range(line - 2, -1, -1):
        t = lines[i].strip()
        if t.startswith("///"):
            out.append(t[3:].strip())
        elif t.startswith("#[") or (not t and not out):
            continue
        else:
            break
    return "\n".join(reversed(out)) or None


def symbols_of(path: str, code: str) -> list[tuple]:
    bare, at, lines = blanked(code), Places(code), code.split("\n")
    rows: list[tuple] = []

    def add(name: str, kind: str, start: int, end: int, vis: str, parent: str | None) -> None:
        body = clipped(code[start:end]) if kind in BODIES else None
        rows.append((path, name, kind, at.line(start), at.col(start), at.byte(start), at.byte(end) - at.byte(start), vis, parent, None, docs_above(lines, at.line(start)), body, None))

    impls: list[tuple[int, int, str]] = []
    for m in ITEM.finditer(bare):
        start = m.start()
        if m["impl"]:
            brace = bare.find("{", m.end())
            if brace < 0:
                continue
            head = re.sub(r"\bwhere\b.*", "", bare[m.end() : brace], flags=re.DOTALL)
            while "<" in head and (shorter := re.sub(r"<[^<>]*>", "", head)) != head:
                head = shorter
            target = WORD.findall(head.split(" for ")[-1].replace("::", " "))
            name = next((w for w in reversed(target) if w not in KEYWORDS), None)
            if name:
                end = matching(bare, brace)
                impls.append((brace, end, name))
                add(name, "impl", start, end, "", None)
            continue
        name = m["name"] or m["mname"]
        kind = "macro" if m["macro"] else KINDS[m["key"]]
        semi, brace = bare.find(";", m.end()), bare.find("{", m.end())
        flat = kind in ("const", "static", "type") or brace < 0 or (0 <= semi < brace)
        end = (semi + 1 if semi >= 0 else len(bare)) if flat else matching(bare, brace)
        vis = visibility(m["vis"])
        add(name, kind, start, end, vis, None)
        inside = next((n for a, b, n in reversed(impls) if a < start < b), None)
        if kind == "function" and inside:
            add(name, "method", start, end, vis, inside)
        if kind in ("struct", "enum") and not flat:
            body, depth, top = bare[brace + 1 : end - 1], 0, []
            for c in body:
                depth -= c in ")]}"
                top.append(c if depth == 0 and c not in ")]}" else "\n" if c == "\n" else " ")
                depth += c in "([{"
            for f in (FIELD if kind == "struct" else VARIANT).finditer("".join(top)):
                s = brace + 1 + f.start("name")
                add(f["name"], "field" if kind == "struct" else "variant", s, s + len(f["name"]), visibility(f.groupdict().get("vis")), name)
    module = []
    for line in lines:
        if line.strip().startswith("//!"):
            module.append(line.strip()[3:].strip())
        elif line.strip() or not module:
            break
    if module:
        stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
        rows.append((path, f"{stem}_docs", "doc", 1, 1, 0, 0, "", None, None, "\n".join(module), "\n".join(module), None))
    return rows


def references_of(path: str, code: str) -> list[tuple]:
    """Calls, types, field accesses and other identifiers; of several at one place the first in that order."""
    bare, at = blanked(code), Places(code)
    defined = {m.start("name") for m in ITEM.finditer(bare) if m["name"]}
    rows = []
    for m in WORD.finditer(bare):
        w, i, j = m[0], m.start(), m.end()
        if w in KEYWORDS or w in PRIMITIVES and bare[j : j + 2] != "::" or i in defined or (i and bare[i - 1] in "'0123456789"):
            continue
        after = re.match(r"\s*(?:::\s*<[^<>;(){}]*>)?\s*(\(|!)?", bare[j : j + 200])
        before = bare[max(0, i - 40) : i].rstrip()
        if after and after[1] == "(":
            context = "Call"
        elif after and after[1] == "!" and bare[j : j + 2] != "!=":
            continue
        elif before.endswith(".") and not before.endswith(".."):
            context = "FieldAccess"
        elif w[0].isupper() and (not w.isupper() or TYPED.search(bare[max(0, i - 40) : i])):
            context = "Type"
        else:
            context = "Identifier"
        rows.append((w, path, at.line(i), at.col(i), at.byte(i), len(w.encode()), context))
    return rows


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, content); a method has a row as function and one as method. Null content is a row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                rows += [(path, *[None] * 11, "unreadable")] if content is None else symbols_of(path, content)
            yield pd.DataFrame(rows, columns=list(COLUMNS))

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def references(files: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for path, content in zip(f["path"], f["content"], strict=True) if content is not None for r in references_of(path, content)]
            yield pd.DataFrame(rows, columns=["name", "file", "line", "col", "byte_offset", "byte_length", "context"])

    return files.select("path", "content").mapInPandas(run, REF_SCHEMA)


def once(refs: DataFrame) -> DataFrame:
    """One row for each name and place of a file: the first context in the order Call, Type, FieldAccess, Identifier."""
    order = F.array_position(F.array(*[F.lit(c) for c in ("Call", "Type", "FieldAccess", "Identifier")]), F.col("context"))
    w = Window.partitionBy("file", "name", "line", "col").orderBy(F.when(order == 0, 9).otherwise(order), "context")
    return refs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# TypeScript items by keyword.
TS_KINDS = {"function": "function", "class": "struct", "interface": "trait", "type": "type", "enum": "enum"}
TS_ITEM = re.compile(r"(?P<export>\bexport\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?\b(?P<key>function|class|interface|type|enum)\b\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)")
TS_ARROW = re.compile(r"(?P<export>\bexport\s+)?\bconst\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>")
TS_METHOD = re.compile(r"(?:^|[;}\n{])\s*(?P<vis>public\s+|private\s+|protected\s+)?(?:static\s+|async\s+|readonly\s+|get\s+|set\s+)*(?P<name>[A-Za-z_$#][\w$]*)\s*(?P<what>\(|[?!]?\s*[:=])")


def typescript_symbols_of(path: str, code: str) -> list[tuple]:
    bare, at = re.sub(r"`(?:\\.|[^`\\])*`", lambda m: re.sub(r"[^\n]", " ", m[0]), blanked(code)), Places(code)
    rows: list[tuple] = []

    def add(name: str, kind: str, start: int, vis: str, parent: str | None) -> None:
        rows.append((path, name, kind, at.line(start), at.col(start), at.byte(start), len(name.encode()), vis, parent, None, None, None, None))

    for m in TS_ITEM.finditer(bare):
        add(m["name"], TS_KINDS[m["key"]], m.start(), "pub" if m["export"] else "", None)
        brace = bare.find("{", m.end())
        if m["key"] != "class" or brace < 0:
            continue
        body, depth, top = bare[brace + 1 : matching(bare, brace) - 1], 0, []
        for c in body:
            depth -= c in ")]}"
            top.append(c if depth == 0 else "\n" if c == "\n" else " ")
            depth += c in "([{"
        for f in TS_METHOD.finditer("".join(top)):
            if f["name"] in ("if", "for", "while", "switch", "return", "catch"):
                continue
            if f["what"] == "(":
                add(f["name"], "method", brace + 1 + f.start("name"), "" if (f["vis"] or "").startswith("pr") else "pub", m["name"])
            elif not (f["vis"] or "").startswith("pr"):
                add(f["name"], "field", brace + 1 + f.start("name"), "pub", m["name"])
    for m in TS_ARROW.finditer(bare):
        add(m["name"], "function", m.start(), "pub" if m["export"] else "", None)
    return rows


def typescript_symbols(files: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for path, content in zip(f["path"], f["content"], strict=True) if content is not None for r in typescript_symbols_of(path, content)]
            yield pd.DataFrame(rows, columns=list(COLUMNS))

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def module_file(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, docs): mod declarations with the doc lines before them, and pub use re-exports. Inline modules are no declarations."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                docs: list[str] = []
                for n, line in enumerate((content or "").split("\n"), 1):
                    t = line.strip()
                    if t.startswith("///"):
                        docs.append(t[3:].strip())
                    elif m := re.fullmatch(r"(?:pub\s+)?mod\s+(\w+)\s*;", t):
                        rows.append((path, n, "mod", m[1], " ".join(docs)))
                        docs = []
                    elif m := re.fullmatch(r"pub\s+use\s+(.+?)\s*;", t):
                        rows.append((path, n, "use", m[1], ""))
                        docs = []
                    elif t:
                        docs = []
            yield pd.DataFrame(rows, columns=["path", "line", "kind", "name", "docs"])

    return files.select("path", "content").mapInPandas(run, "path string, line int, kind string, name string, docs string")
