"""Command line: index, search, goto, refs, symbols, stats, info, memory, serve."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame

from scoutline.plans.engine import Engine
from scoutline.plans.tools import Tools
from scoutline.session import local_session


def printed(df: DataFrame, wanted: bool = False) -> int:
    """Prints all rows, tab-separated below their names, as they come; 1 if rows are wanted and there are none."""
    n = 0
    for n, r in enumerate(df.toLocalIterator(), 1):
        if n == 1:
            print("\t".join(df.columns))
        print("\t".join("" if x is None else str(x).replace("\t", " ").replace("\n", "\\n") for x in r))
    if wanted and not n:
        print("nothing found", file=sys.stderr)
        return 1
    return 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="scoutline", description=__doc__)
    p.add_argument("--root", default=".")
    p.add_argument("--folder", default=".scoutline")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index")
    sub.add_parser("stats")
    sub.add_parser("serve", help="answer JSON-RPC lines")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--fuzzy", action="store_true")
    s.add_argument("--kind")
    s.add_argument("--full", action="store_true", help="with the code of each hit")
    for name in ("goto", "refs", "info"):
        c = sub.add_parser(name)
        c.add_argument("name")
        if name == "refs":
            c.add_argument("--include-definition", action="store_true")
        if name == "info":
            for part in ("code", "callers", "callees", "refs", "all"):
                c.add_argument(f"--{part}", action="store_true")
    s = sub.add_parser("symbols")
    s.add_argument("--file")
    s.add_argument("--kind")
    s = sub.add_parser("memory")
    s.add_argument("what", choices=("show", "search", "stats", "add"))
    s.add_argument("query", nargs="?", default="", help="words to search, or what was asked when adding")
    s.add_argument("--answer", default="")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--session")
    a = p.parse_args(args)
    import os

    e = Engine(local_session(), os.path.abspath(a.root), os.path.abspath(a.folder))
    if a.command == "index":
        print(e.index())
        return 0
    if a.command == "serve":
        for line in Tools(e).serve(sys.stdin):
            print(line, flush=True)
        return 0
    if a.command == "info":
        asked = {x for x in ("code", "callers", "callees", "refs") if getattr(a, x) or a.all} or {"callers", "callees", "refs"}
        for part, df in e.info(a.name, asked).items():
            print(part)
            printed(df)
        return 0
    if a.command == "memory" and a.what == "add":
        e.add(a.query, a.answer, a.session)
        return 0
    df = {
        "stats": lambda: e.stats(),
        "search": lambda: e.search(a.query, a.limit, a.fuzzy, a.kind, a.full),
        "goto": lambda: e.goto(a.name),
        "refs": lambda: e.references(a.name, a.include_definition),
        "symbols": lambda: e.list_symbols(a.file, a.kind),
        "memory": lambda: {"show": lambda: e.memory_recent(a.limit, a.session), "stats": e.memory_stats, "search": lambda: e.memory_search(a.query, a.limit)}[a.what](),
    }[a.command]()
    return printed(df, a.command in ("goto", "refs"))


if __name__ == "__main__":
    sys.exit(main())
