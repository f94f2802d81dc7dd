"""The tools that an assistant calls: code, memory, tickets, security issues and captured lists, each a function to a table.

Requests and answers are JSON-RPC lines. Tickets, issues and repository pages are tables of captured responses; there is no network code.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.operators import tickets as T
from scoutline.plans.engine import Engine
from scoutline.sources import project

#: Rows of an answer, at most, where the request does not say rows; more in the answer tells that there were others.
ROWS = 200


class Tools:
    """``tickets`` has the columns of a flattened ticket, ``issues`` those of a security issue; ``captured`` maps names of lists to their pages (page, body)."""

    def __init__(self, engine: Engine, tickets: DataFrame | None = None, issues: DataFrame | None = None, captured: dict[str, DataFrame] | None = None):
        e = engine
        # Names of the code and memory tools; below, error codes of JSON-RPC.
        self.tools: dict[str, Callable[..., DataFrame]] = {
            "code_search": lambda query, limit=10, fuzzy=False, kind=None: e.search(query, limit, fuzzy, kind),
            "code_goto": lambda name: e.goto(name),
            "code_refs": lambda name, include_definition=False: e.references(name, include_definition),
            "code_callers": lambda name: e.callers(name),
            "code_symbols": lambda file=None, kind=None: e.list_symbols(file, kind),
            # The first definition only.
            "code_info": lambda name: e.goto(name).orderBy("file", "line").limit(1),
            "code_stats": lambda: e.stats(),
            "memory_search": lambda query, limit=10: e.memory_search(query, limit),
            "memory_recent": lambda limit=10, session=None: e.memory_recent(limit, session),
            "memory_stats": lambda: e.memory_stats(),
        }
        if tickets is not None:
            self.tools |= {
                "tickets_search": lambda query="", assignee=None, project=None: T.filtered(tickets, query.lower(), assignee, project),
                "tickets_get": lambda key: tickets.where(F.col("key") == key),
                "tickets_projects": lambda: T.projects(tickets),
                "tickets_assignees": lambda: T.assignees(tickets),
                "tickets_board": lambda: T.board(tickets),
                "tickets_groups": lambda: T.groups(tickets),
            }
        if issues is not None:
            self.tools |= {
                "security_list": lambda limit=50, repo=None, type=None, severities=None: T.severity_list(T.security_filter(issues, repo, type, severities), limit),
                "security_summary": lambda: T.severity_summary(issues.where("status = 'open'")),
                "security_issue": lambda id: issues.where(F.col("id") == id),
                "security_repos": lambda: issues.where("status = 'open'").groupBy("repo").agg(F.count("*").alias("n")),
                "security_counts": lambda repo: T.severity_summary(T.security_filter(issues, repo)),
            }
        for name, pages in (captured or {}).items():
            self.tools[f"repo_{name}"] = lambda pages=pages: project.merged_pages(pages, "string").select("value")

    def call(self, name: str, /, **arguments: object) -> DataFrame:
        if name not in self.tools:
            raise ValueError(f"unknown tool {name}")
        return self.tools[name](**arguments)

    def answer(self, request: dict) -> dict | None:
        """The response to one request; None to a notification. What goes wrong is an error in the response."""
        if "id" not in request:
            return None
        out: dict = {"jsonrpc": "2.0", "id": request["id"]}
        try:
            method, params = request.get("method"), request.get("params") or {}
            if method == "initialize":
                return out | {"result": {"capabilities": {"tools": {}}, "serverInfo": {"name": "scoutline"}}}
            if method == "tools/list":
                return out | {"result": {"tools": [{"name": n} for n in sorted(self.tools)]}}
            if method != "tools/call":
                return out | {"error": {"code": -32601, "message": f"unknown method {method}"}}
            most = int(params.get("rows", ROWS))
            rows = self.call(params.get("name", ""), **(params.get("arguments") or {})).limit(most + 1).toJSON().collect()
            return out | {"result": {"content": [{"type": "text", "text": x} for x in rows[:most]], "more": len(rows) > most}}
        except (ValueError, TypeError) as wrong:
            return out | {"error": {"code": -32602, "message": str(wrong)}}

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        """Answers to lines of requests, in their order."""
        for line in lines:
            try:
                request = json.loads(line)
            except ValueError:
                yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}})
                continue
            if (answer := self.answer(request)) is not None:
                yield json.dumps(answer)
