"""Lists that a service gives page by page, as a batch source: a partition a resource, filters sent along with the request.

The source knows how pages follow each other, and nothing of networks: a transport is handed in, a function (resource, page, parameters) -> JSON text or
None. It runs in the tasks, so it has to be picklable. ``folder_transport`` reads captured pages from files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import parse_qsl, quote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

Transport = Callable[[str, str, dict[str, str]], str | None]

# Pages that are read of linked lists, and rows of a full page of numbered ones.
PAGES, PER_PAGE = 20, 20
SCHEMA = "resource string, page int, pos int, value string, more boolean"


class Wanted(InputPartition):
    def __init__(self, resource: str):
        super().__init__(resource)


def linked(fetch: Callable[[str], str | None], pages: int = PAGES) -> Iterator[tuple[int, list, bool]]:
    """(page, values, more) of pages that name the next one; more is set on the last page read if a further one was named.

    A page without a list of values counts as empty. What names a page that was read before ends the list.
    """
    at, seen = "", set()
    for n in range(pages):
        body = json.loads(fetch(at) or "{}")
        body = body if isinstance(body, dict) else {}
        seen.add(at)
        at = body.get("next") if isinstance(body.get("next"), str) else None
        values = body.get("values")
        ends = at is None or at in seen
        yield n, values if isinstance(values, list) else [], not ends and n + 1 == pages
        if ends:
            return


def numbered(fetch: Callable[[str], str | None], per_page: int = PER_PAGE, pages: int | None = None) -> Iterator[tuple[int, list, bool]]:
    """(page, values, more) of pages 0, 1, ... up to the first short one; more is set if ``pages`` of them were read and the last was full."""
    n = 0
    while pages is None or n < pages:
        values = json.loads(fetch(str(n)) or "[]")
        values = values if isinstance(values, list) else []
        full = len(values) >= per_page
        yield n, values, full and pages is not None and n + 1 == pages
        if not full:
            return
        n += 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], transport: Transport, sent: tuple[str, ...]):
        self.options, self.transport, self.sent = options, transport, sent
        self.resources = [r for r in options.get("resources", "").split("\n") if r]
        self.only: set[str] | None = None
        self.parameters: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """resource picks partitions. A field of value that the service filters by goes into the request; Spark applies it once more, as services differ in case."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("resource",):
                asked = {f.value} if isinstance(f, EqualTo) else {*f.value}
                self.only = asked if self.only is None else self.only & asked
            else:
                if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.sent and f.value is not None:
                    self.parameters.setdefault(f.attribute[0], str(f.value))
                yield f

    def partitions(self) -> list[Wanted]:
        return [Wanted(r) for r in self.resources if self.only is None or r in self.only]

    def read(self, partition: Wanted) -> Iterator[tuple]:
        fetch = lambda page: self.transport(partition.value, page, self.parameters)
        most = self.options.get("pages")
        if self.options.get("kind", "linked") == "linked":
            pages = linked(fetch, int(most or PAGES))
        else:
            pages = numbered(fetch, int(self.options.get("perPage", PER_PAGE)), int(most) if most else None)
        for n, values, more in pages:
            for i, v in enumerate(values):
                fields = [(v.get(c) if isinstance(v, dict) else None) for c in self.sent]
                yield (partition.value, n, i, json.dumps(v, ensure_ascii=False), more and i + 1 == len(values), *[None if x is None else str(x) for x in fields])


def paged_source(name: str, transport: Transport, sent: tuple[str, ...] = ()) -> type[DataSource]:
    """A data source over a transport. ``sent`` are string fields of the values that become columns, and parameters of the request where a filter asks for one value."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA + "".join(f", {c} string" for c in sent)

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader({**self.options}, transport, sent)

    return Paged


def read_pages(spark: SparkSession, source: type[DataSource], resources: list[str], kind: str = "linked", pages: int | None = None, per_page: int = PER_PAGE) -> DataFrame:
    """(resource, page, pos, value, more, sent fields): values of each resource as JSON text, in order of page and pos; more marks the last one of a list that was not read to its end."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    named = {"kind": kind, "perPage": str(per_page), "resources": "\n".join(resources)} | ({"pages": str(pages)} if pages else {})
    return spark.read.format(source.name()).options(**{k.lower() if k == "resources" else k: v for k, v in named.items()}).load()


class folder_transport:  # noqa: N801
    """Captured pages under a folder that all tasks see: <resource>/<page>.json, the first page of a linked list being first.json.

    A page address is a file name, or a URL of which the parameter page is one. Parameters look for <page>.<name>=<value>.json first.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, resource: str, page: str, parameters: dict[str, str]) -> str | None:
        name = dict(parse_qsl(urlsplit(page).query)).get("page", page) or "first"
        base = Path(self.folder) / quote(resource, safe="")
        marks = "".join(f".{k}={quote(v, safe='')}" for k, v in sorted(parameters.items()))
        for f in (base / f"{quote(name, safe='')}{marks}.json", base / f"{quote(name, safe='')}.json"):
            if f.exists():
                return f.read_text()
        return None
