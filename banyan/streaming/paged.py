"""Paged sources with cursors as streaming data sources.

``fetch(query, cursor)`` returns (status, rows, next cursor); statuses are ok,
exhausted, rate_limited, out_of_credits and error.

``PagedReader`` reads one query in the driver, for a few rows.  ``PagesReader``
reads many queries in the executors: a batch has one partition a query, of a
number of its pages, and no row passes the driver.  Where a page ends is known
only to who reads it, so the task that reads a query's pages leaves the cursor
after each of them, and how the query stands, as small files in the shared
folder; offsets are numbers of pages by query.  A batch that runs again starts
from the cursor of its first page, and pages that were read before have theirs,
so it reads the same pages.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

Fetch = Callable[[str, str], tuple[str, list[tuple], str]]


def patient(fetch: Fetch, retries: int = 2, pause: float = 15.0) -> Fetch:
    """Asks again, after a pause, where the rate was limited."""

    def f(query: str, cursor: str):
        for k in range(retries + 1):
            status, rows, following = fetch(query, cursor)
            if status != "rate_limited" or k == retries:
                return status, rows, following
            time.sleep(pause)

    return f


class PagedReader(SimpleDataSourceStreamReader):
    """pages: fetched a batch at most; rounds: the source ends after so many batches in a row without rows."""

    def __init__(self, fetch: Fetch, query: str, pages: int, rounds: int = 6):
        self.fetch, self.query, self.pages, self.rounds = fetch, query, pages, rounds

    def initialOffset(self) -> dict:
        return {"cursor": "", "done": False, "empty": 0}

    def read(self, start: dict):
        rows, at, done, empty = [], start["cursor"], start["done"], start.get("empty", 0)
        for _ in range(self.pages):
            if done:
                break
            status, found, following = self.fetch(self.query, at)
            if status == "ok" or found:
                rows += found
                at = following or at
            done = status in ("exhausted", "out_of_credits") or not following
            if status != "ok":
                break
        empty = 0 if rows else empty + 1
        return iter(rows), {"cursor": at, "done": done or empty >= self.rounds, "empty": empty}

    def readBetweenOffsets(self, start: dict, end: dict):
        """The same pages again after a failure."""
        rows, at = [], start["cursor"]
        while at != end["cursor"] or end["done"]:
            status, found, following = self.fetch(self.query, at)
            rows += found
            if status != "ok" or not following or following == end["cursor"] and not end["done"]:
                break
            at = following
        return iter(rows)


def paged_source(name: str, schema: str, fetch: Fetch) -> type[DataSource]:
    """A data source class to register with spark.dataSource.register; options: query, pages a batch."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def simpleStreamReader(self, schema):  # noqa: ARG002
            return PagedReader(fetch, self.options.get("query", ""), int(self.options.get("pages", "10")))

    return Paged


class Notes:
    """What tasks leave behind for a query: the cursors before its pages, and how it stands. base: a folder that all executors share, of any file system that pyarrow knows."""

    def __init__(self, base: str):
        from pyarrow import fs

        self.system, self.base = fs.FileSystem.from_uri(base) if "://" in base or base.startswith("file:") else (fs.LocalFileSystem(), base)

    def path(self, query: str, name: str) -> str:
        return f"{self.base}/{quote(query, safe='')}/{name}"

    def read(self, query: str, name: str) -> dict | None:
        try:
            with self.system.open_input_stream(self.path(query, name)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def write(self, query: str, name: str, value: dict) -> None:
        """Whole or not at all."""
        self.system.create_dir(self.path(query, ""), recursive=True)
        aside = self.path(query, f"{name}.{time.time_ns()}")
        with self.system.open_output_stream(aside) as f:
            f.write(json.dumps(value).encode())
        self.system.move(aside, self.path(query, name))


@dataclass
class Pages(InputPartition):
    """Pages first to last, without last, of a query."""

    query: str
    first: int
    last: int


class PagesReader(DataSourceStreamReader):
    """Many queries, each with a partition of its own.

    pages: of a query in a batch at most; total: of all queries in a batch at
    most, dealt evenly; pause: seconds that a query rests after its rate was
    limited; rounds: a query ends after so many pages in a row without rows.
    A query that is exhausted, fails or has no credit left ends by itself.
    """

    def __init__(self, fetch: Fetch, queries: list[str], notes: str, pages: int = 10, total: int = 1000, pause: float = 15.0, rounds: int = 6):
        self.fetch, self.queries, self.notes = fetch, list(dict.fromkeys(queries)), notes
        self.pages, self.total, self.pause, self.rounds = pages, total, pause, rounds
        self.planned: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {q: 0 for q in self.queries}

    def latestOffset(self) -> dict:
        """For each query that goes on the pages that its next partition may read; for the others where they stand."""
        notes, out, open_ = Notes(self.notes), {}, []
        for q in self.queries:
            state = notes.read(q, "state") or {"pages": 0, "done": False, "until": 0.0}
            out[q] = max(state["pages"], self.planned.get(q, 0) if state["done"] else 0)
            if not state["done"] and time.time() >= state["until"]:
                open_.append(q)
        share = max(1, self.total // max(1, len(open_)))
        for q in open_[: self.total]:
            out[q] += min(self.pages, share)
        self.planned = {q: max(n, self.planned.get(q, 0)) for q, n in out.items()}
        return self.planned

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return [Pages(q, start.get(q, 0), n) for q, n in end.items() if n > start.get(q, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        notes, q = Notes(self.notes), partition.query
        # pages are numbered as they are planned; where a batch read fewer, the next one goes on from its cursor
        at = notes.read(q, f"start-{partition.first}") or notes.read(q, "state") or {"cursor": "", "empty": 0}
        if notes.read(q, f"start-{partition.first}") is None:
            notes.write(q, f"start-{partition.first}", {"cursor": at["cursor"], "empty": at["empty"], "done": at.get("done", False)})
        cursor, empty, done, until = at["cursor"], at["empty"], at.get("done", False), 0.0
        for _ in range(partition.first, partition.last):
            if done:
                break
            status, rows, following = self.fetch(q, cursor)
            yield from rows
            if status == "rate_limited":
                until = time.time() + self.pause
                break
            empty = 0 if rows else empty + 1
            done = status != "ok" or not following or empty >= self.rounds
            cursor = following or cursor
        notes.write(q, f"start-{partition.last}", {"cursor": cursor, "empty": empty, "done": done})
        notes.write(q, "state", {"pages": partition.last, "cursor": cursor, "empty": empty, "done": done, "until": until})


def pages_source(name: str, schema: str, fetch: Fetch) -> type[DataSource]:
    """A data source class to register with spark.dataSource.register; options: queries (a JSON list), notes (a shared folder), pages, total, pause and rounds."""

    class PagesOf(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema):  # noqa: ARG002
            o = self.options
            return PagesReader(fetch, json.loads(o["queries"]), o["notes"], int(o.get("pages", "10")), int(o.get("total", "1000")), float(o.get("pause", "15")), int(o.get("rounds", "6")))

    return PagesOf
