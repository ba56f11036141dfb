"""Discovery of candidates: spans of a source that states its totals, and a Python data source over recorded pages.

The planner is a pure function of the source's counts. One partition reads, so a source's request rate stays that of one client.
"""

from __future__ import annotations

import datetime as dt
import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: HTTP statuses worth another try.
RETRIED = frozenset([408, 425, 429, 500, 502, 503, 504])
SECOND = dt.timedelta(seconds=1)


class Span(NamedTuple):
    """A stretch of a source's time line, and how many candidates the source says it has."""

    first: dt.datetime
    last: dt.datetime
    found: int


@dataclass(frozen=True)
class Planner:
    """Cuts a time line into spans that a source can answer, from its own counts.

    ``closed``: the source counts both ends, so the next span begins a second later; else it leaves out the end. A span is
    cut in two while it holds more than ``most``, unless it is no longer than ``least``. The next span is as long as the last one;
    with ``thin`` (a share of ``most``) it doubles, up to ``longest``, after a span at or under that share, and halves after one at
    or over 1 - ``thin``.
    """

    most: int
    width: dt.timedelta
    least: dt.timedelta
    longest: dt.timedelta | None = None
    closed: bool = True
    thin: float = 0.25

    def spans(self, count: Callable[[dt.datetime, dt.datetime], int], since: dt.datetime, until: dt.datetime) -> Iterator[Span]:
        """All spans in order, empty ones as well. Ends that are still to be covered wait on a stack, the nearest on top."""
        gap = SECOND if self.closed else dt.timedelta()
        at, width, ends = since, self.width, []
        while at < until or (self.closed and at == until):
            ends.append(min(at + width, until))
            while True:
                span = Span(at, ends[-1], count(at, ends[-1]))
                length = span.last - span.first
                if span.found <= self.most or length <= self.least:
                    break
                ends.append(at + max(length / 2, self.least))
            width = self._next(max(length, SECOND), span.found)
            at = span.last + gap
            ends.clear()
            yield span

    def _next(self, length: dt.timedelta, found: int) -> dt.timedelta:
        if self.longest is None:
            return self.width
        share = found / self.most
        return min(length * 2, self.longest) if share <= self.thin else max(length / 2, self.least) if share >= 1 - self.thin else length


def within(rows: DataFrame, column: str, since: dt.datetime, until: dt.datetime) -> DataFrame:
    """Candidates inside the caller's own bounds, both included: a source that knows days or minutes only answers with more. Without a
    time a candidate stays."""
    return rows.where(F.col(column).isNull() | F.col(column).between(F.lit(since), F.lit(until)))


def pauses(draws: Iterator[float], first: float = 1.0, longest: float = 60.0) -> Iterator[float]:
    """Seconds to wait before each further try: half of a doubling time, and as much of the other half as is drawn."""
    time_ = first
    for draw in draws:
        yield min(time_, longest) * (1 + draw) / 2
        time_ *= 2


@dataclass(frozen=True)
class Retries:
    """When to ask a source again, and after how long: as long as it says, or by ``pauses``."""

    tries: int = 5
    seed: int = 0

    def schedule(self, answers: Iterator[tuple[int, float | None]]) -> Iterator[float]:
        """For a request's answers (status, seconds the source asks for) in order, the wait before each further try; ends with an answer
        that is final, or when the tries are used up."""
        draw = random.Random(self.seed)
        for (status, wish), own, _ in zip(answers, pauses(iter(draw.random, None)), range(self.tries)):
            if status not in RETRIED:
                return
            yield own if wish is None else wish


class Pace:
    """Evenly spaced requests of one client."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.step, self.clock, self.sleep, self.next = 1 / per_second, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.step


CANDIDATE = "source_id string, jurisdiction_code string, modified_at string, content_hash string, title string"


def store_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a URI, and the path in it; a plain path is a local one."""
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


def _page(folder: str, name: str) -> Iterator[tuple]:
    store, path = store_of(folder)
    with store.open_input_stream(f"{path}/{name}") as f:
        for line in f.read().decode("utf-8").splitlines():
            r = json.loads(line)
            yield tuple(r.get(c.split()[0]) for c in CANDIDATE.split(", "))


def _pages(folder: str) -> list[str]:
    store, path = store_of(folder)
    return sorted(f.base_name for f in store.get_file_info(pyarrow.fs.FileSelector(path)) if f.base_name.endswith(".jsonl"))


class RecordedSource(DataSource):
    """``spark.read.format("recorded_source").load(folder)``, and readStream: pages of recorded candidates, oldest first, from
    any store that Arrow reads."""

    @classmethod
    def name(cls) -> str:
        return "recorded_source"

    def schema(self) -> str:
        return CANDIDATE

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(self.options["path"])

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("pagesPerBatch", "1")))


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name in _pages(self.folder):
            yield from _page(self.folder, name)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, step: int):
        self.folder, self.step = folder, step

    def initialOffset(self) -> dict:
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"page": min(start["page"] + self.step, len(_pages(self.folder)))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The rows of a few pages; Spark sends this iterator between processes, so it is one over a list."""
        return iter([row for name in _pages(self.folder)[start["page"] : end["page"]] for row in _page(self.folder, name)])


def register(spark) -> None:
    spark.dataSource.register(RecordedSource)
