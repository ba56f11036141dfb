"""Sources that are asked: a polite client, the pages of a walk as a data source, the versions of a document.

A transport answers one request; a client spaces requests evenly, asks again where that helps, and says how it ended. ``Http`` is a
transport over the network, ``Replayed`` one over recorded answers. What cannot be had is a row with an error, never an exception:
the rest of the run goes on, and the checkpoint is held back by that row.
"""

from __future__ import annotations

import datetime as dt
import email.utils
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple, Protocol

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexmill.sources import markup
from lexmill.sources.discovery import RETRIED, Pace, Retries, store_of

#: HTTP statuses that say a document is not there.
MISSING = frozenset([404, 410])


class Answer(NamedTuple):
    status: int
    body: str | None = None
    retry_after: float | None = None
    content_type: str | None = None


class Transport(Protocol):
    def get(self, address: str, language: str | None = None) -> Answer: ...


@dataclass(frozen=True)
class Http:
    """Requests below a base address. A source that cannot be reached answers as one that is out of service."""

    base: str
    agent: str = "lexmill"
    timeout: float = 30.0

    def get(self, address: str, language: str | None = None) -> Answer:
        headers = {"User-Agent": self.agent} | ({"Accept-Language": language.lower()} if language else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.base.rstrip("/") + "/" + address, headers=headers), timeout=self.timeout) as r:
                return Answer(r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), None, r.headers.get("Content-Type"))
        except urllib.error.HTTPError as e:
            return Answer(e.code, None, _wish(e.headers.get("Retry-After")), e.headers.get("Content-Type"))
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            return Answer(503)


def _wish(value: str | None, now: Callable[[], float] = time.time) -> float | None:
    """Seconds that a Retry-After header asks for: a number, or a date."""
    if value is None:
        return None
    if value.strip().isdigit():
        return float(value)
    try:
        return max(0.0, email.utils.parsedate_to_datetime(value).timestamp() - now())
    except (TypeError, ValueError):
        return None


class Replayed:
    """Recorded answers by (address, language), given in turn; the last one stays. An address without a record is missing."""

    def __init__(self, records: Iterable[tuple[str, str | None, Answer]]):
        self.answers: dict[tuple[str, str | None], list[Answer]] = {}
        for address, language, answer in records:
            self.answers.setdefault((address, language), []).append(answer)

    def get(self, address: str, language: str | None = None) -> Answer:
        left = self.answers.get((address, language), [Answer(404)])
        return left.pop(0) if len(left) > 1 else left[0]


class Outcome(NamedTuple):
    """kind: fetched, missing or broken."""

    kind: str
    answer: Answer
    requests: int
    waited: float


class Client:
    """Evenly spaced requests with further tries. A wait beyond ``patience`` seconds ends a request as broken."""

    def __init__(self, transport: Transport, pace: Pace, retries: Retries = Retries(), patience: float = 900.0, sleep: Callable[[float], None] = time.sleep):
        self.transport, self.pace, self.retries, self.patience, self.sleep = transport, pace, retries, patience, sleep

    def get(self, address: str, language: str | None = None) -> Outcome:
        seen: list[Answer] = []

        def answers() -> Iterator[tuple[int, float | None]]:
            while True:
                self.pace.wait()
                seen.append(self.transport.get(address, language))
                yield seen[-1].status, seen[-1].retry_after

        waited = 0.0
        for wait in self.retries.schedule(answers()):
            if wait > self.patience:
                break
            waited += wait
            self.sleep(wait)
        last = seen[-1]
        kind = "fetched" if 200 <= last.status < 300 else "broken" if last.status in RETRIED else "missing"
        return Outcome(kind, last, len(seen), waited)


# ---- pages of a walk ------------------------------------------------------------------------------------------------


def page_address(first: Column | str, last: Column | str, offset: Column | int, size: int):
    """Address of a page of a span: texts for a request, columns for a table of recorded answers."""
    if isinstance(first, str):
        return f"feed?modified={first}&modified={last}&max={size}&from={offset}&sort=ASC"
    text = F.concat(F.lit("feed?modified="), first, F.lit("&modified="), last, F.lit(f"&max={size}&from="), offset.cast("string"), F.lit("&sort=ASC"))
    return text


STAMP = "%Y-%m-%dT%H:%M:%SZ"
SPARK_STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"
PAGE = "stretch bigint, place int, page int, position int, source_id string, title string, modified_at string, source_url string, requests int, error string"
ANSWERS = "stretch bigint, address string, attempt int, status int, retry_after double, body string"


def _table(uri: str, columns: list[str], stretch: int) -> pa.Table:
    """Rows of one stretch of a Parquet table partitioned by stretch, from any store that Arrow reads."""
    store, path = store_of(uri)
    folder = f"{path}/stretch={stretch}"
    if store.get_file_info(folder).type == pyarrow.fs.FileType.NotFound:
        return pa.table({c: [] for c in columns})
    return pyarrow.dataset.dataset(folder, filesystem=store, format="parquet").to_table(columns=columns)


class WalkSource(DataSource):
    """``spark.read.format("walk_source")``: the entries of every page of planned spans.

    Options: spans (URI of a table of spans partitioned by stretch), answers (URI of recorded answers, partitioned likewise) or base (address of
    a feed), stretches (how many), lanes (how many readers; each has its share of the rate), per_second, page_size, tries, seed,
    sleep (false: waits are told, not waited). A partition is a lane, that is a set of stretches; spans are read where they are needed. Spans
    in which nothing was found are not asked for.
    """

    @classmethod
    def name(cls) -> str:
        return "walk_source"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema: object) -> DataSourceReader:
        return _Pages(dict(self.options))


class Lane(InputPartition):
    def __init__(self, number: int, stretches: list[int]):
        super().__init__(number)
        self.stretches = stretches


class _Pages(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.lanes = int(options.get("lanes", "1"))

    def partitions(self) -> list[InputPartition]:
        stretches = int(self.options["stretches"])
        return [Lane(i, list(range(i, stretches, self.lanes))) for i in range(min(self.lanes, stretches))]

    def _client(self, stretch: int) -> Client:
        o = self.options
        sleep = (lambda _: None) if o.get("sleep", "true") == "false" else time.sleep
        retries = Retries(int(o.get("tries", "5")), int(o.get("seed", "0")))
        pace = Pace(float(o.get("per_second", "2")) / self.lanes, sleep=sleep)
        if "base" in o:
            return Client(Http(o["base"]), pace, retries, sleep=sleep)
        rows = _table(o["answers"], ["address", "attempt", "status", "retry_after", "body"], stretch).to_pylist()
        rows.sort(key=lambda r: r["attempt"])
        return Client(Replayed((r["address"], None, Answer(r["status"], r["body"], r["retry_after"])) for r in rows), pace, retries, sleep=sleep)

    def read(self, partition: Lane) -> Iterator[tuple]:
        size = int(self.options.get("page_size", "1000"))
        client = None
        for stretch in partition.stretches:
            client = client if client is not None and "base" in self.options else self._client(stretch)
            spans = _table(self.options["spans"], ["place", "first", "last", "found"], stretch).to_pylist()
            for s in sorted((s for s in spans if s["found"]), key=lambda s: s["place"]):
                first, last = s["first"].strftime(STAMP), s["last"].strftime(STAMP)
                for page in range(-(-s["found"] // size)):
                    got = client.get(page_address(first, last, page * size, size))
                    feed = markup.feed_entries(got.answer.body) if got.kind == "fetched" else None
                    key = (stretch, s["place"], page)
                    if feed is None:
                        yield *key, None, None, None, None, None, got.requests, f"{got.kind}: {got.answer.status}" if got.kind != "fetched" else "unreadable"
                        continue
                    for i, e in enumerate(feed["entries"]):
                        yield *key, i, e["id"], e["title"], e["updated"], e["link"], got.requests, None


def register(spark) -> None:
    spark.dataSource.register(WalkSource)


# ---- versions of a document -----------------------------------------------------------------------------------------

RECORDED = "array<struct<address: string, language: string, status: int, retry_after: double, content_type: string, body: string>>"
VERSION = "source_id string, language string, selected_as string, payload string, format string, source_url string, requests int, error string"


def _chosen(client: Client, address: str, preferred: list[str], fallbacks: list[dict]) -> Iterator[tuple]:
    """The versions of one document: all preferred ones that can be had; without any, the first fallback that can. If none can, and
    the source failed on one, an error; if the source has none, a row without language, as the document is known all the same."""
    broken, found, requests = [], False, 0
    for language, reason in [*((x, "preferred") for x in preferred), *((x["language"], x["reason"]) for x in fallbacks)]:
        if found and reason != "preferred":
            break
        got = client.get(address, language)
        requests += got.requests
        if got.kind == "fetched":
            found = True
            yield language, reason, got.answer.body, got.answer.content_type, got.requests, None
        elif got.kind == "broken":
            broken.append(language)
    if not found:
        yield None, None, None, None, requests, f"every language version failed: {', '.join(broken)}" if broken else None


def versions(plans: DataFrame, transport: Transport | None = None, lanes: int = 1, per_second: float = 2.0, retries: Retries = Retries(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Carries out language plans. plans: source_id, address, plan (struct<preferred, fallbacks>), and, without a ``transport``, recorded (its
    answers, in order). Returns source_id, language, selected_as, payload, format, source_url, requests, error.

    With a transport its requests are dealt to ``lanes`` tasks, each with its share of the rate. A plan without languages gives a row
    without language; rows that repeat are asked for again; null plans and addresses count as plans without languages.
    """
    if transport is not None:
        plans = plans.repartition(lanes, "source_id")
    columns = ["source_id", "address", "plan", *(["recorded"] if transport is None else [])]
    share = per_second / lanes
    idle = transport is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = (lambda _: None) if idle else sleep
        pace = Pace(share, sleep=wait)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = transport or Replayed((x["address"], x["language"], Answer(x["status"], x["body"], x["retry_after"], x["content_type"])) for x in r["recorded"] or [])
                plan = r["plan"] or {}
                languages = (plan.get("preferred") or [], plan.get("fallbacks") or []) if r["address"] else ([], [])
                out += [(r["source_id"], *v[:4], r["address"], *v[4:]) for v in _chosen(Client(own, pace, retries, sleep=wait), r["address"], *languages)]
            names = ("source_id", "language", "selected_as", "payload", "content_type", "source_url", "requests", "error")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "requests" else pa.string()) for n, c in zip(names, zip(*out) if out else [[]] * len(names))], list(names))

    raw = "source_id string, language string, selected_as string, payload string, content_type string, source_url string, requests int, error string"
    got = plans.select(*columns).mapInArrow(run, raw)
    shape = F.when(F.col("language").isNotNull(), markup.media_format(F.col("content_type")))
    return got.select("source_id", "language", "selected_as", "payload", shape.alias("format"), "source_url", "requests", "error")
