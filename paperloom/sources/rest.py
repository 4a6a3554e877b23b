"""A paged REST source of work records, as a Spark data source with one partition for each query.

A query's pages are a chain of cursors and so are read one after another, the queries side by side. Year bounds go to the server.
"""

from __future__ import annotations

import csv
import hashlib
import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: What is asked of the service, and answers that are worth another try.
FIELDS = "id,doi,display_name,publication_year,cited_by_count,abstract_inverted_index,authorships,primary_location"
RETRY_STATUS = {408, 429, *range(500, 600)}
PAGE = 100
FAILED = {"request_failed", "response_invalid", "invalid_parameters", "missing_api_key"}

Get = Callable[[str, float], tuple[int, dict, bytes]]


def http_get(url: str, timeout: float) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


@dataclass
class FetchResult:
    works: list[dict] = field(default_factory=list)
    stop_reason: str = ""
    pages: int = 0
    requests: int = 0
    retries: int = 0
    duplicates: int = 0


def year_filter(from_year: int | None, to_year: int | None) -> str:
    parts = []
    if from_year is not None:
        parts.append(f"from_publication_date:{from_year}-01-01")
    if to_year is not None:
        parts.append(f"to_publication_date:{to_year}-12-31")
    return ",".join(parts)


def backoff(attempt: int, base: float, most: float, retry_after: str | None) -> float:
    """Seconds to wait: what the server names, else a doubling; never more than ``most``."""
    try:
        wait = float(retry_after) if retry_after is not None else base * 2**attempt
    except ValueError:
        wait = base * 2**attempt
    return min(most, max(0.0, wait)) if math.isfinite(wait) else most


def check_arguments(keyword: object, max_results: object, from_year: object, to_year: object, timeout: object, max_retries: object) -> str:
    """What is wrong with the arguments; empty if nothing is. A boolean is no number."""
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    if not isinstance(keyword, str) or not keyword.strip():
        return "keyword"
    if not whole(max_results) or max_results <= 0:
        return "max_results"
    if not whole(max_retries) or max_retries < 0:
        return "max_retries"
    if isinstance(timeout, bool) or not isinstance(timeout, (int, float)) or not math.isfinite(timeout) or timeout <= 0:
        return "timeout"
    for name, year in (("from_year", from_year), ("to_year", to_year)):
        if year is not None and (not whole(year) or not 1000 <= year <= 9999):
            return name
    return "year order" if from_year is not None and to_year is not None and from_year > to_year else ""


def fetch(
    base_url: str, keyword: str, max_results: int = 20, *, from_year: int | None = None, to_year: int | None = None, timeout: float = 20, max_retries: int = 3,
    backoff_base: float = 1, backoff_most: float = 30, api_key: str | None = None, need_key: bool = False, get: Get = http_get, sleep: Callable[[float], None] = time.sleep,
) -> FetchResult:
    """Works of one query, each id once, and why it stopped."""
    out = FetchResult()
    if check_arguments(keyword, max_results, from_year, to_year, timeout, max_retries):
        out.stop_reason = "invalid_parameters"
        return out
    if need_key and not api_key:
        out.stop_reason = "missing_api_key"
        return out
    cursor, seen = "*", set()
    while True:
        left = max_results - len(out.works)
        asked = {"search": keyword, "per_page": max(1, min(PAGE, left)), "cursor": cursor, "select": FIELDS}
        if bounds := year_filter(from_year, to_year):
            asked["filter"] = bounds
        if api_key:
            asked["api_key"] = api_key
        body, failure = _page(f"{base_url}?{urllib.parse.urlencode(asked)}", out, timeout, max_retries, backoff_base, backoff_most, get, sleep)
        if body is None:
            out.stop_reason = failure
            return out
        works, meta = body.get("results"), body.get("meta")
        if not isinstance(works, list) or not isinstance(meta, dict):
            out.stop_reason = "response_invalid"
            return out
        out.pages += 1
        for w in works:
            key = w.get("id")
            if key and key in seen:
                out.duplicates += 1
                continue
            seen.add(key)
            out.works.append(w)
            if len(out.works) >= max_results:
                out.stop_reason = "max_results_reached"
                return out
        after = meta.get("next_cursor")
        if not works:
            out.stop_reason = "results_exhausted"
        elif not after:
            out.stop_reason = "cursor_exhausted"
        elif after == cursor:
            out.stop_reason = "cursor_stalled"
        if out.stop_reason:
            return out
        cursor = after


def fetch_page(base_url: str, keyword: str, max_results: int = 20, *, timeout: float = 20, api_key: str | None = None, get: Get = http_get) -> list[dict]:
    """The works of a single page of 1 to 100, without cursor or retries; a failure is an error."""
    if wrong := check_arguments(keyword, max_results, None, None, timeout, 0):
        raise ValueError(wrong)
    asked = {"search": keyword, "per_page": max(1, min(PAGE, max_results)), "select": FIELDS} | ({"api_key": api_key} if api_key else {})
    out = FetchResult()
    body, failure = _page(f"{base_url}?{urllib.parse.urlencode(asked)}", out, timeout, 0, 0, 0, get, time.sleep)
    if body is None or not isinstance(body.get("results"), list):
        raise RuntimeError(failure or "response_invalid")
    return body["results"][:max_results]


def query_identity(asked: dict) -> str:
    """Twelve digits that tell a query, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(asked, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:12]


def write_summary(found: FetchResult, asked: dict, path: str) -> dict:
    """One row about a fetch as a CSV file that appears under its name when it is whole."""
    row = {"query_id": query_identity(asked), **asked, "records": len(found.works), "pages": found.pages, "requests": found.requests, "retries": found.retries, "duplicates": found.duplicates, "stop_reason": found.stop_reason}
    part = Path(f"{path}.part")
    with part.open("w", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, list(row), lineterminator="\n")
        out.writeheader()
        out.writerow({k: "" if v is None else v for k, v in row.items()})
    part.replace(path)
    return row


def _page(url: str, out: FetchResult, timeout: float, max_retries: int, base: float, most: float, get: Get, sleep: Callable[[float], None]) -> tuple[dict | None, str]:
    for attempt in range(max_retries + 1):
        after, failure = None, "request_failed"
        out.requests += 1
        try:
            status, headers, raw = get(url, timeout)
        except (TimeoutError, OSError):
            status = 0
        else:
            if status == 200:
                try:
                    body = json.loads(raw)
                    if isinstance(body, dict):
                        return body, ""
                except ValueError:
                    pass
                failure = "response_invalid"
            elif status not in RETRY_STATUS:
                return None, "request_failed"
            after = {k.lower(): v for k, v in headers.items()}.get("retry-after")
        if attempt < max_retries:
            out.retries += 1
            sleep(backoff(attempt, base, most, after))
    return None, failure


@dataclass
class QueryPartition(InputPartition):
    query_id: str
    keyword: str


class WorksReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.bounds: dict[str, int] = {k: int(options[k]) for k in ("from_year", "to_year") if options.get(k)}

    def pushFilters(self, filters):  # noqa: N802
        """Year bounds go to the server, the narrower of the options' and the filters'; Spark applies all of them again."""
        for f in filters:
            name, value = type(f).__name__, getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("publication_year",) and isinstance(value, int):
                if name in ("GreaterThanOrEqual", "GreaterThan", "EqualTo"):
                    self.bounds["from_year"] = max(self.bounds.get("from_year", value), value + (name == "GreaterThan"))
                if name in ("LessThanOrEqual", "LessThan", "EqualTo"):
                    self.bounds["to_year"] = min(self.bounds.get("to_year", value), value - (name == "LessThan"))
            yield f

    def partitions(self) -> list[QueryPartition]:
        return [QueryPartition(k, v) for k, v in json.loads(self.options["queries"]).items()]

    def read(self, partition: QueryPartition) -> Iterator[tuple]:
        low, high = self.bounds.get("from_year"), self.bounds.get("to_year")
        if low is not None and high is not None and low > high:
            return
        found = fetch(self.options["url"], partition.keyword, int(self.options.get("max_results", "20")), api_key=self.options.get("api_key"), **self.bounds)
        # Pages before a failure are no whole scan.
        if found.stop_reason in FAILED:
            raise RuntimeError(f"{partition.query_id}: {found.stop_reason} after {found.pages} pages")
        for i, w in enumerate(found.works):
            yield partition.query_id, i, w.get("publication_year"), json.dumps(w, ensure_ascii=False)


def page_at(options: dict, keyword: str, cursor: str, rows: int, select: str = FIELDS, get: Get = http_get) -> tuple[list[dict], str | None]:
    """(works, the next cursor or None) of the page at a cursor before which a query has had so many rows; a failure is an error."""
    left = int(options.get("max_results", "1000000000")) - rows
    if left <= 0:
        return [], None
    asked = {"search": keyword, "per_page": min(int(options.get("per_page", PAGE)), left), "cursor": cursor, "select": select}
    years = {k: int(options[k]) for k in ("from_year", "to_year") if options.get(k)}
    if bounds := year_filter(years.get("from_year"), years.get("to_year")):
        asked["filter"] = bounds
    if options.get("api_key"):
        asked["api_key"] = options["api_key"]
    body, failure = _page(f"{options['url']}?{urllib.parse.urlencode(asked)}", FetchResult(), 20, int(options.get("max_retries", "3")), float(options.get("backoff", "1")), 30, get, time.sleep)
    if body is None or not isinstance(body.get("results"), list) or not isinstance(body.get("meta"), dict):
        raise RuntimeError(failure or "response_invalid")
    works, after = body["results"], body["meta"].get("next_cursor")
    return works, after if works and after and after != cursor and len(works) < left else None


@dataclass
class PagesPartition(InputPartition):
    query_id: str
    keyword: str
    start: dict
    end: dict


class WorksStreamReader(DataSourceStreamReader):
    """A stream of pages: the offset is each query's cursor and the rows before it, so a restarted stream goes on where it was.

    A batch is the next page of each query that has one. To know where it ends, the driver asks for the page's ids alone; the works
    are read by the tasks, a partition for each query.
    """

    def __init__(self, options: dict):
        self.options = dict(options)
        self.queries: dict[str, str] = json.loads(self.options["queries"])
        self.at: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {q: {"cursor": "*", "rows": 0} for q in sorted(self.queries)}

    def latestOffset(self) -> dict:  # noqa: N802
        ends = {}
        for q, at in (self.at or self.initialOffset()).items():
            if at["cursor"] is not None:
                ids, after = page_at(self.options, self.queries[q], at["cursor"], at["rows"], "id")
                at = {"cursor": after, "rows": at["rows"] + len(ids)}
            ends[q] = at
        self.at = ends
        return ends

    def partitions(self, start: dict, end: dict) -> list[PagesPartition]:
        # A restarted query first plans the last batch that it has noted.
        self.at = self.at or end
        return [PagesPartition(q, self.queries[q], start[q], end[q]) for q in end if start[q] != end[q]]

    def read(self, partition: PagesPartition) -> Iterator[tuple]:
        cursor, rows = partition.start["cursor"], partition.start["rows"]
        while cursor is not None and rows < partition.end["rows"]:
            works, cursor = page_at(self.options, partition.keyword, cursor, rows)
            for i, w in enumerate(works):
                yield partition.query_id, rows + i, w.get("publication_year"), json.dumps(w, ensure_ascii=False)
            rows += len(works)
        if rows != partition.end["rows"]:
            raise RuntimeError(f"{partition.query_id}: the pages have changed")

    def commit(self, end: dict) -> None:
        self.at = self.at or end


class WorksSource(DataSource):
    """Options: url, queries (JSON of id: keyword), max_results, from_year, to_year, api_key; for streams also per_page, max_retries, backoff."""

    @classmethod
    def name(cls) -> str:
        return "scholarly_works"

    def schema(self) -> str:
        return "query_id string, at int, publication_year int, work string"

    def reader(self, schema) -> DataSourceReader:
        return WorksReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return WorksStreamReader(self.options)


def works_stream(spark: SparkSession, url: str, queries: dict[str, str], **options: object) -> DataFrame:
    """The works of queries as a stream, each id once a query, which the stream's state remembers; works without an id all stay."""
    register(spark)
    pages = spark.readStream.format(WorksSource.name()).options(url=url, queries=json.dumps(queries), **{k: str(v) for k, v in options.items()}).load()
    found = F.get_json_object("work", "$.id")
    key = F.when(F.coalesce(found, F.lit("")) == "", F.concat(F.lit("#"), F.col("at").cast("string"))).otherwise(F.concat(F.lit("="), found))
    return pages.withColumn("work_key", key).dropDuplicates(["query_id", "work_key"]).drop("work_key")


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorksSource)
