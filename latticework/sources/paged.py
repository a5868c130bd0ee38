"""A partitioned data source for the landed answers of a paged, keyed interface."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Readers travel to executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: One row for each result, and one with row = null for each page without any.
SCHEMA = "batch int, year int, page string, attempts int, waited double, row string"
# Attempts at a page; seconds added to what a server asks for, and the most it may ask for; seconds for
# each attempt made so far if it asks for nothing, and the most of these.
ATTEMPTS, ASKED_MORE, ASKED_MOST, STEP, STEP_MOST = 8, 2, 3700, 30, 300
#: Answers that mean "later".
LATER = (429, 503)


def waiting_time(attempt: int, retry_after: object) -> float:
    """Seconds to wait after a failed attempt (from 0): what the server asks for, else longer with every attempt."""
    asked = str(retry_after or "")
    return min(int(asked) + ASKED_MORE, ASKED_MOST) if asked.isdigit() else min(STEP * (attempt + 1), STEP_MOST)


def landed_answers(folder: str) -> Callable[[int, int, str, int], dict | None]:
    """fetch for answers that lie as <folder>/batch=<b>/year=<y>/page=<p>/<any file>: lines of JSON, the n-th attempt's
    answer in the n-th line (the last one from then on). None where there is no such page."""

    def fetch(batch: int, year: int, page: str, attempt: int) -> dict | None:
        from pyarrow import fs

        path = folder.removeprefix("file:") if "://" not in folder else folder
        store, root = fs.FileSystem.from_uri(path)
        found = store.get_file_info(fs.FileSelector(f"{root}/batch={batch}/year={year}/page={page}", allow_not_found=True))
        lines = []
        for info in sorted(found, key=lambda i: i.path):
            if info.is_file and not info.base_name.startswith(("_", ".")):
                with store.open_input_stream(info.path) as f:
                    lines += f.read().decode().splitlines()
        return json.loads(lines[min(attempt, len(lines) - 1)]) if lines else None

    return fetch


class _Reader(DataSourceReader):
    def __init__(self, requests: Sequence[tuple[int, int]], fetch, wait):
        self.requests, self.fetch, self.wait = requests, fetch, wait

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.requests]

    def _answer(self, batch: int, year: int, page: str) -> tuple[dict | None, int, float]:
        """(body or None for a missing page, attempts made, seconds waited)"""
        waited = 0.0
        for attempt in range(ATTEMPTS):
            answer = self.fetch(batch, year, page, attempt)
            status = 404 if answer is None else answer.get("status", 200)
            if status == 404:
                return None, attempt + 1, waited
            if status not in LATER:
                if status != 200:
                    raise RuntimeError(f"status {status} for batch {batch}, year {year}, page {page}")
                return answer.get("body", answer), attempt + 1, waited
            seconds = waiting_time(attempt, answer.get("retry_after"))
            self.wait(seconds)
            waited += seconds
        raise RuntimeError(f"no answer for batch {batch}, year {year}, page {page} after {ATTEMPTS} attempts")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        batch, year = partition.value
        page, seen, number, past = "0", 0, 0, set()
        while page not in past:
            past.add(page)
            body, attempts, waited = self._answer(batch, year, page)
            results = (body or {}).get("results") or []
            for row in results:
                yield batch, year, page, attempts, waited, json.dumps(row)
            if not results:
                yield batch, year, page, attempts, waited, None
            seen, number = seen + len(results), number + 1
            if body is not None and body.get("next") is not None:
                page = str(body["next"])
            elif results and seen < ((body.get("metadata") or {}).get("total") or 0):
                page = str(number)
            else:
                return


def paged_source(requests: Sequence[tuple[int, int]], fetch: Callable[[int, int, str, int], dict | None], wait: Callable[[float], None]) -> type[DataSource]:
    """A data source with one partition for each request (batch, year); see read_pages."""
    asked = [(int(b), int(y)) for b, y in requests]

    class LandedPages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "landed_pages"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(asked, fetch, wait)

    return LandedPages


def read_pages(spark: SparkSession, requests: Sequence[tuple[int, int]], fetch: Callable[[int, int, str, int], dict | None], wait: Callable[[float], None] = lambda seconds: None) -> DataFrame:
    """Results of all requests as SCHEMA, each request read by a task of its own.

    fetch(batch, year, page, attempt) gives {"status", "retry_after", "body"}, or a body, or None for a missing page. A task
    follows the pages of its request: the `next` a body names, else numbered pages until metadata.total results were
    seen; a page met before ends it. A missing page is empty. Answers of LATER are asked for again, after the seconds of
    waiting_time, up to ATTEMPTS times: `wait` lets them pass (time.sleep for a live interface; landed answers need no
    waiting, so by default none passes). Other answers fail the task, and Spark runs it again. The driver knows the
    requests, which are a plan of batches and years, and no result.
    """
    spark.dataSource.register(paged_source(requests, fetch, wait))
    return spark.read.format("landed_pages").load()


def page_rows(pages: DataFrame, schema: str) -> DataFrame:
    """batch, year and the results' fields, by a DDL schema."""
    return pages.where("row IS NOT NULL").select("batch", "year", F.from_json("row", schema).alias("r")).select("batch", "year", "r.*")


def page_status(pages: DataFrame) -> DataFrame:
    """batch, year, page, attempts, waited, results: one row for each page that was asked for."""
    return pages.groupBy("batch", "year", "page", "attempts", "waited").agg(F.count("row").alias("results"))
