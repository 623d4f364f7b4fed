"""JSON over HTTP as a source: retries, pages and a fall-back address, fetched by the tasks that hold the addresses."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Opener = Callable[[str], bytes]


def open_url(url: str, timeout: float = 30.0) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read()


def fetch_json(url: str, opener: Opener = open_url, tries: int = 3, delay: float = 1.0, fallback: str | None = None):
    """The JSON at an address. Failures are tried again after a pause; then the fall-back address is, in the same way."""
    last: Exception | None = None
    for place in (url, fallback):
        for i in range(tries if place else 0):
            try:
                return json.loads(opener(place))
            except (OSError, ValueError) as e:
                last = e
                if i + 1 < tries:
                    time.sleep(delay)
    raise OSError(f"{url}: {last}")


def pages(url: str, opener: Opener = open_url, per_page: int = 500, **retry) -> Iterator[dict]:
    """All pages of a paged address, as long as pagination.next_page names another one."""
    page = 1
    while page:
        found = fetch_json(f"{url}{'&' if '?' in url else '?'}per_page={per_page}&page={page}", opener, **retry)
        yield found
        page = (found.get("pagination") or {}).get("next_page")


def read_pages(spark: SparkSession, urls: list[str], field: str, schema: str, opener: Opener = open_url, per_page: int = 500, **retry) -> DataFrame:
    """Records (the list ``field`` of every page) of paged addresses, with the address each comes from."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for url in b.column(0).to_pylist():
                for page in pages(url, opener, per_page, **retry):
                    rows = [json.dumps(r) for r in page.get(field) or []]
                    yield pa.RecordBatch.from_arrays([pa.array([url] * len(rows), pa.string()), pa.array(rows, pa.string())], ["url", "json"])

    listed = spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, min(len(urls), 200)))
    return listed.mapInArrow(run, "url string, json string").select("url", F.from_json("json", schema).alias("r")).select("url", "r.*")
