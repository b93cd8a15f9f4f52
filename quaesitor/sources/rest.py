"""A paginated REST listing as a Spark data source: follows `Link: rel=next`, waits on rate limits, backs off on errors."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINK = re.compile(r'<([^>]+)>;\s*rel="([^"]+)"')
NO_RETRY = (401, 404, 422)
MARGIN, TRIES, LONGEST_WAIT = 50, 5, 60


def next_url(link: str | None) -> str | None:
    return {rel: url for url, rel in LINK.findall(link or "")}.get("next")


def wait_for(headers: dict, now: float) -> float:
    """Seconds to wait before the next request: until the reset once few requests remain."""
    left, reset = headers.get("x-ratelimit-remaining"), headers.get("x-ratelimit-reset")
    if left is None or reset is None or int(left) > MARGIN:
        return 0.0
    return max(0.0, float(reset) - now) + 1


def fetch(url: str, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> tuple[list, str | None]:
    """(items, next url) of one page; 204 is an empty page, 403 waits for the reset, a bounded number of times."""
    for n in range(TRIES):
        try:
            with opener(url) as r:
                headers = {k.lower(): v for k, v in r.headers.items()}
                body = [] if r.status == 204 else json.loads(r.read() or b"[]")
                sleep(wait_for(headers, time.time()))
                return (body if isinstance(body, list) else body.get("items", [body])), next_url(headers.get("link"))
        except urllib.error.HTTPError as e:
            if e.code in NO_RETRY or n == TRIES - 1:
                raise
            headers = {k.lower(): v for k, v in e.headers.items()}
            sleep(wait_for(headers | {"x-ratelimit-remaining": "0"}, time.time()) if e.code == 403 else min(2**n, LONGEST_WAIT))
        except urllib.error.URLError:
            if n == TRIES - 1:
                raise
            sleep(min(2**n, LONGEST_WAIT))
    return [], None


def pages(url: str, **how) -> Iterator[list]:
    at: str | None = url
    while at:
        items, at = fetch(at, **how)
        if not items:
            return
        yield items


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = options["urls"].split()

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for items in pages(partition.value):
            for item in items:
                yield partition.value, json.dumps(item, sort_keys=True)


class Listing(DataSource):
    """spark.dataSource.register(Listing); spark.read.format("rest_listing").option("urls", "...").load()"""

    @classmethod
    def name(cls) -> str:
        return "rest_listing"

    def schema(self) -> str:
        return "url string, item string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)
