"""A batch data source over paged JSON feeds.

One partition per feed: pages of one host are asked one after another by the task that owns it,
so a host is never asked by two tasks. ``fetch`` is a registered Python function from an address
to (status, body); the source itself knows no network.
"""

from __future__ import annotations

import importlib
import json
import time

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "feed string, page int, url string, status int, payload string, partial boolean"


class FeedPartition(InputPartition):
    def __init__(self, feed: dict):
        self.feed = feed


class PagedReader(DataSourceReader):
    """Reads pages until one is empty, refused, or beyond the cap; says when a board was cut short."""

    def __init__(self, options: dict):
        self.feeds = json.loads(options["feeds"])
        self.fetch_name = options["fetch"]
        self.page_size = int(options.get("page_size", 20))
        self.most = int(options.get("most", 60))
        self.tries = int(options.get("tries", 3))
        self.pause = float(options.get("pause", 0.5))

    def partitions(self):
        return [FeedPartition(feed) for feed in self.feeds]

    def _fetch(self, url: str):
        module, name = self.fetch_name.split(":")
        fetch = getattr(importlib.import_module(module), name)
        for attempt in range(self.tries):
            status, body = fetch(url)
            # a refusal for too many requests is not tried again, a server's failure is
            if status == 429 or (200 <= status < 500):
                return status, body
            time.sleep(self.pause * 2**attempt)
        return status, body

    def read(self, partition):
        feed, answered = partition.feed, False
        for page, offset in enumerate(range(0, self.most, self.page_size)):
            url = feed["url"].format(offset=offset, limit=self.page_size)
            status, body = self._fetch(url)
            if status != 200:
                if not answered:
                    yield feed["name"], page, url, status, None, False
                    return
                yield feed["name"], page, url, status, None, True
                return
            answered = True
            yield feed["name"], page, url, status, body, False
            if self._items(body, feed.get("items", "items")) < self.page_size:
                return

    @staticmethod
    def _items(body: str, path: str) -> int:
        try:
            value = json.loads(body)
            for part in path.split("."):
                value = value[int(part)] if part.isdigit() else value[part]
            return len(value)
        except (ValueError, KeyError, IndexError, TypeError):
            return 0


class PagedFeeds(DataSource):
    """``spark.dataSource.register(PagedFeeds)``, then ``spark.read.format("paged_feeds")``."""

    @classmethod
    def name(cls) -> str:
        return "paged_feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
