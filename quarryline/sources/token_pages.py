"""Sources whose pages are chained by tokens: a stream with tokens as offsets, and a listing.

A service is a Python object named as ``module:class``; its constructor takes one string (``service``).
It answers ``first(channel)`` and ``latest(channel)`` with a token, and ``page(channel, token)`` with
(rows, next token), or None where it no longer knows the token. A chain can only be walked from page
to page, so a channel is one partition; channels are read by as many tasks as there are.
"""

from __future__ import annotations

import importlib
import json

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "channel string, token string, payload string, lost boolean"


def service_of(options: dict):
    module, name = options["api"].split(":")
    return getattr(importlib.import_module(module), name)(options.get("service", ""))


class Stretch(InputPartition):
    def __init__(self, channel: str, start: str, end: str):
        self.channel, self.start, self.end = channel, start, end


class TokenStream(DataSourceStreamReader):
    """Offsets are the tokens of all channels; Spark writes them to its log before a batch is processed.

    A stream without a log starts at the latest tokens and replays nothing of what lies before (or at the
    first ones, by the option ``from`` = ``first``). A token that the service has lost gives one row that
    says so, and the channel goes on from the latest. A batch that is run again reads the same pages.
    """

    def __init__(self, options: dict):
        self.options = dict(options)
        self.channels = json.loads(options["channels"])

    def initialOffset(self) -> dict:
        service = service_of(self.options)
        ask = service.first if self.options.get("from") == "first" else service.latest
        return {channel: ask(channel) for channel in self.channels}

    def latestOffset(self) -> dict:
        service = service_of(self.options)
        return {channel: service.latest(channel) for channel in self.channels}

    def partitions(self, start: dict, end: dict):
        # a channel that the start does not name is new: it begins at its latest token
        return [Stretch(c, start[c], token) for c, token in end.items() if start.get(c, token) != token]

    def read(self, partition: Stretch):
        service, token, met = service_of(self.options), partition.start, set()
        while token != partition.end:
            if token in met:
                raise ValueError(f"the pages of {partition.channel} lead back to {token}")
            met.add(token)
            answer = service.page(partition.channel, token)
            if answer is None:
                yield partition.channel, token, None, True
                return
            rows, following = answer
            for row in rows:
                yield partition.channel, token, row, False
            token = following

    def commit(self, end: dict) -> None:
        pass


class Query(InputPartition):
    def __init__(self, channel: str):
        self.channel = channel


class TokenListing(DataSourceReader):
    """Pages of a listing from its first token on, until there is none, ``most`` rows are read, or ``max_pages`` pages."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        return [Query(channel) for channel in json.loads(self.options["channels"])]

    def read(self, partition: Query):
        service = service_of(self.options)
        left, token = int(self.options.get("most", 50)), service.first(partition.channel)
        for _ in range(int(self.options.get("max_pages", 20))):
            answer = service.page(partition.channel, token)
            if answer is None:
                yield partition.channel, token, None, True
                return
            rows, following = answer
            for row in rows[:left]:
                yield partition.channel, token, row, False
            left -= len(rows)
            if left <= 0 or not following:
                return
            token = following


class TokenPages(DataSource):
    """``spark.dataSource.register(TokenPages)``, then ``read`` or ``readStream`` with format ``token_pages``."""

    @classmethod
    def name(cls) -> str:
        return "token_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenListing:
        return TokenListing(self.options)

    def streamReader(self, schema) -> TokenStream:
        return TokenStream(self.options)
