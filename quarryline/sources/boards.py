"""Boards that are read term by term and page by page, and stop when they are refused.

One partition per host: its task owns all requests to it, so that one refusal for too many requests
stops all later ones, of every board and term of that host. ``fetch`` names a Python function
(``module:function``) from an address to (status, body); this source knows no network.
"""

from __future__ import annotations

import importlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "board string, kind string, address string, term string, item string, calls int, refused int, last_status int, cut_short boolean, status string"
#: What became of a board; its items have the kind ``item`` and its last row the kind ``board``.
RAN, FAILED, BLOCKED, LIMITED, SKIPPED = "ran", "no answer", "blocked", "rate limited", "not asked"


class Host(InputPartition):
    def __init__(self, boards: list[dict]):
        self.boards = boards


def within(value, path: str):
    """The value at a dotted path of names and numbers, or None."""
    for part in filter(None, path.split(".")):
        try:
            value = value[int(part)] if isinstance(value, list) else value[part]
        except (KeyError, IndexError, TypeError, ValueError):
            return None
    return value


class StoppedReader(DataSourceReader):
    """Each board has a name, a host, an address with ``{term}``, ``{offset}`` and ``{limit}``, and may have terms, page, most, and the paths items, total and address."""

    def __init__(self, options: dict):
        self.boards = json.loads(options["boards"])
        self.fetch_name = options["fetch"]

    def partitions(self):
        hosts: dict[str, list[dict]] = {}
        for board in self.boards:
            hosts.setdefault(board["host"], []).append(board)
        return [Host(boards) for boards in hosts.values()]

    def read(self, partition: Host):
        module, name = self.fetch_name.split(":")
        fetch, limited = getattr(importlib.import_module(module), name), False
        for board in partition.boards:
            found, told = self.walk(board, fetch) if not limited else ({}, (0, 0, 0, False, SKIPPED))
            limited = limited or told[-1] == LIMITED
            for address, (term, item) in found.items():
                yield board["name"], "item", address, term, item, None, None, None, None, None
            yield board["name"], "board", None, None, None, *told

    @staticmethod
    def walk(board: dict, fetch):
        """({address: (term, item)}, (calls, refused, last status, cut short, status)) of a board.

        An address keeps its first place and takes the last item, whatever the term. A failure ends its term; it cuts the
        board short if a page was read before. One page without items, or the total, ends a term.
        """
        found: dict[str, tuple[str, str]] = {}
        calls = refused = last = 0
        answered = cut = limited = False
        step = board.get("page", 20)
        for term in board.get("terms") or [""]:
            for offset in range(0, board.get("most", 60), step):
                status, body = fetch(board["url"].format(term=term, offset=offset, limit=step))
                calls, last = calls + 1, status
                content = parsed(body) if status == 200 else None
                items = within(content, board.get("items", "items"))
                if status != 200 or not isinstance(items, list):
                    refused += 1
                    cut, limited = cut or answered, status == 429
                    break
                answered = True
                for item in items:
                    address = within(item, board.get("address", "url"))
                    if isinstance(address, str) and address:
                        found[address] = (term, json.dumps(item, ensure_ascii=False))
                total = within(content, board.get("total", "total"))
                if not items or (isinstance(total, int) and offset + step >= total) or (total is None and len(items) < step):
                    break
            if limited:
                break
        silent = BLOCKED if last and last not in (0, 200) else FAILED
        return found, (calls, refused, last, cut, LIMITED if limited else RAN if answered or not calls else silent)


def parsed(body):
    try:
        return json.loads(body)
    except (ValueError, TypeError):
        return None


class Boards(DataSource):
    """``spark.dataSource.register(Boards)``, then ``spark.read.format("boards")``."""

    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StoppedReader:
        return StoppedReader(self.options)


def board_items(read: DataFrame) -> DataFrame:
    """(board, address, term, item) of what was read."""
    return read.filter("kind = 'item'").select("board", "address", "term", "item")


def board_report(read: DataFrame) -> DataFrame:
    """(board, found, calls, refused, last_status, cut_short, status) of each board: a board without an answer is told from one without offers."""
    figures = read.groupBy("board").agg(
        F.count_if(F.col("kind") == "item").alias("found"), *[F.max(c).alias(c) for c in ("calls", "refused", "last_status", "cut_short", "status")]
    )
    return figures.select("board", "found", "calls", "refused", "last_status", "cut_short", "status")


def next_run(report: DataFrame, now: Column, cooldown_ms: int) -> DataFrame:
    """(board, last_run, cooldown_until): boards that were refused rest; those that were not asked keep their turn."""
    asked = report.filter(F.col("status") != SKIPPED)
    return asked.select("board", now.alias("last_run"), F.when(F.col("status") == LIMITED, now + cooldown_ms).alias("cooldown_until"))
