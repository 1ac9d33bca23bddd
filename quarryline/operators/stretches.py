"""Walks over the ordered rows of each key, in parallel within a key.

A machine goes from row to row and says something at each. It can also sum up what a stretch of
rows does to any state it is entered in, in a few values. So rows are dealt to ranges of keys and
order; only the first and the last key of a range may go on in another one, and only these are summed
up: two summaries a range at most. The summaries of a key are chained to the state each of its
ranges starts in, and then all ranges are walked at once. A key may hold any share of the rows.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.ordering import PLACE_BITS
from quarryline.session import materialise, ship_package


class Machine(Protocol):
    """``columns`` are read of each row; states and summaries are values that JSON can hold."""

    columns: tuple[str, ...]

    def start(self): ...

    def step(self, state, row: tuple) -> tuple: ...

    def summary(self, rows: list[tuple]): ...

    def after(self, summary, state): ...


class Pages:
    """Greedy pages: a line goes on the page if it fits, else on a new one, under its group's heading again.

    Rows are (size of the line, size of its group's heading, whether it opens the group, room that the
    heading asks for). A line longer than a page stands alone under its heading. The state is the page
    and what is used of it; the value of a row is its page.
    """

    def __init__(self, budget: int, columns: tuple[str, str, str, str]):
        self.budget, self.columns = budget, columns

    def start(self):
        return [1, 0]

    def step(self, state, row):
        (page, used), (size, head, opens, room) = state, row
        if opens:
            if used and used + room > self.budget:
                page, used = page + 1, 0
            used += head
        if used and used + size > self.budget:
            page, used = page + 1, head
        return [page, used + size], page

    def summary(self, rows):
        """(least use that turns the page, pages, use in the end) by first turn, what an empty page comes to, and the size of all.

        After a turn a page has the heading and the line of its row, whatever was before, so outcomes
        are found from the last row on.
        """
        outcomes: list = [None] * len(rows)
        for i in range(len(rows) - 1, -1, -1):
            state, at = [0, rows[i][1] + rows[i][0]], i + 1
            while at < len(rows):
                after, _ = self.step(state, rows[at])
                if after[0] != state[0]:
                    state = [after[0] + outcomes[at][0], outcomes[at][1]]
                    break
                state, at = after, at + 1
            outcomes[i] = state
        turns, lowest, before = [], None, 0
        for i, (size, head, opens, room) in enumerate(rows):
            tests = [(before + room, 1 + (0 < head and head + size > self.budget))] if opens else []
            tests.append((before + (head if opens else 0) + size, 1))
            for filled, pages in tests:
                least = self.budget - filled + 1
                if lowest is None or least < lowest:
                    lowest = least
                    turns.append([least, pages + outcomes[i][0], outcomes[i][1]])
            before += size + (head if opens else 0)
            if lowest <= 1:
                break
        empty = self.start()
        for row in rows:
            empty, _ = self.step(empty, row)
        return {"turns": turns, "empty": [empty[0] - 1, empty[1]], "whole": sum(r[0] + (r[1] if r[2] else 0) for r in rows)}

    def after(self, summary, state):
        page, used = state
        if not used:
            return [page + summary["empty"][0], summary["empty"][1]]
        for least, pages, left in summary["turns"]:
            if used >= least:
                return [page + pages, left]
        return [page, used + summary["whole"]]


class Cursor:
    """A place from 0 to the last of a deck, moved by each row and held at both ends. Rows are (move, last place); the value is the place before the move."""

    def __init__(self, columns: tuple[str, str]):
        self.columns = columns

    def start(self):
        return 0

    def step(self, state, row):
        move, last = row
        return max(0, min(state + move, last)), max(0, min(state, last))

    def summary(self, rows):
        """Any number of held moves is one move held once."""
        total, low, high = 0, 0, rows[0][1]
        for move, last in rows:
            total += move
            low, high = (max(0, min(end + move, last)) for end in (low, high))
        return [total, low, high]

    def after(self, summary, state):
        total, low, high = summary
        return max(low, min(state + total, high))


class Gate:
    """Lets a row pass if ``every`` or more after the last one that did, or before it (a clock set back). Rows are (time,); a null time does not pass."""

    def __init__(self, every: int, columns: tuple[str]):
        self.every, self.columns = every, columns

    def start(self):
        return None

    def step(self, state, row):
        if row[0] is None:
            return state, False
        passes = state is None or row[0] < state or row[0] - state >= self.every
        return (row[0] if passes else state), passes

    def summary(self, rows):
        """The last to pass, by the first to pass: of rising times only those up to one gap after the first can be that."""
        times = [row[0] for row in rows if row[0] is not None]
        if not times or any(b < a for a, b in zip(times, times[1:], strict=False)):
            return {"times": times}
        last = list(times)
        for i in range(len(times) - 1, -1, -1):
            following = bisect_left(times, times[i] + self.every, i + 1)
            last[i] = last[following] if following < len(times) else times[i]
        steps: list[list[int]] = []
        for time, end in zip(times, last, strict=True):
            if steps and steps[-1][1] == end:
                steps[-1][0] = time
            else:
                steps.append([time, end])
            if time >= times[0] + self.every:
                break
        return {"first": times[0], "last": last[0], "steps": steps}

    def after(self, summary, state):
        if "times" in summary:
            for time in summary["times"]:
                state, _ = self.step(state, (time,))
            return state
        if state is None or summary["first"] < state:
            return summary["last"]
        return next((end for time, end in summary["steps"] if time - state >= self.every), state)


KINDS = {"long": pa.int64(), "boolean": pa.bool_()}


def walk(rows: DataFrame, by: str, order: tuple[str, ...], machine: Machine, out: str, kind: str) -> DataFrame:
    """``rows`` with the column ``out`` (long or boolean) that the machine gives at each row, key by key, in order.

    ``order`` must tell the rows of a key apart. A null key is a key. A task holds one state and one
    batch, and for the two outer keys of its range the columns that the machine reads.
    """
    ship_package(rows.sparkSession)
    wanted = list(machine.columns)
    keyed = rows.select(F.struct("*").alias("w_row"), F.xxhash64(F.col(by)).alias("w_hash"), F.col(by).alias("w_by"), *[F.col(c).alias(f"w_{i}") for i, c in enumerate(order)])
    sort = ["w_hash", "w_by", *[f"w_{i}" for i in range(len(order))]]
    placed = materialise(keyed.repartitionByRange(*sort).sortWithinPartitions(*sort).select("w_row", F.monotonically_increasing_id().alias("w_at")))
    placed = placed.withColumns({"w_range": F.shiftright("w_at", PLACE_BITS), "w_key": F.to_json(F.struct(F.col("w_row")[by].alias("k")))})
    read = placed.select("w_key", "w_range", *[F.col("w_row")[c].alias(c) for c in wanted])

    def portions(batches):
        key, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                if row[:2] != key:
                    if held:
                        yield key, held
                    key, held = row[:2], []
                held.append(row[2:])
        if held:
            yield key, held

    def sums(batches):
        found, held = [], None
        for key, portion in portions(batches):
            fresh = held is None or held[0][1] != key[1]
            if held and (held[2] or fresh):
                found.append((*held[0], json.dumps(machine.summary(held[1]))))
            held = (key, portion, fresh)
        if held:
            found.append((*held[0], json.dumps(machine.summary(held[1]))))
        yield pa.RecordBatch.from_pydict({name: pa.array([f[i] for f in found], t) for i, (name, t) in enumerate((("w_key", pa.string()), ("w_range", pa.int64()), ("w_sum", pa.string())))})

    def chain(group):
        state, states = machine.start(), []
        group = group.sort_values("w_range")
        for text in group["w_sum"]:
            states.append(json.dumps(state))
            state = machine.after(json.loads(text), state)
        return group.assign(w_state=states)[["w_key", "w_range", "w_state"]]

    edges = read.mapInArrow(sums, "w_key string, w_range long, w_sum string")
    # two rows a range at most, however many rows there are
    entries = materialise(edges.groupBy("w_key").applyInPandas(chain, "w_key string, w_range long, w_state string"))
    met = placed.join(F.broadcast(entries), ["w_key", "w_range"], "left").select("w_key", "w_state", *[F.col("w_row")[c].alias(f"w_{i}") for i, c in enumerate(wanted)], "w_row")
    schema = met.select("w_row").schema.add("w_out", kind)

    def steps(batches):
        key, state = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
            found = []
            for name, entry, *row in zip(*columns, strict=True):
                if name != key:
                    key, state = name, machine.start() if entry is None else json.loads(entry)
                state, value = machine.step(state, tuple(row))
                found.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(batch.num_columns - 1), pa.array(found, KINDS[kind])], names=["w_row", "w_out"])

    return met.mapInArrow(steps, schema).select("w_row.*", F.col("w_out").alias(out))
