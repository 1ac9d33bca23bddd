"""Walks in parallel against walks row by row."""

from __future__ import annotations

import random

import pytest

from quarryline.operators import stretches

MACHINES = {
    "pages": (stretches.Pages(100, ("a", "b", "c", "d")), lambda r: (r.choice([0, 5, 20, 33, 60, 150]), h := r.choice([0, 4, 12]), r.random() < 0.3, h + r.choice([0, 3, 40]))),
    "cursor": (stretches.Cursor(("a", "b")), lambda r: (r.choice([-1, 0, 1, 1]), 6)),
    "gate": (stretches.Gate(7, ("a",)), None),
}


def made(name, random_rows, n):
    if name != "gate":
        return [MACHINES[name][1](random_rows) for _ in range(n)]
    at, rows = 0, []
    for _ in range(n):
        at += random_rows.choice([0, 1, 2, 5, 9] if random_rows.random() < 0.97 else [-20])
        rows.append((at,))
    return rows


def straight(machine, rows):
    state, values = machine.start(), []
    for row in rows:
        state, value = machine.step(state, row)
        values.append(value)
    return values, state


@pytest.mark.parametrize("name", MACHINES)
@pytest.mark.parametrize("seed", range(40))
def test_summaries_stand_for_their_rows(name, seed):
    machine, source = MACHINES[name][0], random.Random(seed)
    rows = made(name, source, 60)
    for _ in range(20):
        first, second = sorted(source.sample(range(61), 2))
        _, state = straight(machine, rows[:first])
        other = state
        for row in rows[first:second]:
            other, _ = machine.step(other, row)
        assert machine.after(machine.summary(rows[first:second]), state) == other


@pytest.mark.parametrize("name", MACHINES)
def test_a_hot_key_is_walked_by_many_tasks(spark, name):
    machine, source = MACHINES[name][0], random.Random(8)
    by_key = {key: made(name, source, n) for key, n in (("a", 3), ("hot", 900), (None, 40), ("b", 1), ("c", 200))}
    columns = machine.columns
    kinds = {"a": "long", "b": "long", "c": "boolean", "d": "long"}
    data = [(key, i, *row) for key, rows in by_key.items() for i, row in enumerate(rows)]
    source.shuffle(data)
    frame = spark.createDataFrame(data, "k string, i long, " + ", ".join(f"{c} {kinds[c]}" for c in columns))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = stretches.walk(frame, "k", ("i",), machine, "out", "boolean" if name == "gate" else "long")
        rows = found.collect()
        assert found.columns == [*frame.columns, "out"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for key, given in by_key.items():
        assert [r.out for r in sorted((r for r in rows if r.k == key), key=lambda r: r.i)] == straight(machine, given)[0]
    assert stretches.walk(frame.limit(0), "k", ("i",), machine, "out", "long").count() == 0
