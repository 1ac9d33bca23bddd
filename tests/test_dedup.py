from __future__ import annotations

import random
import time

from quarryline.operators import dedup
from quarryline.operators.dedup import greedy_two_key


def walk(rows):
    first, second, kept = set(), set(), []
    for seq, a, b in rows:
        if (a is None or a not in first) and (b is None or b not in second):
            kept.append(seq)
            first |= {a} - {None}
            second |= {b} - {None}
    return kept


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, a string, b string")


def test_chain_keeps_first_and_third(spark):
    rows = [(1, "u1", "r1"), (2, "u2", "r1"), (3, "u2", "r2")]
    assert [r.seq for r in greedy_two_key(frame(spark, rows), "a", "b", "seq").orderBy("seq").collect()] == [1, 3]
    assert [r.seq for r in greedy_two_key(frame(spark, rows), "a", "b", "seq", newest=True).orderBy("seq").collect()] == [1, 3]


def test_nulls_never_meet_and_empty_is_empty(spark):
    rows = [(1, None, None), (2, None, None), (3, "u", None), (4, "u", None)]
    assert sorted(r.seq for r in greedy_two_key(frame(spark, rows), "a", "b", "seq").collect()) == [1, 2, 3]
    assert greedy_two_key(frame(spark, []), "a", "b", "seq").count() == 0


def test_matches_the_walk_on_random_rows(spark):
    dice = random.Random(5)
    for _ in range(6):
        pick = lambda k: dice.choice([None, *map(str, range(k))])
        rows = [(i, pick(25), pick(25)) for i in range(120)]
        assert sorted(r.seq for r in greedy_two_key(frame(spark, rows), "a", "b", "seq").collect()) == walk(rows)
        backwards = greedy_two_key(frame(spark, rows), "a", "b", "seq", newest=True)
        assert sorted(r.seq for r in backwards.collect()) == sorted(walk(rows[::-1]))


def test_components_too_large_for_a_task_are_decided_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(dedup, "TASK_ROWS", 4)
    dice = random.Random(6)
    rows = [(i, str(dice.randrange(12)), str(dice.randrange(12))) for i in range(60)] + [(100 + i, f"u{i // 2}", f"r{(i + 1) // 2}") for i in range(9)]
    assert sorted(r.seq for r in greedy_two_key(frame(spark, rows), "a", "b", "seq").collect()) == walk(rows)


def test_a_long_chain_takes_no_round_for_each_link(spark):
    rows = [(i, f"u{i // 2}", f"r{(i + 1) // 2}") for i in range(10_000)]
    began = time.time()
    assert sorted(r.seq for r in greedy_two_key(frame(spark, rows), "a", "b", "seq").collect()) == walk(rows) == list(range(0, 10_000, 2))
    assert time.time() - began < 60
