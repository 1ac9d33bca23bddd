"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from quarryline.llm import queries, turn_repair
from quarryline.session import table
from tests.compare import duck, sparks
from tests.llm.helpers import SF

TURNS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def faults_of(rows):
    seen, found = set(), []
    for role, text in rows:
        ends = text.rstrip(WHITE)
        found.append("blank" if not ends else "duplicate" if (role, text) in seen else "" if ends[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(rows, faults):
    """(cost, audit, lines) by Dijkstra's search over (row, last role), letter by letter."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, last, lines = heapq.heappop(queue)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if (at, last) in done:
            continue
        done.add((at, last))
        for role in FOLLOWS[last]:
            name = {"u": "user", "a": "assistant"}.get(role)
            if name:
                heapq.heappush(queue, (cost + 5, audit + "I", at, role, (*lines, f"{name}:")))
            if at < len(rows) and faults[at] not in ("blank", "duplicate"):
                given, text = rows[at]
                late = 5 if faults[at] == "truncated" else 0
                if given[:1] == role:
                    heapq.heappush(queue, (cost + late, audit + "K", at + 1, role, (*lines, f"{given}:{text}")))
                if name:
                    heapq.heappush(queue, (cost + late + 1, audit + "R", at + 1, role, (*lines, f"{name}:{text}")))
        if at < len(rows):
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, last, lines))


def digest(conv, turns):
    """turns: (turn, role, text) after damage, in order."""
    rows = [(role, text) for _, role, text in turns]
    faults = faults_of(rows)
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = cheapest(rows, faults)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(turns):
    return sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def damaged(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        kept = by_conv.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return by_conv


def made_rows(seed, convs, turns):
    made = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "umpire"]
    texts = ["Yes.", "No!", "Why?", "well", "and so", "", " \t", None, "Ends. \n", "é.", "ok "]
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(made.randrange(0, turns)):
            number = made.choice([turn, turn, turn, turn, turn + 3, None])
            rows.append((conv, number, made.choice(roles), made.choice(texts) if made.random() < 0.7 else f"Text {made.randrange(9)}."))
    return rows


@pytest.mark.parametrize("seed", range(30))
def test_plans_match_search(seed):
    made = random.Random(seed)
    for _ in range(60):
        rows = [(made.choice(["user", "assistant", "system", "tool", ""]), made.choice(["A.", "B", "", "C!", "D", f"{made.random()}."])) for _ in range(made.randrange(9))]
        faults = faults_of(rows)
        cost, audit, lines = cheapest(rows, faults)
        plan = turn_repair.Plan([r[:1] for r, _ in rows], faults, turn_repair.CLOSING)
        found = list(turn_repair.edits(plan, turn_repair.START, True))
        assert (plan.cost(turn_repair.START), "".join(e for _, e, _ in found)) == (cost, audit)
        kept = [(role or rows[at][0]) + ":" + ("" if at is None else rows[at][1]) for at, edit, role in found if edit != "D"]
        assert kept == list(lines)
        # cut anywhere, the parts give the same audit
        cut = made.randrange(len(rows) + 1)
        halves = [([r[:1] for r, _ in rows[s]], faults[s]) for s in (slice(cut), slice(cut, None))]
        second = turn_repair.Plan(*halves[1], turn_repair.CLOSING)
        after = [min(turn_repair.transitions(*halves[1])[4 * a + b] + turn_repair.CLOSING[b] for b in range(4)) for a in range(4)]
        assert after == [second.cost(state) for state in range(4)]
        first = turn_repair.Plan(*halves[0], after)
        middle = first.leave(turn_repair.START)
        parts = [*turn_repair.edits(first, turn_repair.START, False), *turn_repair.edits(second, middle, True)]
        assert "".join(e for _, e, _ in parts) == audit


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_matches_search(spark, sf):
    given = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op12_turn_repair(spark, sf)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(digest(conv, in_order(turns)) for conv, turns in damaged(given).items())


@pytest.mark.parametrize("few", [True, False])
def test_awkward_rows_match_search(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(turn_repair, "BROADCAST_ROWS", 0)
    rows = made_rows(5, 60, 14)
    turns = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS `a.b`", "'x' AS `w``x`", "1 AS place", "2 AS fault")
    found = turn_repair.repair_digests(turn_repair.damaged_turns(turns), turns)
    expected = [digest(conv, in_order(kept)) for conv, kept in damaged(rows).items()]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


def test_one_conversation_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "PIECE_BYTES", 100)
    made = random.Random(3)
    rows = []
    for conv, n in ((1, 3), (2, 400), (3, 5), (4, 300), (5, 1)):
        for turn in range(n):
            text = made.choice(["Yes.", f"Line {turn // 2}.", f"line {turn}", "", f"So {made.random()}!"])
            rows.append((conv, turn // 2 if turn % 7 else None, made.choice(["user", "assistant", "assistant", "system"]), text))
    turns = spark.createDataFrame(rows, TURNS).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        edits = turn_repair.edited(turns)
        assert not edits.filter("conv_id = 2").select("whole").distinct().first().whole
        found = turn_repair.repair_digests(turns, turns).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, role, text))
    assert sorted(tuple(r) for r in found) == sorted(digest(conv, in_order(kept)) for conv, kept in by_conv.items())


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello there"), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "Yes."), (2, 0, "assistant", "Hm.")]
    found = sorted((r.conv_id, r.place, r.edit, r.role, r.text, r.fault) for r in turn_repair.repair_turns(spark.createDataFrame(rows, TURNS)).collect())
    assert [(r[0], *r[2:]) for r in found] == [
        (1, "K", "user", "Hi.", ""), (1, "D", None, None, "truncated"), (1, "K", "assistant", "Yes.", ""), (1, "D", None, None, "duplicate"), (2, "D", None, None, ""),
    ]
    assert turn_repair.repair_turns(spark.createDataFrame([], TURNS)).count() == 0
    empty = spark.createDataFrame([], TURNS)
    assert turn_repair.repair_digests(empty, empty).count() == 0


def test_made_rows_match_sql(spark, tmp_path):
    turns = spark.createDataFrame(made_rows(11, 40, 10), TURNS)
    turns.coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "conversations.parquet")
    found = turn_repair.repair_digests(turn_repair.damaged_turns(turns), turns)
    assert sparks(found) == duck(turn_repair.repair_sql(), str(tmp_path))
