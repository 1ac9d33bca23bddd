from __future__ import annotations

import itertools
import random
import re

import pytest

from quarryline.llm import chat_format
from quarryline.session import table
from tests.llm.helpers import SF

SCHEMA = "conv_id long, turn long, role string, text string"
MAY_START, NEXT = {"system", "user"}, {"system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}


def legal(roles):
    return not roles or roles[0] in MAY_START and all(b in NEXT[a] for a, b in itertools.pairwise(roles))


def least_cost(given):
    """Try every mixture of merges, roles and empty turns."""
    best = None
    choices = [[(action, role, extra) for action in ("own", "merge") for role in chat_format.ROLES for extra in (None, *chat_format.ROLES)] for _ in given]
    for picked in itertools.product(*choices):
        roles, cost = [], 0
        for name, (action, role, extra) in zip(given, picked, strict=True):
            cost += 0 if role == name else (chat_format.RELABEL if name in chat_format.ROLES else chat_format.NAME)
            if action == "merge":
                if extra or not roles or roles[-1] != role:
                    break
                cost += chat_format.MERGE
                continue
            if extra:
                roles.append(extra)
                cost += chat_format.INSERT
            roles.append(role)
        else:
            if legal(roles) and (best is None or cost < best):
                best = cost
    return best


def repaired(df):
    found = {}
    for row in sorted(df.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.turn is None, r.turn or 0, r.place)):
        found.setdefault(row.conv_id, []).append(row)
    return found


def sequence(rows):
    roles = []
    for row in rows:
        if row.action.endswith("merge"):
            assert roles[-1] == row.role
            continue
        roles += [row.inserted] * (row.inserted is not None) + [row.role]
    return roles


def test_least_cost_of_all_short_conversations(spark):
    names = ["system", "user", "assistant", "bot"]
    cases = [list(c) for n in (1, 2) for c in itertools.product(names, repeat=n)]
    random.seed(1)
    cases += [random.choices(names, k=3) for _ in range(12)]
    rows = [(i, t, role, f"t{t}") for i, roles in enumerate(cases) for t, role in enumerate(roles)]
    found = repaired(chat_format.repair_chats(spark.createDataFrame(rows, SCHEMA)))
    for i, roles in enumerate(cases):
        assert legal(sequence(found[i]))
        assert sum(r.cost for r in found[i]) == least_cost(roles), roles


@pytest.mark.parametrize("size", [63, 64, 65, 1000])
def test_blocks_cost_what_the_whole_costs(spark, size):
    random.seed(size)
    roles = random.choices(["system", "user", "assistant", None], [1, 5, 5, 1], k=size)
    found = repaired(chat_format.repair_chats(spark.createDataFrame([(1, t, r, f"m{t}") for t, r in enumerate(roles)], SCHEMA)))[1]
    cost = {0: 0}
    for role in roles:
        reached = {}
        for state, so_far in cost.items():
            for s, to, more, *_ in chat_format.MOVES[role]:
                if s == state:
                    reached[to] = min(reached.get(to, so_far + more), so_far + more)
        cost = reached
    assert sum(r.cost for r in found) == min(cost.values()) and legal(sequence(found)) and len(found) == size
    text = "".join(r.rendered for r in found)
    assert re.findall(r"<\|(system|user|assistant)\|>", text) == sequence(found) and text.endswith("<|end|>\n")
    assert re.findall(r"m\d+", text) == [f"m{t}" for t in range(size)]


def test_one_conversation_with_one_turn_number_is_dealt_out(spark):
    random.seed(8)
    names = ["system", "user", "assistant", None]
    rows = [(None, None, random.choice(names), f"m{i}") for i in range(3000)] + [(7, 3, "user", "same")] * 1500 + [(i, 0, "user", "x") for i in range(10, 500)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as for tables of any size
    try:
        dealt = chat_format.dealt_turns(turns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for conv in ("conv_id IS NULL", "conv_id = 7"):
        held = dealt.filter(conv)
        assert held.select("part").distinct().count() > 1 and max(r["count"] for r in held.groupBy("block").count().collect()) <= 64
    found = repaired(chat_format.repair_chats(turns))
    assert sum(r.cost for r in found[7]) == 1499 and sequence(found[7]) == ["user"]
    assert legal(sequence(found[None])) and len(found[None]) == 3000
    cost = {0: 0}
    for row in found[None]:
        reached = {}
        for state, so_far in cost.items():
            for s, to, more, *_ in chat_format.MOVES[row.given_role]:
                if s == state:
                    reached[to] = min(reached.get(to, so_far + more), so_far + more)
        cost = reached
    assert sum(r.cost for r in found[None]) == min(cost.values())
    assert "".join(r.rendered for r in found[None]).count("<|end|>") == len(sequence(found[None]))


def test_awkward_rows(spark):
    rows = [(1, 0, " User ", None), (1, 1, "ASSISTANT", ""), (None, 0, None, "x"), (None, None, "user", "y" * 100_000), (2, 5, "user", "a"), (2, 5, "user", "a"), (2, None, "assistant", "b")]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS tie", "3 AS entry", "4 AS after", "5 AS e_conv", "6 AS costs")
    found = repaired(chat_format.repair_chats(turns))
    assert sum(map(len, found.values())) == len(rows)
    assert [r.action for r in found[1]] == ["keep", "keep"] and "".join(r.rendered for r in found[1]) == "<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert [r.action for r in found[2]] == ["keep", "merge", "keep"]
    assert legal(sequence(found[None]))
    assert chat_format.repair_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_the_driver_tables(spark):
    from __spark_entry__ import queries

    found = repaired(queries()["op2_chat_format"](spark, SF))
    given = table(spark, SF, "conversations").collect()
    assert sum(map(len, found.values())) == len(given)
    assert all(legal(sequence(rows)) for rows in found.values())
