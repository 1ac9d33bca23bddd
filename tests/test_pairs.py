"""Pairs of messages and applications against a comparison of all with all."""

from __future__ import annotations

import datetime as dt
import random

import pyarrow as pa
import pytest

from quarryline import catalog
from quarryline.operators import mail, pairs
from quarryline.plans import report_queries
from quarryline.plans.funnel_queries import link_tables
from tests.compare import duck, sparks

SF = "/root/testdata/sf0.01"
MESSAGE = "id long, subject string, snippet string, body string, from string, date timestamp, kind string"
APPLICATION = "id long, company string, title string, location string, ts timestamp"


def made(seed: int):
    """Rows of messages and applications over few letters, so that names stand in texts, across words, and in each other."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.choice((1, 3, 6, 7, 9))))
    messages = []
    for i in range(40):
        said = [word() for _ in range(rng.randrange(12))]
        more = list({word() for _ in range(rng.randrange(2))} - set(said))
        messages.append((i % 35, rng.choice((None, rng.randrange(100))), list(dict.fromkeys(said)), more, "".join(said + more)))
    applications = []
    for i in range(60):
        name = [word() for _ in range(rng.randrange(3))]
        title = [word() for _ in range(rng.randrange(4))]
        applications.append((i % 50, rng.choice((None, rng.randrange(100))), list(dict.fromkeys(name)), title, rng.choice((None, "".join(name))), rng.choice((None, word()))))
    return messages, applications


def compared(messages, applications, lag):
    for m, sent, said, more, text in messages:
        for a, applied, name, title, whole, city in applications:
            company = bool(set(name) & {*said, *more}) or len(whole or "") >= pairs.STEM and whole in text
            hits = sum(w in said for w in title)
            points = pairs.TITLE if hits >= 2 else pairs.PARTIAL if hits and company else 0
            apart = None if sent is None or applied is None else sent - applied
            if (company or points) and (apart is None or apart >= -lag):
                yield m, a, company, points, apart, city in said


def columns(rows, names, kinds):
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


KINDS = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]


def met(monkeypatch, cells: int, windows: int, seed: int, deciding: bool = False):
    monkeypatch.setattr(pairs, "CELLS", cells)
    monkeypatch.setattr(pairs, "WINDOWS", windows)
    messages, applications = made(seed)
    block = pairs.Block(columns(applications, ["app_id", "at", "words", "more", "text", "city"], KINDS))
    rows = columns(messages, ["message_id", "at", "words", "more", "text"], KINDS[:5]).slice(3).to_batches()[0]  # with an offset
    found = [tuple(r.values()) for batch in block.pairs(rows, 20, deciding) for r in batch.to_pylist()]
    return found, list(compared(messages[3:], applications, 20))


@pytest.mark.parametrize(("cells", "windows"), [(1, 1), (300, 7), (1 << 22, 1 << 20)])
def test_pairs_are_those_of_all_with_all(monkeypatch, cells, windows):
    for seed in range(8):
        found, expected = met(monkeypatch, cells, windows, seed)
        key = lambda r: str(r)
        assert sorted(found, key=key) == sorted(expected, key=key) and len(found) > 100


def test_few_words_in_common():
    """Messages and applications of which some have no words, no sender or no long name."""
    messages = [(1, 5, [], [], ""), (2, 5, ["ab"], [], "ab"), (3, None, [], ["ab"], "ab"), (4, 5, ["x"], [], "xlongname"), (5, 5, ["c", "d"], [], "cd")]
    applications = [(7, 5, ["ab"], [], "ab", None), (8, 5, [], [], "longname", "x"), (9, 5, [], ["c", "d"], None, "c"), (10, None, [], [], None, None)]
    for some_messages in [messages, *([m] for m in messages)]:
        for some in [applications, *([a] for a in applications)]:
            block = pairs.Block(columns(some, ["app_id", "at", "words", "more", "text", "city"], KINDS))
            rows = columns(some_messages, ["message_id", "at", "words", "more", "text"], KINDS[:5]).to_batches()[0]
            found = [tuple(r.values()) for batch in block.pairs(rows, 20, False) for r in batch.to_pylist()]
            assert sorted(found, key=str) == sorted(compared(some_messages, some, 20), key=str)


def test_nothing_meets_nothing(spark):
    m, a = spark.createDataFrame([], MESSAGE), spark.createDataFrame([], APPLICATION)
    one = spark.createDataFrame([(1, None, None, None, None, None, None)], MESSAGE), spark.createDataFrame([(7, None, None, None, None)], APPLICATION)
    for left, right in ((m, a), (one[0], a), (m, one[1]), one):
        assert mail.score_links(left, right).collect() == []


def test_links_are_made_where_both_meet(spark, monkeypatch):
    """However many parts and blocks; rows of messages and applications are shuffled, and no words or pairs."""
    tables = link_tables(spark, SF)
    at_once = sorted(map(tuple, mail.score_links(*tables, noise=()).select("message_id", "app_id", "identity", "score").collect()))
    monkeypatch.setattr(pairs, "BLOCK", 30)
    monkeypatch.setattr(pairs, "PART", 100)
    links = mail.score_links(*tables, noise=())
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, links.select("message_id", "app_id", "identity", "score").collect())) == at_once and len(at_once) > 1000


def test_rows_of_one_id_are_messages_of_their_own(spark):
    at = dt.datetime(2024, 1, 10)
    m = spark.createDataFrame([(1, "", "", "about Tidalworks", "", at, "bounced"), (1, "", "", "about a diver", "", at, "bounced")], MESSAGE)
    a = spark.createDataFrame([(7, "Tidalworks", "Diver", "", at), (7, "Elsewhere", "Diver", "", at)], APPLICATION)
    assert [(r.message_id, r.app_id, r.identity, r.why) for r in mail.score_links(m, a).collect()] == [(1, 7, 10, ["company", "same-day"])]


def test_links_resolve_by_the_deciding_pairs(spark, monkeypatch):
    """The best of each block, and one that comes next there, tell the same as all pairs."""
    monkeypatch.setattr(pairs, "BLOCK", 30)
    monkeypatch.setattr(pairs, "PART", 100)
    messages, applications = link_tables(spark, SF)
    every, deciding = (mail.score_links(messages, applications, noise=(), deciding=d).select("message_id", "app_id", "identity", "score").localCheckpoint() for d in (False, True))
    assert deciding.exceptAll(every).isEmpty() and deciding.count() < every.count()
    for margin in (1, 2, 8):
        all_told, told = (sorted(mail.resolve_links(messages, s, margin).collect(), key=str) for s in (every, deciding))
        assert told == all_told and {r.outcome for r in told} == {"link", "tie", "orphan"}


def explodes(plan: str) -> int:
    return sum(line.lstrip(" :+-*").startswith(("Generate", "(")) and "explode(" in line for line in plan.splitlines())


def test_link_states_explode_no_words(spark, monkeypatch):
    """Messages and applications are dealt to parts and blocks, and that is all that is exploded; the states are those of the SQL."""
    monkeypatch.setattr(pairs, "BLOCK", 3)
    monkeypatch.setattr(pairs, "PART", 20)
    found = report_queries.link_states(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert explodes(plan) == 2 and plan.count("MapInArrow") == 1
    assert sparks(found) == duck(catalog.ORACLE_SQL["link_states"], "/root/testdata/sf0.001")


def test_silence_order_makes_pairs_once(spark, monkeypatch):
    """Places are numbered over what is left of the pairs; they are those of the SQL over many parts and blocks."""
    calls, meet = [], pairs.meet
    monkeypatch.setattr(pairs, "meet", lambda *args: calls.append(args[3]) or meet(*args))
    monkeypatch.setattr(pairs, "BLOCK", 3)
    monkeypatch.setattr(pairs, "PART", 20)
    found = sparks(report_queries.silence_order(spark, "/root/testdata/sf0.001"))
    assert calls == [True]
    assert found == duck(catalog.ORACLE_SQL["silence_order"], "/root/testdata/sf0.001")
