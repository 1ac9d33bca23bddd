from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from quarryline.llm import mixing
from tests.llm.helpers import LONG, documents


def brute_targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Share by weight; what goes beyond the caps is shared again, until nothing does."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left, share = total - sum(capped.values()), sum(weight[s] for s in free)
        target = {s: Fraction(left * weight[s], share) for s in free}
        above = [s for s in free if target[s] > most * sizes[s]]
        if not above:
            return target | capped
        capped |= {s: Fraction(most * sizes[s]) for s in above}


def brute(rows, seed=0):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), t or "") for i, t, s in rows]
    sizes = defaultdict(int)
    for _, source, n, _ in docs:
        sizes[source] += n
    target = brute_targets(sizes)
    key = lambda d: hashlib.md5(f"{seed}:{'' if d[0] is None else d[0]}:{d[3]}".encode()).hexdigest()
    found = []
    for source, size in sizes.items():
        left = math.floor(target[source])
        own = sorted((d for d in docs if d[1] == source), key=key)
        epochs, rest = divmod(left, size) if size else (0, 0)
        for doc_id, _, n, _ in own:
            more = min(n, rest)
            rest -= more
            found.append((str(doc_id), n, size, round(float(target[source]), 6), epochs * n + more))
    return sorted(found)


def shown(df):
    return sorted((str(r.doc_id), r.mix_words, r.mix_size, round(r.mix_target, 6), r.mix_taken) for r in df.collect())


def some_rows():
    rows = [(i, "w " * (i * 37 % 91), f"src{i % 7 if i % 3 else 0}") for i in range(400)]
    rows += [(900, LONG, "src3"), (901, None, "src4"), (902, "", "empty"), (903, None, "empty"), (904, "one two", None), (905, "three", None)]
    return rows + [(904, "one two", None), (None, "four five", "src1"), (None, "four five", "src1")]


def table(spark, rows, extra=""):
    return documents(spark, [(i, t, None, s) for i, t, s in rows], extra)


def test_matches_brute_force(spark):
    rows = some_rows()
    found = mixing.mix_sources(table(spark, rows).repartition(5))
    assert shown(found) == brute(rows)
    assert shown(mixing.mix_sources(table(spark, rows[::-1]))) == brute(rows), "the order of rows does not matter"


def test_targets_are_met_and_capped(spark):
    rows = some_rows()
    by_source = mixing.mix_sources(table(spark, rows)).groupBy("source").agg(
        F.sum("mix_taken").alias("taken"), F.first("mix_target").alias("target"), F.first("mix_size").alias("size"),
        F.max(F.col("mix_taken") - 3 * F.col("mix_words")).alias("above"),
    )
    for row in by_source.collect():
        assert row.taken == math.floor(row.target) <= 3 * row["size"] and row.above <= 0


def test_empty_tables(spark):
    assert mixing.mix_sources(table(spark, [])).count() == 0
    assert mixing.take_mix(table(spark, [])).count() == 0
    assert [r.mix_taken for r in mixing.mix_sources(table(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


def test_mix_repeats_rows(spark):
    docs = table(spark, some_rows(), "mix_key mix_source mix_time whole size target")
    mixed = mixing.take_mix(docs)
    assert mixed.columns == docs.columns
    times = {str(i): 0 for i, *_ in some_rows()}
    for row in mixed.collect():
        times[str(row.doc_id)] += 1
    expected = dict.fromkeys(times, 0)
    for doc_id, n, _, _, taken in brute(some_rows()):
        expected[doc_id] += -(-taken // n) if taken else 0
    assert times == expected


def test_columns_with_the_operators_names_stay(spark):
    rows = some_rows()
    docs = table(spark, rows, "mix_key mix_words MIX_TAKEN source_size a.b w`x")
    found = mixing.mix_sources(docs)
    assert found.columns == [*docs.columns, "_mix_words", "_mix_size", "_mix_target", "_mix_taken"]
    assert sorted((str(r.doc_id), r._mix_taken) for r in found.collect()) == [(i, t) for i, *_, t in sorted(brute(rows), key=lambda x: (x[0], x[4]))]


def test_one_id_for_a_third_of_all_rows(spark):
    rows = [(None if i % 3 else i, f"{i} " + "w " * (i % 50), f"src{i % 2}") for i in range(600)] + [(7, "same text here", "src1")] * 300
    assert shown(mixing.mix_sources(table(spark, rows))) == brute(rows)
