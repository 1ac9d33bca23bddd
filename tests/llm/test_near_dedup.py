from __future__ import annotations

import random
import re

import xxhash

from quarryline.llm import near_dedup
from quarryline.operators.components import connected_components
from tests.llm.helpers import LONG, documents


def brute_print(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """Smallest member that each number reaches over links of three bits or less."""
    left, found = set(prints), {}
    while left:
        group, waiting = set(), {left.pop()}
        while waiting:
            one = waiting.pop()
            group.add(one)
            near = {p for p in left if (p ^ one).bit_count() <= 3}
            left -= near
            waiting |= near
        found |= dict.fromkeys(group, min(group))
    return found


def brute(rows):
    prints = {i: (doc_id, brute_print(text)) for i, (doc_id, text) in enumerate(rows)}
    group = brute_groups({p for _, p in prints.values()})
    least = {}
    for doc_id, p in prints.values():
        if doc_id is not None:
            least[group[p]] = min(doc_id, least.get(group[p], doc_id))
    return sorted((str(d), f"{p:016x}", str(least.get(group[p]))) for d, p in prints.values())


def shown(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_matches_brute_force(spark):
    random.seed(3)
    vocabulary = [f"w{i}É" for i in range(40)] + ["Up", "UP", "a b"]
    rows = []
    for i in range(120):
        words = random.choices(vocabulary, k=random.choice([0, 1, 2, 3, 4, 30, 200]))
        rows.append((1000 - i, " ".join(words)))
        if len(words) > 20:
            words[5] = "changed"
            rows.append((2000 + i, "\t".join(words)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (None, "one"), (None, "alone here now"), (5, LONG)]
    assert shown(near_dedup.near_dedup(documents(spark, rows))) == brute(rows)


def test_chains_of_one_to_three_bits(spark):
    random.seed(5)
    prints = set()
    for _ in range(60):
        value = random.getrandbits(64)
        for _ in range(random.randint(1, 6)):
            prints.add(value)
            for bit in random.sample(range(64), random.choice([1, 2, 3, 3, 3, 4])):
                value ^= 1 << bit
    signed = [(near_dedup.signed(p),) for p in prints]
    groups = near_dedup.near_groups(spark.createDataFrame(signed, "fp long")).collect()
    found = {row.fp % (1 << 64): row.root % (1 << 64) for row in groups}
    expected = brute_groups(prints)
    same = lambda mapping: {frozenset(k for k in mapping if mapping[k] == root) for root in set(mapping.values())}
    assert set(found) == prints and same(found) == same(expected)


def test_every_distance_of_three_is_linked(spark):
    random.seed(8)
    base = random.getrandbits(64)
    picks = [random.sample(range(64), 3) for _ in range(40)] + [[0, 21, 42], [20, 41, 63], [0, 1, 2], [61, 62, 63]]
    for bits in picks[::11] + picks[-4:]:
        other = base ^ sum(1 << b for b in bits)
        frame = spark.createDataFrame([(near_dedup.signed(base),), (near_dedup.signed(other),)], "fp long")
        assert near_dedup.near_groups(frame).select("root").distinct().count() == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 500), (301, 300), (302, 301), (302, 301)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == dict.fromkeys(range(201), 0) | dict.fromkeys((300, 301, 302), 300)


def test_empty_table(spark):
    assert near_dedup.near_dedup(documents(spark, [])).count() == 0
    assert near_dedup.drop_near_copies(documents(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(7, text), (6, text.upper()), (8, "other words are here"), (None, text), (8, "other words are here"), (9, None), (10, "")]
    docs = documents(spark, rows, "q_id q_rows own_id own_text whole fp root node key")
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(row.doc_id for row in kept.collect()) == [6, 8, 9]


def test_crowded_keys_are_linked_without_pairs(spark):
    random.seed(12)
    base = random.getrandbits(64)
    prints = {base}
    for _ in range(150):  # within a block, so that all have a masked key in common
        other = base
        for bit in random.sample(range(21), random.randint(1, 6)):
            other ^= 1 << bit
        prints.add(other)
    signed = sorted(near_dedup.signed(p) for p in prints)
    rows = spark.createDataFrame([(p, p) for p in signed], "fp long, root long")
    links = {(r.u, r.v) for r in near_dedup.crowded_links(rows).collect()}
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= near_dedup.RADIUS
    assert all(near(a, b) for a, b in links)
    groups = lambda pairs: grouped(signed, pairs)
    assert groups(links) == groups([(a, b) for a in signed for b in signed if a < b and near(a, b)])
    assert groups([(r.u, r.v) for r in near_dedup.three_bit_links(rows).collect()]) == groups(links)


def grouped(nodes, pairs):
    """The least node that each one reaches."""
    least = {n: n for n in nodes}

    def top(n):
        while least[n] != n:
            n = least[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        least[b] = a
    return {n: top(n) for n in nodes}


def test_crowded_variants_are_not_broadcast(spark, tmp_path):
    spark.range(200).selectExpr("id * 1021 AS fp", "id AS root").write.parquet(f"{tmp_path}/members")  # rows from Python have no size
    links = near_dedup.crowded_links(spark.read.parquet(f"{tmp_path}/members"))
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
