from __future__ import annotations

import hashlib
import random
import re

from quarryline.llm import secret_scan
from quarryline.session import table
from tests.llm.helpers import LONG, SF, by_id, documents

# the contract's patterns as they are stated
STATED = (
    ("assign", re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile("(AKIA[A-Z0-9]+)")),
    ("hex", re.compile("([0-9a-f]+)")),
)
LEAST = {"assign": 6, "access": 20, "hex": 24}


def brute(text):
    found = []
    for place, (kind, pattern) in enumerate(STATED):
        found += [(m.start(), place, m.end(), kind) for m in pattern.finditer(text or "") if len(m[1]) >= LEAST[kind]]
    listed = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))
    return [sum(x[3] == k for x in found) for k in LEAST], hashlib.sha256(listed.encode()).hexdigest()


TEXTS = [None, "", "Password = 'abcdef' é token:abc token: abcdefg", "AKIA" + "A" * 15, "xAKIA" + "B7" * 9 + "AKIA" + "C" * 20, "ab" * 12, "ab" * 11 + "g" + "0f" * 40,
         "api_key=apikey:secretsecret passwd  ==x", 'SECRET"  :  "a.b/c=d-e_f+"', "toKen=abcdefgh ſecret=abcdefgh", "𝔘 token=𝔘abcdef token=abcdef𝔘",
         "deadbeef" * 3 + " token=" + "deadbeef" * 3, LONG + "secret=hunter22222"]


def test_base_spans_match_the_contract(spark):
    rows = list(enumerate(TEXTS)) + [(50, TEXTS[2]), (50, TEXTS[2]), (None, TEXTS[2])]
    found = secret_scan.scan_secrets(documents(spark, rows, "kind value spans"))
    assert found.count() == len(rows)
    for i, row in by_id(found).items():
        counts, digest = brute(dict(rows)[i])
        assert [row.n_assign, row.n_access, row.n_hex] == counts and row.base_sha256 == digest, i
        assert row.n_format == row.spans.count("format:")


def test_query_on_the_driver_tables(spark):
    from __spark_entry__ import queries

    found = by_id(queries()["op4_secrets"](spark, SF))
    docs = table(spark, SF, "documents").collect()
    assert len(found) == len(docs)
    for doc in docs:
        row, (counts, digest) = found[doc.doc_id], brute(doc.text)
        assert [row.n_assign, row.n_access, row.n_hex] == counts and row.base_sha256 == digest


def made_values():
    random.seed(4)
    pick = lambda letters, k: "".join(random.choices(letters, k=k))
    return {
        "hex": [pick("0123456789abcdef", 32) for _ in range(600)],
        "letters": ["-".join(pick("etaoinshr", random.randint(3, 8)) for _ in range(3)) for _ in range(600)],
        "numbers": [pick("0123456789", 16) if i % 2 else ".".join(str(random.randrange(256)) for _ in range(4)) for i in range(600)],
        "capitals": ["".join(random.choices(["TH", "EN", "ING", "KEIT", "ONS"], k=5)) for _ in range(600)],
        "mixed": [f"mail{random.randrange(99)}.example.com" for _ in range(600)],
    }


def test_inferred_formats_find_credentials_without_a_hint():
    values = made_values()
    fresh = {k: v[400:] for k, v in values.items()}
    formats = secret_scan.learn_formats({k: v[:400] for k, v in values.items()})
    scanner = secret_scan.Scanner(formats)
    # 23 digits are short of the base pattern
    short = [h[:22] for h in fresh["hex"] if re.search("[a-f]", h[:22])]
    assert sum(map(scanner.passes, short)) >= 0.97 * len(short)
    for kind in ("letters", "capitals", "numbers", "mixed"):
        assert sum(map(scanner.passes, fresh[kind])) == 0
    base, more = scanner.scan("see " + short[0] + " and " + fresh["letters"][0] + " at 10.20.30.40")
    assert base == [] and more == [(4, 3, 26)]


def test_precision_and_recall_on_the_driver_tables(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    formats = secret_scan.infer_formats(docs)
    texts = {d.doc_id: d.text or "" for d in docs.collect()}
    for row in secret_scan.scan_secrets(docs, formats).collect():
        for span in filter(None, row.spans.split(",")):
            kind, start, end = span.split(":")
            found = texts[row.doc_id][int(start) : int(end)]
            assert kind != "format" or not re.fullmatch(r"[0-9]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}\.?", found), found
    assert sum(row.n_format for row in secret_scan.scan_secrets(docs, formats).collect()) == 0, "this table has no other credentials"
    random.seed(1)
    tokens = ["".join(random.choices("0123456789abcdef", k=22)) for _ in range(200)]
    planted = documents(spark, [(i, f"the value {t} was used") for i, t in enumerate(tokens)])
    assert sum(row.spans == "format:10:32" for row in secret_scan.scan_secrets(planted, formats).collect()) >= 190


def test_spans_match_every_token_scored_alone(spark):
    values = made_values()
    random.seed(6)
    tokens = [t for v in values.values() for t in v] + ["token=" + h for h in values["hex"][:20]]
    made = lambda tokens: [(i, " ".join(random.choices(tokens, k=12)) + random.choice(["", " AKIA" + "Z" * 17, ",x"])) for i in range(300)]
    formats = secret_scan.infer_formats(documents(spark, made(tokens)), 200)
    rows = made(tokens + [h[:22] for h in values["hex"]])
    found = by_id(secret_scan.scan_secrets(documents(spark, rows), formats))
    some = 0
    for i, text in rows:
        taken = [(m.start(), place, m.end(), kind) for place, (kind, p) in enumerate(STATED) for m in p.finditer(text) if len(m[1]) >= LEAST[kind]]
        more = []
        for m in re.finditer("[A-Za-z0-9+/_.=-]+", text):
            touched = any(a < m.end() and b > m.start() for a, _, b, _ in taken)
            if len(m[0]) >= 6 and not touched and formats.advantage(m[0]) >= formats.threshold:
                more.append((m.start(), 3, m.end(), "format"))
        some += len(more)
        assert found[i].spans == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(taken + more))
    assert some > 100


def test_the_sample_is_the_lowest_of_all(spark):
    rows = [(i, f"token=value{i:04} word{'abcdefghij'[i % 10]}{'xyz'[i % 3]} 12.34.{i}") for i in range(500)]
    docs = documents(spark, rows).repartition(5)
    values = secret_scan.labelled_values(docs, 40).collect()
    by_kind = {k: {r.value for r in values if r.kind == k} for k in ("assign", "letters", "numbers")}
    for kind, every in (("assign", {f"value{i:04}" for i in range(500)}), ("numbers", {f"12.34.{i}" for i in range(500)})):
        lowest = sorted(every, key=secret_scan.order_of)[:40]
        assert sorted(by_kind[kind], key=secret_scan.order_of)[:40] == lowest
    assert len(by_kind["letters"]) == 30
    spark_order = [r.value for r in docs.selectExpr("concat('12.34.', doc_id) AS value").orderBy(secret_scan.F.xxhash64("value")).limit(40).collect()]
    assert spark_order == sorted({f"12.34.{i}" for i in range(500)}, key=secret_scan.order_of)[:40]


def test_long_credentials_are_learnt():
    values = made_values() | {"assign": ["K" * 9000 + str(i) for i in range(12)]}
    formats = secret_scan.learn_formats(values)
    assert secret_scan.Scanner(formats).passes("K" * 9000 + "3")


def test_automata_are_distributions():
    samples = ["ab", "abab", "ababab", "ab", "abab", "c"] * 30
    automaton = secret_scan.Automaton(samples)
    strings = [""]
    for _ in range(9):
        strings += [s + c for s in strings if len(s) == len(strings[-1]) for c in "abc"]
    total = 0.0
    for text in strings:
        state, p = 0, 1.0
        for char in text:
            p *= automaton.counts[state].get(char, 0) / (automaton.totals[state] or 1)
            state = automaton.moves[state].get(char, 0)
        total += p * automaton.ends[state] / (automaton.totals[state] or 1)
    assert 0.8 < total <= 1 + 1e-9
    assert automaton.log_likelihood("abab") > automaton.log_likelihood("abba")


def test_empty_table(spark):
    assert secret_scan.scan_secrets(documents(spark, [])).count() == 0
