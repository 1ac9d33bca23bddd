"""Secret scans: base patterns, and formats inferred from labelled credentials.

The base patterns label credentials by kind. From a bounded sample of them probabilistic
automata are inferred: a prefix tree of the samples is built, and states are merged when
their outgoing and final frequencies are statistically compatible (Hoeffding bound). In the
same way automata are inferred from the ordinary tokens of the whole corpus, one for each
class of characters, so that numbers and addresses aren't lost among words. Every token of
every text is then scored by the likelihood of its format: the best credential automaton
against the ordinary one of its class, or that class's characters alone. The threshold comes from ordinary tokens that no
automaton has seen. Tokens beyond it outside base matches become ``format`` spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.arrow import column_of, map_batches, texts_of
from quarryline.session import materialise, ship_package

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?(?P<value>[A-Za-z0-9+/_.=-]+)"
)
# maximal runs of the full length at least: shorter matches are dropped anyway
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
#: Tokens that are scored: what an assigned value may be.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
#: Bounds of the training sample: distinct values of each kind, and characters of all of them.
#: As many values again set the threshold.
SAMPLE_VALUES, SAMPLE_CHARS = 1500, 60_000
SAMPLE_SEED = 42
#: Tokens that a task remembers to have offered to the sample.
OFFERED = 200_000
#: Classes of ordinary tokens by their characters.
LETTERS, CAPITALS, NUMBERS, MIXED = CLASSES = ("letters", "capitals", "numbers", "mixed")
HAS_DIGIT = re.compile("[0-9]")
#: Significance of the merge test.
ALPHA = 0.05
#: Share of unseen ordinary tokens that may pass the threshold, and how many times likelier than that one a credential must be.
FALSE_SHARE, MARGIN = 0.001, 1000
#: Probability of a character that no sample has.
FLOOR = 1e-4
#: The end of a token, beside its characters.
END = ""


def base_matches(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base patterns, in order."""
    found = []
    if text:
        found += [
            (m.start(), 0, m.end(), m["value"]) for m in ASSIGN.finditer(text) if len(m["value"]) >= LEAST_ASSIGNED
        ]
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def outside_tokens(text: str, taken: list[tuple[int, int, int, str]]) -> set[str]:
    """The different candidate tokens that touch no base match."""
    return {token for _, _, token in outside(text, taken)} if taken else set(CANDIDATE.findall(text))


def outside(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidate tokens that touch no base match."""
    if not taken:
        return [(m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(text)]
    found, at = [], 0
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][2] <= m.start():
            at += 1
        if not any(s < m.end() and e > m.start() for s, _, e, _ in taken[at : at + len(KINDS) + 1]):
            found.append((m.start(), m.end(), m[0]))
    return found


class Logs(dict):
    """Log shares of characters; those that no sample has cost the floor."""

    def __missing__(self, char: str) -> float:
        return math.log(FLOOR)


class Automaton:
    """A probabilistic deterministic automaton over characters."""

    def __init__(self, samples: list[str], alpha: float = ALPHA):
        self.moves: list[dict[str, int]] = [{}]
        self.counts: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.slack = math.sqrt(0.5 * math.log(2 / alpha))
        for sample in samples:
            self._add(sample)
        self.totals = [end + sum(c.values()) for end, c in zip(self.ends, self.counts, strict=True)]
        chars: dict[str, int] = {}
        for counts in self.counts:
            for char, n in counts.items():
                chars[char] = chars.get(char, 0) + n
        every = sum(chars.values()) + sum(self.ends)
        self.shares = {char: n / every for char, n in chars.items()} | {END: sum(self.ends) / max(1, every)}
        self.rest = Logs((char, math.log(share)) for char, share in self.shares.items())
        self._merge_states()
        self.scores = [self._logs(state) for state in range(len(self.moves))]

    def _add(self, sample: str) -> None:
        state = 0
        for char in sample:
            self.counts[state][char] = self.counts[state].get(char, 0) + 1
            if char not in self.moves[state]:
                self.moves[state][char] = len(self.moves)
                self.moves.append({})
                self.counts.append({})
                self.ends.append(0)
            state = self.moves[state][char]
        self.ends[state] += 1

    def _close(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return True
        return abs(f1 / n1 - f2 / n2) < self.slack * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, one: int, other: int) -> bool:
        pairs = deque([(one, other)])
        while pairs:
            a, b = pairs.popleft()
            n, m = self.totals[a], self.totals[b]
            if not self._close(self.ends[a], n, self.ends[b], m):
                return False
            for char in self.counts[a].keys() | self.counts[b].keys():
                if not self._close(self.counts[a].get(char, 0), n, self.counts[b].get(char, 0), m):
                    return False
                if char in self.moves[a] and char in self.moves[b]:
                    pairs.append((self.moves[a][char], self.moves[b][char]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add a subtree's frequencies to the states that read the same strings."""
        pairs = deque([(into, tree)])
        while pairs:
            a, b = pairs.popleft()
            self.ends[a] += self.ends[b]
            self.totals[a] += self.totals[b]
            for char, n in self.counts[b].items():
                self.counts[a][char] = self.counts[a].get(char, 0) + n
                if char in self.moves[a]:
                    pairs.append((self.moves[a][char], self.moves[b][char]))
                else:
                    self.moves[a][char] = self.moves[b][char]

    def _merge_states(self) -> None:
        kept = [0]
        while True:
            settled = set(kept)
            border = [(self.totals[q], s, c, q) for s in kept for c, q in self.moves[s].items() if q not in settled]
            if not border:
                return
            _, source, char, state = max(border, key=lambda x: (x[0], -x[1], x[2]))
            for old in kept:
                if self._compatible(old, state):
                    self.moves[source][char] = old
                    self._fold(old, state)
                    break
            else:
                kept.append(state)

    def _logs(self, state: int) -> tuple[dict[str, float], float]:
        """Log probabilities of what the state has seen, and the log weight of all samples' shares for the rest.

        The more different characters follow a state for its visits, the more those shares count.
        """
        counts = self.counts[state] | {END: self.ends[state]}
        total = max(1, self.totals[state])
        kinds = sum(n > 0 for n in counts.values())
        shared = max(kinds, 1) / (total + max(kinds, 1))
        logs = {c: math.log((1 - shared) * n / total + shared * self.shares[c]) for c, n in counts.items() if n}
        return logs, math.log(shared)

    def log_likelihood(self, text: str) -> float:
        """Log probability of a string; characters new to a state stay in place, those new to all cost the floor."""
        state, total = 0, 0.0
        for char in (*text, END):
            logs, shared = self.scores[state]
            known = logs.get(char)
            if known is None:
                total += shared + self.rest[char]
            else:
                total += known
                state = self.moves[state].get(char, state)
        return total


    def by_characters(self, text: str) -> float:
        """Log probability of a string if all states were one."""
        return sum(map(self.rest.__getitem__, text)) + self.rest[END]


def class_of(token: str) -> str:
    lower = token.lower()
    if lower == token.upper():
        return NUMBERS
    if HAS_DIGIT.search(token):
        return MIXED
    return LETTERS if token == lower or any(map(str.islower, token)) else CAPITALS


def order_of(value: str) -> int:
    """The hash that orders samples, as Spark's xxhash64 gives it."""
    bits = xxhash.xxh64_intdigest(value.encode(), SAMPLE_SEED)
    return bits - (1 << 64) if bits >> 63 else bits


class Lowest:
    """The distinct values with the lowest hashes."""

    def __init__(self, size: int):
        self.size, self.held, self.bound = size, {}, 1 << 63

    def add(self, values) -> None:
        for value in values:
            if value not in self.held and (place := order_of(value)) < self.bound:
                self.held[value] = place
        if len(self.held) > 2 * self.size:
            best = sorted(self.held.items(), key=lambda x: x[1])[: self.size]
            self.held, self.bound = dict(best), best[-1][1]


def labelled_values(docs: DataFrame, per_kind: int = 2 * SAMPLE_VALUES) -> DataFrame:
    """(kind, value): distinct credentials of the base patterns, and ordinary tokens by their class.

    All texts are read whole; each task passes on the ``per_kind`` values of a kind with the lowest
    hashes, among which are all of its values that are among the lowest of the whole corpus. Values
    too long for the sample are not in it.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        lowest = {kind: Lowest(per_kind) for kind in (*KINDS, *CLASSES)}
        offered: set[str] = set()
        for batch in batches:
            found = {kind: set() for kind in lowest}
            if len(offered) > OFFERED:
                offered = set()
            for raw in texts_of(batch):
                text = raw.decode("utf-8", "replace")
                taken = base_matches(text)
                for _, kind, _, value in taken:
                    if len(value) <= SAMPLE_CHARS:
                        found[KINDS[kind]].add(value)
                fresh = outside_tokens(text, taken) - offered
                offered |= fresh
                for token in fresh:
                    if len(token) <= SAMPLE_CHARS:
                        found[class_of(token)].add(token)
            for kind, values in found.items():
                lowest[kind].add(values)
        rows = [(kind, value) for kind, low in lowest.items() for value in low.held]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["kind", "value"])

    return docs.select("text").mapInArrow(run, "kind string, value string").distinct()


@dataclass
class Formats:
    """Automata of credentials by kind and of ordinary tokens by class, and the threshold between them."""

    secret: dict[str, Automaton]
    ordinary: dict[str, Automaton]
    threshold: float = math.inf

    def passes(self, token: str) -> bool:
        """Whether the advantage reaches the threshold; most tokens fail a bound of it, which is quicker.

        A character that no credential has costs each of their automata the floor at least.
        """
        ordinary = self.ordinary.get(class_of(token))
        if ordinary is None or not self.secret:
            return False
        known = self.__dict__.get("_known")
        if known is None:
            known = self.__dict__["_known"] = {c for a in self.secret.values() for c in a.shares}
        least = math.log(FLOOR) * sum(char not in known for char in token) - ordinary.by_characters(token)
        return least >= self.threshold and self.advantage(token) >= self.threshold

    def advantage(self, token: str) -> float:
        """Nats by which the likeliest credential format beats the ordinary one; none without either."""
        ordinary = self.ordinary.get(class_of(token))
        if ordinary is None or not self.secret:
            return -math.inf
        plain = max(ordinary.log_likelihood(token), ordinary.by_characters(token))
        return max(a.log_likelihood(token) for a in self.secret.values()) - plain


def within_chars(values: list[str]) -> list[str]:
    """The first values that have SAMPLE_CHARS characters together at most, one at least."""
    total, kept = 0, []
    for value in values:
        total += len(value)
        if kept and total > SAMPLE_CHARS:
            break
        kept.append(value)
    return kept


def learn_formats(values: dict[str, list[str]]) -> Formats:
    """Formats from distinct values of each kind and class: every second one sets the threshold, the others infer.

    The threshold is MARGIN times likelier than all unseen ordinary tokens but a FALSE_SHARE of them.
    """
    learn = lambda kinds: {k: Automaton(within_chars(values[k][::2])) for k in kinds if values.get(k)}
    formats = Formats(learn(KINDS), learn(CLASSES))
    unseen = sorted(formats.advantage(token) for k in CLASSES for token in values.get(k, [])[1::2])
    if unseen:
        highest = unseen[min(len(unseen) - 1, math.ceil(len(unseen) * (1 - FALSE_SHARE)) - 1)]
        formats.threshold = max(0.0, highest) + math.log(MARGIN)
    return formats


def infer_formats(docs: DataFrame, per_kind: int = SAMPLE_VALUES) -> Formats:
    """Formats from 2 * ``per_kind`` distinct values of each kind and class at most, in hash order.

    Without credentials, ordinary tokens or tokens to set a threshold by, no token passes.
    """
    values = materialise(labelled_values(docs, 2 * per_kind))
    order = [F.xxhash64("value"), F.col("value")]
    chosen = {}
    for kind in (*KINDS, *CLASSES):
        rows = values.filter(F.col("kind") == kind).orderBy(*order).limit(2 * per_kind).collect()
        chosen[kind] = [row.value for row in rows]
    return learn_formats(chosen)


class Scanner:
    """Spans of one text after another; scores of tokens are kept for their next occurrence."""

    CACHE = 200_000

    def __init__(self, formats: Formats):
        self.formats, self.seen, self.chars = formats, {}, 0  # characters in ``seen``

    def passes(self, token: str) -> bool:
        known = self.seen.get(token)
        if known is None:
            if len(self.seen) > self.CACHE or self.chars > 20 * self.CACHE:
                self.seen, self.chars = {}, 0
            known = self.seen[token] = self.formats.passes(token)
            self.chars += len(token)
        return known

    def scan(self, text: str):
        """(base spans, format spans) as (start, kind number, end)."""
        taken = base_matches(text)
        passing = {token for token in outside_tokens(text, taken) if self.passes(token)}
        more = [(s, len(KINDS), e) for s, e, token in outside(text, taken) if token in passing] if passing else []
        return [x[:3] for x in taken], more


def listed(spans) -> str:
    names = (*KINDS, "format")
    return ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan_secrets(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans) for every document.

    Offsets are code points, the end exclusive. Null texts count as empty and have no spans;
    without labelled credentials there are none of formats. A token at the threshold passes.
    Repeated rows get equal results; texts of any length are scanned whole. Format spans touch no
    base span. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(infer_formats(docs) if formats is None else formats)

    def make():
        scanner = Scanner(shipped.value)

        def step(batch):
            counts = [[] for _ in range(4)]
            digests, spans = [], []
            for raw in texts_of(batch):
                base, more = scanner.scan(raw.decode("utf-8", "replace"))
                for kind in range(3):
                    counts[kind].append(sum(x[1] == kind for x in base))
                counts[3].append(len(more))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + more))
            return pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"],
            )

        return step

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)
