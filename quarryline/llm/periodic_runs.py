"""Periodic runs of words, by longest previous factors.

The words of many texts are put behind each other, each text with letters and an end mark of
its own, so that no match crosses texts. Then, per batch:

* a suffix array by prefix doubling, and LCP values from the ranks of all doublings;
* the longest previous factor of each place: the nearest smaller places on both sides in the
  suffix array, with the least LCP on the way;
* LZ blocks from those factors;
* Main's step: a run that crosses or touches the start of a block has a period below a third
  (for exponents of four) of the two blocks there, so these periods alone are extended from
  that place to both sides, over equal ranks, in as many steps as the match has doublings;
* runs strictly inside a block are those of its earlier copy, moved from bucket to bucket of
  their starts.

Work is linear but for the doublings, which only places in repeats longer than that take part
in. A task holds one batch of words, or one text where that is longer.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.arrow import column_of, map_batches, texts_of

#: Words of the texts that are worked on together.
BATCH_WORDS = 200_000
#: Rounds of pointer jumps before places are walked one by one.
JUMPS = 64
MIN_WORDS, MIN_EXPONENT = 6, 4
RUNS_SQL = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def doublings(letters: np.ndarray) -> list[np.ndarray]:
    """Ranks by the first 1, 2, 4, ... letters, until all differ: equal ranks are equal stretches.

    Letters count from zero without gaps. Ties of a rank are the only places sorted again.
    """
    sizes = np.bincount(letters)
    begins = np.cumsum(sizes) - sizes
    rank = begins[letters]
    found = [rank]
    open_places = np.flatnonzero(sizes[letters] > 1)
    reach, total = 1, letters.size
    while open_places.size:
        after = np.minimum(open_places + reach, total - 1)
        key = rank[open_places] * (total + 1) + np.where(open_places + reach < total, rank[after] + 1, 0)
        order = np.argsort(key)
        open_places, key = open_places[order], key[order]
        was = rank[open_places]
        at = np.arange(key.size)
        fresh = np.append(True, key[1:] != key[:-1])
        group = np.append(True, was[1:] != was[:-1])
        rank = rank.copy()
        rank[open_places] = was + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        found.append(rank)
        alone = fresh & np.append(fresh[1:], True)
        open_places = open_places[~alone]
        reach *= 2
    return found


def common(ranks: list[np.ndarray], one: np.ndarray, other: np.ndarray, back: bool = False) -> np.ndarray:
    """How many letters are equal from each place of ``one`` and of ``other`` on, forwards or backwards.

    A place of ``one`` may be -1 (nothing before it). Levels go up while whole stretches are equal,
    then down over what follows.
    """
    length = np.zeros(one.size, np.int64)
    alive, climbed = np.arange(one.size), []

    def same(level: int, rows: np.ndarray) -> np.ndarray:
        done = length[rows]
        shift = -(done + (1 << level) - 1) if back else done
        a, b = one[rows] + shift, other[rows] + shift
        return (a >= 0) & (b >= 0) & (ranks[level][a] == ranks[level][b])

    for level in range(len(ranks)):
        alive = alive[same(level, alive)]
        if not alive.size:
            break
        climbed.append(alive)
    for level in range(len(climbed) - 1, -1, -1):
        rows = climbed[level]
        length[rows[same(level, rows)]] += 1 << level
    return length


def nearest_smaller(places: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a suffix array: the row of the nearest smaller place before it, and the least LCP up to there.

    Rows whose LCP comes to nought are left where they are. Rows jump over what the row they stand
    on has jumped over; long chains of settled rows are walked in order, each once.
    """
    at = np.arange(places.size) - 1
    least = lcp.copy()
    least[0] = 0
    open_rows = np.flatnonzero(least > 0)
    open_rows = open_rows[places[at[open_rows]] > places[open_rows]]
    for _ in range(JUMPS):
        if not open_rows.size:
            return at, least
        stand = at[open_rows]
        least[open_rows], at[open_rows] = np.minimum(least[open_rows], least[stand]), at[stand]
        open_rows = open_rows[least[open_rows] > 0]
        open_rows = open_rows[places[at[open_rows]] > places[open_rows]]
    where, row_at, row_least = places.tolist(), at.tolist(), least.tolist()
    for row in np.sort(open_rows).tolist():
        stand, low = row_at[row], row_least[row]
        while low > 0 and where[stand] > where[row]:
            low, stand = min(low, row_least[stand]), row_at[stand]
        row_at[row], row_least[row] = stand, low
    return np.array(row_at), np.array(row_least)


def previous_factors(ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the length of its longest match that starts earlier, and where that starts (-1: none)."""
    total = ranks[-1].size
    suffixes = np.empty(total, np.int64)
    suffixes[ranks[-1]] = np.arange(total)
    lcp = np.zeros(total, np.int64)
    lcp[1:] = common(ranks, suffixes[:-1], suffixes[1:])
    before, low_before = nearest_smaller(suffixes, lcp)
    turned, low_turned = nearest_smaller(suffixes[::-1].copy(), np.append(0, lcp[:0:-1]))
    after, low_after = total - 1 - turned[::-1], low_turned[::-1]
    length, source = np.zeros(total, np.int64), np.full(total, -1)
    best = np.maximum(low_before, low_after)
    chosen = np.where(low_before >= low_after, before, after)
    some = best > 0
    length[suffixes[some]] = best[some]
    source[suffixes[some]] = suffixes[chosen[some]]
    return length, source


def blocks(lengths: np.ndarray) -> np.ndarray:
    """Starts of the LZ blocks: each is its longest previous factor, or one letter."""
    following = (np.arange(lengths.size) + np.maximum(1, lengths)).tolist()
    starts, at = [], 0
    while at < len(following):
        starts.append(at)
        at = following[at]
    return np.array(starts, np.int64)


def boundary_runs(ranks, starts, sizes, end_mark, begin_of, end_of, min_words: int, min_exponent: int):
    """(start, end, period) of the runs that cross or touch the start of a block, one for each stretch."""
    inner = np.flatnonzero(~end_mark[starts - 1] & (starts > 0))
    ahead = np.where(end_mark[starts], 0, sizes)[inner]
    most = (sizes[inner - 1] + ahead - 1) // (min_exponent - 1)
    inner, most = inner[most > 0], most[most > 0]
    if not inner.size:
        return []
    border = np.repeat(starts[inner], most)
    period = np.arange(border.size) - np.repeat(np.cumsum(most) - most, most) + 1
    text_begin, text_end = begin_of[border], end_of[border]
    root = np.concatenate([border, border - period])
    period = np.concatenate([period, period])
    fits = (root >= np.tile(text_begin, 2)) & (root + period <= np.tile(text_end, 2))
    root, period = root[fits], period[fits]
    right = common(ranks, root, root + period)
    left = common(ranks, root - 1, root + period - 1, back=True)
    begin, end = root - left, root + period + right
    long = end - begin >= np.maximum(min_words, min_exponent * period)
    shortest: dict[tuple[int, int], int] = {}
    for b, e, p in zip(begin[long].tolist(), end[long].tolist(), period[long].tolist(), strict=True):
        shortest[b, e] = min(p, shortest.get((b, e), p))
    return [(b, e, p) for (b, e), p in shortest.items()]


def copied_runs(buckets: dict[int, list[tuple[int, int]]], factors, min_words: int) -> None:
    """Add the runs strictly inside each (start, end, source): those that start in the copied place, moved; blocks in order."""
    for begin, end, source in factors:
        moved = begin - source
        for at in range(begin + 1, end - min_words):
            for stop, period in buckets.get(at - moved, ()):
                if stop + moved < end:
                    buckets.setdefault(at, []).append((stop + moved, period))


def batch_runs(texts: list[list[bytes]], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each list of words, by start and period."""
    parts, begins, offset, at = [], [], 0, 0
    for words in texts:
        numbers = dict.fromkeys(words)
        numbers = dict(zip(numbers, range(offset, offset + len(numbers)), strict=True))
        offset += len(numbers) + 1
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([offset - 1]))
        begins.append(at)
        at += len(words) + 1
    letters, begins = np.concatenate(parts), np.array(begins, np.int64)
    lengths = np.diff(np.append(begins, at))
    begin_of, end_of = np.repeat(begins, lengths), np.repeat(np.append(begins[1:], at) - 1, lengths)
    end_mark = np.zeros(at, bool)
    end_mark[end_of] = True
    ranks = doublings(letters)
    factor, source = previous_factors(ranks)
    starts = blocks(factor)
    sizes = np.diff(np.append(starts, at))
    by_text: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for begin, end, period in boundary_runs(ranks, starts, sizes, end_mark, begin_of, end_of, min_words, min_exponent):
        by_text.setdefault(int(begin_of[begin]), {}).setdefault(begin, []).append((end, period))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    index = {begin: i for i, begin in enumerate(begins.tolist())}
    for begin, buckets in by_text.items():
        here = slice(*np.searchsorted(starts, [begin, end_of[begin]]))
        wide = np.flatnonzero(sizes[here] >= min_words + 2) + here.start
        copied_runs(buckets, zip(starts[wide].tolist(), (starts[wide] + sizes[wide]).tolist(), source[starts[wide]].tolist(), strict=True), min_words)
        found[index[begin]] = sorted((start - begin, end - start, p) for start, runs in buckets.items() for end, p in runs)
        found[index[begin]].sort(key=lambda run: (run[0], run[2]))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space: of each run its first period stays."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period), collapsed.

    A run is a stretch of consecutive words ``[^\\x20\\x09-\\x0D]+`` with smallest period p, of at
    least ``min_words`` words and ``min_exponent`` (two or more) periods, that no word beside it
    extends. ``collapsed`` has the words outside runs and of each run's first period, joined by a
    space. Runs come by start, then period. A null, empty or wordless text has no runs and an empty
    ``collapsed``; texts of any length are read whole, and the longest is what a task holds. Repeated
    rows have a row each, a null doc_id stays null; an empty table gives no rows; no column but
    doc_id and text is read.
    """
    if min_exponent < 2 or min_words < 2:
        raise ValueError("runs have two words and two periods or more")
    pair = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [text.split() for text in texts_of(batch)]
            runs, first, held = [], 0, 0
            for i, words in enumerate(texts):
                held += len(words)
                if held >= BATCH_WORDS or i == len(texts) - 1:
                    runs += batch_runs(texts[first : i + 1], min_words, min_exponent)
                    first, held = i + 1, 0
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs]
            kept = [collapse(words, found) for words, found in zip(texts, runs, strict=True)]
            return pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), pa.array(rows, pa.list_(pair)), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "runs", "collapsed"],
            )

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, RUNS_SQL)


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest exponent, compared exactly; ties: smallest start, then period."""
    return min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]))


def planted_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth hash of an id makes the tail of its text periodic.

    With h = crc32 of the decimal id, g = h / 10 and n words, texts with h % 10 = 0 repeat the words
    from a = g % n on with period 1 + (n - a) / (3 + g % 8). A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    parts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.floor(h / 10).alias("g"),
        F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")).alias("words"),
    )
    size = "CAST(size(words) AS BIGINT)"
    cut = parts.withColumn("a", F.expr(f"IF(size(words) > 0, g % {size}, NULL)"))
    cut = cut.withColumn("p", F.expr(f"1 + ({size} - a) DIV (3 + g % 8)"))
    tail = "flatten(array_repeat(slice(words, int(a) + 1, int(p)), int((size(words) - a) DIV p + 1)))"
    whole = F.expr(f"array_join(concat(slice(words, 1, int(a)), slice({tail}, 1, int(size(words) - a))), ' ')")
    return cut.select("doc_id", F.when(F.col("p").isNotNull(), whole).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Of each row of :func:`find_runs`: number of runs, the one of greatest exponent (compared exactly), and hashes."""
    better = (
        "(l, r) -> CASE WHEN l.length * r.period > r.length * l.period THEN -1 WHEN l.length * r.period < r.length * l.period THEN 1"
        " WHEN l.start < r.start OR (l.start = r.start AND l.period < r.period) THEN -1 WHEN l = r THEN 0 ELSE 1 END"
    )
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    ranked = found.withColumn("best", F.expr(f"get(array_sort(runs, {better}), 0)"))
    return ranked.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
