"""Pairs of messages and applications with something in common, found where a part of the ones meets a part of the others.

What they have in common is as much as messages times applications, so no word, hit or pair is
shuffled. Messages are dealt to parts and applications to blocks; each part meets each block in one
task, which indexes the block's words and reads the messages as they come. It holds a block and a
slab of hits of bounded size, whatever the words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import ship_package

#: Applications of a block and messages of a part, about; messages of very many are dealt to PARTS larger ones.
BLOCK, PART, PARTS = 65_536, 4_096, 256
#: Hits, and cells of message and application, that are looked at at once; and windows of letters.
CELLS, WINDOWS = 1 << 22, 1 << 20
#: Letters by which a long name is looked up.
STEM = 6
#: What a company, two words of a title, and one beside a company tell about a pair.
COMPANY, TITLE, PARTIAL = 10, 3, 1


def meet(messages: DataFrame, applications: DataFrame, lag_ms: int, deciding: bool = False) -> DataFrame:
    """(message_id, app_id, company, title, apart, in_city) of each pair of rows that something identifies.

    ``messages`` are (id, at, words, more, text): distinct words of what is said, those of its sender, and all as
    one word. ``applications`` are (id, at, words, more, text, city): words of the name, of the title, and the
    name as one word, which a text of STEM letters and more may hold anywhere. ``company`` says whether the name is
    there, ``title`` is TITLE, PARTIAL or 0, ``apart`` the milliseconds from the application to the message, which
    may be ``lag_ms`` earlier. ``deciding`` keeps, of each message and block, the pairs that tell most and one of
    those that come next.
    """
    blocks = max(1, -(-applications.count() // BLOCK))
    parts = max(1, min(-(-messages.count() // PART), PARTS))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    shared = ("at", "words", "more", "text")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("block") * parts + F.col("part")).alias("cell")
    m = messages.withColumn("part", dealt(parts, "id", "text")).withColumn("block", every(blocks))
    m = m.select(cell, F.lit(True).alias("is_message"), F.col("id").alias("message_id"), *shared)
    a = applications.withColumn("block", dealt(blocks, "id", "text", "more")).withColumn("part", every(parts))
    a = a.select(cell, F.lit(False).alias("is_message"), F.col("id").alias("app_id"), *shared, "city")
    met = m.unionByName(a, allowMissingColumns=True).repartitionById(blocks * parts, "cell").sortWithinPartitions("cell", "is_message")
    kinds = [df.schema["id"].dataType.simpleString() for df in (messages, applications)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, block = None, [], None
        for batch in batches:
            for cell, is_message, piece in stretches(batch):
                if cell != current:
                    current, rows, block = cell, [], None
                if not is_message:
                    rows.append(piece)
                elif rows:
                    block = block or Block(pa.Table.from_batches(rows))
                    yield from block.pairs(piece, lag_ms, deciding)

    ship_package(messages.sparkSession)
    return met.mapInArrow(run, f"message_id {kinds[0]}, app_id {kinds[1]}, company boolean, title int, apart long, in_city boolean")


def stretches(batch: pa.RecordBatch):
    """(cell, is_message, rows) of rows that have both in common, in order."""
    if not batch.num_rows:
        return
    both = batch["cell"].to_numpy().astype(np.int64) * 2 + batch["is_message"].to_numpy(zero_copy_only=False)
    bounds = [0, *(np.flatnonzero(np.diff(both)) + 1).tolist(), len(both)]
    for lo, hi in zip(bounds, bounds[1:]):
        yield both[lo] // 2, bool(both[lo] % 2), batch.slice(lo, hi - lo)


def slabs(costs: np.ndarray):
    """Slices of at most CELLS of costs, and one more row."""
    told = np.cumsum(costs) // CELLS
    bounds = [0, *(np.flatnonzero(np.diff(told)) + 1).tolist(), len(costs)]
    return [slice(lo, hi) for lo, hi in zip(bounds, bounds[1:]) if hi > lo]


def places(values, among) -> np.ndarray:
    """The place of each value in ``among``; -1 if it isn't there."""
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy(zero_copy_only=False)


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; null texts are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), bounds


def stems(raw: np.ndarray) -> np.ndarray:
    """A number for each STEM bytes that follow each other."""
    n = len(raw) - STEM + 1
    codes = np.zeros(max(n, 0), np.int64)
    for k in range(STEM if n > 0 else 0):
        codes = (codes << 8) | raw[k : k + n]
    return codes


class Lists:
    """Values by key: those of key ``k`` are ``values[starts[k]:starts[k + 1]]``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, n: int):
        self.values = values[np.argsort(keys, kind="stable")].astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))])
        self.sizes = np.diff(self.starts)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes of the lists of ``keys``, their values one after the other)."""
        sizes = self.sizes[keys]
        first = self.starts[keys] - (np.cumsum(sizes) - sizes)
        return sizes, self.values[np.repeat(first, sizes) + np.arange(sizes.sum())]


class Block:
    """Applications by the words of their names and titles, and by the stems of their long names."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        column = lambda name: pa.concat_arrays(rows[name].chunks)
        self.ids, at = column("app_id"), column("at")
        self.n, self.dated, self.at = len(self.ids), at.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(at, 0).to_numpy()
        names, titles, cities = column("words"), column("more"), column("city")
        self.vocabulary = pc.unique(pa.concat_arrays([names.flatten(), titles.flatten(), cities])).drop_null()
        size = len(self.vocabulary)
        by_word = lambda lists: Lists(places(lists.flatten(), self.vocabulary), pc.list_parent_indices(lists).to_numpy(), size)
        self.named, self.titled = by_word(names), by_word(titles)
        self.city = places(pc.fill_null(cities, ""), self.vocabulary)
        self.city = np.where(self.city < 0, size, self.city)  # a word that no message has
        texts = column("text")
        long = pc.fill_null(pc.greater_equal(pc.binary_length(texts), STEM), False)
        of = np.flatnonzero(long.to_numpy(zero_copy_only=False))
        distinct = pc.unique(texts.filter(long))
        self.raw, bounds = letters(distinct)
        self.begin, self.length = bounds[:-1], np.diff(bounds)
        self.owners = Lists(places(texts.filter(long), distinct), of, len(distinct))
        codes, which = np.unique(stems(self.raw)[self.begin] if len(distinct) else np.zeros(0, np.int64), return_inverse=True)
        self.stems, self.begun = pa.array(codes), Lists(which, np.arange(len(distinct)), len(codes))
        self.width = max(self.n, size + 1)
        self.company, self.once, self.twice, self.said = np.zeros((4, CELLS + self.width), bool)

    def long_names(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, long name) wherever one stands in a text, by row; some more than once."""
        raw, bounds = letters(texts)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for lo in range(int(bounds[0]), int(bounds[-1]), WINDOWS) if len(self.stems) else ():
            stem = places(pa.array(stems(raw[lo : min(lo + WINDOWS + STEM - 1, int(bounds[-1]))])), self.stems)
            at = np.flatnonzero(stem >= 0)
            stem = stem[at]
            for part in slabs(self.begun.sizes[stem]):
                sizes, name = self.begun.of(stem[part])
                where = np.repeat(at[part] + lo, sizes)
                row = np.searchsorted(bounds, where, "right") - 1
                fits = where + self.length[name] <= bounds[row + 1]
                where, row, name = where[fits], row[fits], name[fits]
                k = STEM
                while len(name):
                    whole = self.length[name] == k
                    found.append((row[whole], name[whole]))
                    where, row, name = where[~whole], row[~whole], name[~whole]
                    same = raw[where + k] == self.raw[self.begin[name] + k]
                    where, row, name, k = where[same], row[same], name[same], k + 1
        row, name = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(row, kind="stable")
        return row[order], name[order]

    def pairs(self, rows: pa.RecordBatch, lag_ms: int, deciding: bool) -> Iterator[pa.RecordBatch]:
        """The pairs of some messages, slab by slab."""
        words, senders = (self.words_of(rows[name]) for name in ("words", "more"))
        inside = self.long_names(rows["text"])
        total = lambda of, weights: np.bincount(of[0], weights=weights, minlength=rows.num_rows)
        costs = self.width + total(words, self.titled.sizes[words[1]] + self.named.sizes[words[1]])
        costs = costs + total(senders, self.named.sizes[senders[1]]) + total(inside, self.owners.sizes[inside[1]])
        at = rows["at"]
        dated, sent = at.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(at, 0).to_numpy()
        for slab in slabs(costs.astype(np.int64)):
            cut = lambda of: tuple(c[slice(*np.searchsorted(of[0], (slab.start, slab.stop)))] for c in of)  # noqa: B023, E731
            row, app, company, title, in_city = self.identified(slab.start, cut(words), cut(senders), cut(inside))
            row = row + slab.start
            apart, known = sent[row] - self.at[app], dated[row] & self.dated[app]
            keep = ~known | (apart >= -lag_ms)
            if deciding:
                keep[keep] = first_two(row[keep] - slab.start, (COMPANY * company + title)[keep])
            if keep.any():
                columns = [rows["message_id"].take(pa.array(row[keep])), self.ids.take(pa.array(app[keep])), pa.array(company[keep]), pa.array(title[keep], pa.int32())]
                columns += [pa.array(apart[keep], pa.int64(), mask=~known[keep]), pa.array(in_city[keep])]
                yield pa.RecordBatch.from_arrays(columns, ["message_id", "app_id", "company", "title", "apart", "in_city"])

    def words_of(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of the words that an application has, by row."""
        row, word = pc.list_parent_indices(lists).to_numpy(), places(lists.flatten(), self.vocabulary)
        return row[word >= 0], word[word >= 0]

    def identified(self, start: int, words, senders, inside):
        """(row, application, company, title, in_city) of the pairs in a slab that begins at row ``start``."""
        named = np.sort(np.concatenate([self.cells(start, self.named, words), self.cells(start, self.named, senders), self.cells(start, self.owners, inside)]))
        titled = np.sort(self.cells(start, self.titled, words))
        named, twice = named[changes(named)], titled[~changes(titled)]
        self.company[named], self.once[titled], self.twice[twice] = True, True, True
        alone = twice[changes(twice) & ~self.company[twice]]
        pair, company = np.concatenate([named, alone]), np.arange(len(named) + len(alone)) < len(named)
        title = np.where(self.twice[pair], TITLE, np.where(self.once[pair] & company, PARTIAL, 0))
        self.company[named], self.once[titled], self.twice[twice] = False, False, False
        row, app = np.divmod(pair, np.int32(self.n))
        said = (words[0] - start) * (len(self.vocabulary) + 1) + words[1]
        self.said[said] = True
        in_city = self.said[row * (len(self.vocabulary) + 1) + self.city[app]]
        self.said[said] = False
        return row, app, company, title, in_city

    def cells(self, start: int, lists: Lists, of: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The numbers, from row ``start``, of the pairs of (row, key) and all that ``lists`` has of the key."""
        sizes, apps = lists.of(of[1])
        return np.repeat(((of[0] - start) * self.n).astype(np.int32), sizes) + apps


def changes(ordered: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before it."""
    return np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]


def first_two(row: np.ndarray, identity: np.ndarray) -> np.ndarray:
    """Whether a pair is of the highest identity of its row, or the first of the next one's."""
    keep, rank = np.zeros(len(row), bool), np.zeros(row.max(initial=-1) + 1, np.int8)
    for level in np.unique(identity)[::-1]:
        here = np.flatnonzero(identity == level)
        before = rank[row[here]]
        keep[here[before == 0]] = True
        seconds, first = np.unique(row[here[before == 1]], return_index=True)
        keep[here[before == 1][first]] = True
        rank[row[here]] = np.where(before == 0, 1, 2)
    return keep
