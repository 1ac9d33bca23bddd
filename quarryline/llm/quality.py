"""Quality: random-indexing word vectors, pooled per document, and a two-layer network.

The most frequent plain words of the corpus are units of their own; rarer ones share units by
a hash of their letters, all other words by a hash of their shape, and a word that repeats its
neighbour has a unit of a third kind. Each unit has a sparse random index vector; its word
vector is the sum of the index vectors of its neighbours over the whole corpus. A document is
the mean of its units' word and index vectors. A small numpy network learns the labels, and a
temperature fitted on rows it has not seen calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.arrow import column_of, map_batches, texts_of
from quarryline.llm.language_id import remainder
from quarryline.session import materialise, ship_package

HELD_OUT_OF, HELD_OUT_REST = 4, 2
PREDICT_AT = 0.7
#: Plain words with units of their own; units that rarer plain words share, and those of shapes.
VOCABULARY, PLAIN, SHAPES = 8192, 2048, 1024
SHARED = PLAIN + SHAPES
#: Shared units, those of the vocabulary, repeats of either by their shared unit, and the gap.
UNITS = SHARED + VOCABULARY + SHARED + 1
REPEATS = SHARED + VOCABULARY
#: Levels of word counts for each factor of two.
LEVELS = 16
#: Dimensions and non-zero entries of index vectors.
DIMENSIONS, NONZERO = 64, 4
#: Neighbours on each side that a word vector adds up.
REACH = 2
#: Bound of the training sample: labelled documents. One in CALIBRATE_OF fits the temperature.
SAMPLE_DOCS = 8000
CALIBRATE_OF = 5
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 0.01, 1e-4
#: Distinct words whose units a task keeps at a time, and tokens whose neighbours it adds at once.
CACHE_WORDS = 200_000
CHUNK = 1 << 18

_random = np.random.default_rng(7)
INDEX_AT = _random.integers(0, DIMENSIONS, (UNITS, NONZERO))
INDEX_SIGN = _random.choice([-1.0, 1.0], (UNITS, NONZERO))
INDEX = np.zeros((UNITS, DIMENSIONS))
INDEX_SIGN[-1] = 0
np.add.at(INDEX, (np.repeat(np.arange(UNITS), NONZERO), INDEX_AT.ravel()), INDEX_SIGN.ravel())

RUNS = re.compile(r"(.)\1+", re.DOTALL)
#: Between two texts; no word has this unit.
GAP = np.full(REACH, UNITS - 1)


def plain_word(word: str) -> str | None:
    """The letters of a plain word in lower case; others have none."""
    bare = word.strip(".,;:")
    return bare.lower() if bare.isalpha() and (bare[1:].islower() or len(bare) == 1) else None


def shape_unit(word: str) -> int:
    shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return PLAIN + zlib.crc32(RUNS.sub(r"\1\1", shape).encode()) % SHAPES


def units_of(word: str, vocabulary: dict[str, int]) -> tuple[int, int]:
    """The unit of a word, and of its repeat: rare plain words share theirs by their letters, all others by their shape."""
    bare = plain_word(word)
    if bare is None:
        shared = shape_unit(word)
        return shared, REPEATS + shared
    shared, own = zlib.crc32(bare.encode()) % PLAIN, vocabulary.get(bare)
    return shared if own is None else SHARED + own, REPEATS + shared


class Units(dict):
    """Word -> number in order of arrival; ``units`` and ``repeats`` give their units."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary, self.units, self.repeats, self.chars = vocabulary, [], [], 0

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        unit, repeat = units_of(word, self.vocabulary)
        self.chars += len(word)
        self.units.append(unit)
        self.repeats.append(repeat)
        return number


class Reader:
    """Texts to unit numbers."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known = Units(self.vocabulary)
        self.table = np.zeros((2, 1024), np.int64)  # units, and those of repeats

    def units(self, text: bytes) -> np.ndarray:
        words = text.decode("utf-8", "replace").split()
        if len(self.known) > CACHE_WORDS or self.known.chars > 16 * CACHE_WORDS:
            self._forget()
        had = len(self.known)
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > had:
            while len(self.known) > self.table.shape[1]:
                self.table = np.concatenate((self.table, np.zeros_like(self.table)), axis=1)
            self.table[:, had : len(self.known)] = self.known.units[had:], self.known.repeats[had:]
        units = self.table[0, numbers]
        again = np.flatnonzero(numbers[1:] == numbers[:-1]) + 1
        units[again] = self.table[1, numbers[again]]
        return units


def vocabulary_of(docs: DataFrame, size: int = VOCABULARY) -> dict[str, int]:
    """The ``size`` most frequent plain words of all documents, ties by their letters, numbered by letters.

    Tasks count words and pass their counts on whenever they hold CACHE_WORDS different ones.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        counts: Counter = Counter()

        def told():
            plain: Counter = Counter()
            for word, n in counts.items():
                if (bare := plain_word(word)) is not None:
                    plain[bare] += n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(plain), pa.string()), pa.array(list(plain.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in texts_of(batch):
                counts.update(text.decode("utf-8", "replace").split())
                if len(counts) > CACHE_WORDS:
                    yield told()
        yield told()

    words = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    level = F.floor(F.log2("n") * LEVELS)
    counted = materialise(words.withColumn("level", level))
    # whole levels of counts come first, so that only words of the last one are put in order
    room, last, whole = size, None, []
    for row in sorted(counted.groupBy("level").count().collect(), reverse=True):
        if row["count"] > room:
            last = row.level
            break
        room -= row["count"]
        whole.append(row.level)
    chosen = [r.word for r in counted.filter(F.col("level") >= min(whole)).select("word").collect()] if whole else []
    if last is not None:
        chosen += [r.word for r in counted.filter(F.col("level") == last).orderBy(F.desc("n"), "word").limit(room).collect()]
    return {word: i for i, word in enumerate(sorted(chosen))}


def add_neighbours(total: np.ndarray, units: np.ndarray) -> None:
    """Add each token's neighbours' index vectors to its unit's row."""
    flat = total.reshape(-1)
    for step in range(1, REACH + 1):
        if len(units) > step:
            one, other = np.concatenate((units[:-step], units[step:])), np.concatenate((units[step:], units[:-step]))
            cells = ((one * DIMENSIONS)[:, None] + INDEX_AT[other]).ravel()
            flat += np.bincount(cells, INDEX_SIGN[other].ravel(), UNITS * DIMENSIONS)


def corpus_vectors(docs: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """Word vectors of all units over all documents, one row each, at length 1.

    Every task adds up its own documents; the table of UNITS rows is all that is shuffled and
    brought to the driver. Sums are of whole numbers, so they do not depend on the order.
    """
    ship_package(docs.sparkSession)
    names = [f"d{i}" for i in range(DIMENSIONS)]
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        reader, total = Reader(shipped.value), np.zeros((UNITS, DIMENSIONS))
        waiting, size = [], 0
        for batch in batches:
            for text in texts_of(batch):
                units = reader.units(text)
                waiting += [units, GAP]
                size += len(units)
                if size >= CHUNK:
                    add_neighbours(total, np.concatenate(waiting))
                    waiting, size = [], 0
        if size:
            add_neighbours(total, np.concatenate(waiting))
        used = np.flatnonzero(np.abs(total[: UNITS - 1]).sum(axis=1))
        columns = [pa.array(used), *(pa.array(total[used, i].astype(np.int64)) for i in range(DIMENSIONS))]
        yield pa.RecordBatch.from_arrays(columns, names=["unit", *names])

    parts = docs.select("text").mapInArrow(run, "unit long, " + ", ".join(f"{n} long" for n in names))
    rows = parts.groupBy("unit").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    vectors = np.zeros((UNITS, DIMENSIONS))
    if rows.num_rows:
        vectors[rows["unit"].to_numpy()] = np.column_stack([rows[n].to_numpy() for n in names])
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def pooled(table: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Features of a document: mean vectors of its units, and its length."""
    used, counts = np.unique(units, return_counts=True)
    mean = counts @ table[used] / max(1, len(units))
    return np.append(mean, np.log1p(len(units)) / 10)


class Network:
    """Two layers in numpy, standardised inputs, and a temperature."""

    def __init__(self, width: int, seed: int = 11):
        random = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w1 = random.normal(0, 1 / np.sqrt(width), (width, HIDDEN))
        self.b1, self.b2 = np.zeros(HIDDEN), np.zeros(1)
        self.w2 = random.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1))
        self.temperature = 1.0
        self.random = random

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2)[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        parts = [self.w1, self.b1, self.w2, self.b2]
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        step = 0
        for _ in range(EPOCHS):
            order = self.random.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                hidden = np.tanh(x[rows] @ self.w1 + self.b1)
                error = (1 / (1 + np.exp(-(hidden @ self.w2 + self.b2)[:, 0])) - y[rows])[:, None] / len(rows)
                back = error @ self.w2.T * (1 - hidden**2)
                slopes = [x[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
                step += 1
                for p, g, m, v in zip(parts, slopes, first, second, strict=True):
                    g = g + DECAY * p
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss on rows that ``fit`` has not seen."""
        logits = self.logit(x)

        def loss(t: float) -> float:
            z = logits / t
            return float(np.mean(np.logaddexp(0, z) - y * z))

        self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))


def labelled_features(docs: DataFrame, labels: DataFrame, vocabulary: dict[str, int], table: np.ndarray) -> DataFrame:
    """(doc_id, quality, features) of at most SAMPLE_DOCS labels that are not held out, in hash order.

    A label that repeats counts once. An id that repeats in ``docs`` gives one text, the least one.
    """
    allowed = labels.filter(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
        & (remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT_REST)
    ).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = allowed.distinct().orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id", "quality").limit(SAMPLE_DOCS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, table))

    def make():
        words, vectors = shipped.value
        reader = Reader(words)

        def step(batch):
            rows = [pooled(vectors, reader.units(text)).tolist() for text in texts_of(batch)]
            return pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), column_of(batch, "quality"), pa.array(rows, pa.list_(pa.float64()))],
                names=["doc_id", "quality", "features"],
            )

        return step

    return map_batches(texts.select("doc_id", "quality", "text"), make, "doc_id long, quality int, features array<double>")


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, int], np.ndarray, Network]:
    """Vocabulary and word vectors of the whole corpus, and the calibrated network."""
    vocabulary = vocabulary_of(docs)
    table = np.hstack((corpus_vectors(docs, vocabulary), INDEX / np.sqrt(NONZERO)))
    rows = labelled_features(docs, labels, vocabulary, table).collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality))
    network = Network(table.shape[1] + 1)
    if rows:
        x, y = np.array([r.features for r in rows]), np.array([r.quality for r in rows], float)
        aside = np.array([zlib.crc32(f"c{r.doc_id}".encode()) % CALIBRATE_OF == 0 for r in rows])
        network.fit(x[~aside] if (~aside).any() else x, y[~aside] if (~aside).any() else y)
        if aside.any():
            network.calibrate(x[aside], y[aside])
    return vocabulary, table, network


def score_quality(docs: DataFrame, vocabulary: dict[str, int], table: np.ndarray, network: Network) -> DataFrame:
    """(doc_id, score, predicted) for every document.

    Null and empty texts have no words and get the score of an empty document. Equal texts get
    equal scores, repeated rows included; a score at the limit is predicted 1. Texts of any length
    are read whole. Without labelled documents the network is untrained: scores are finite but say
    nothing. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, table, network))

    def make():
        words, vectors, model = shipped.value
        reader = Reader(words)

        def step(batch):
            scores = model.probability(np.array([pooled(vectors, reader.units(text)) for text in texts_of(batch)]))
            return pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), pa.array(scores), pa.array((scores >= PREDICT_AT).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, make, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels that are not held out and score every document.

    (doc_id, held_out, score, predicted); awkward rows are treated as in :func:`score_quality`.
    """
    held_out = remainder(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT_REST
    return score_quality(docs, *train(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
