"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen word falls back to its
character n-grams: at each position the longest known n-gram decides, four characters
first, then three, two and one, at a penalty for each step. The model is counted from a
bounded sample of labelled documents; texts are scored whole. Words are runs of letters and
combining marks, in the sample and in scored texts alike.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.arrow import column_of, map_batches, texts_of
from quarryline.session import broadcast_within, materialise

UNKNOWN = "und"
#: Bound of the training sample: labelled documents of each language. The model has all their words and n-grams.
SAMPLE_DOCS = 600
#: Times the expected share of hashes that is ranked for the sample, and languages and ids that are broadcast.
MARGIN, BROADCAST_LANGS, BROADCAST_IDS = 1.5, 10_000, 200_000
GRAM_LENGTHS = (4, 3, 2, 1)
#: Each step to shorter n-grams multiplies the likelihood by this.
BACKOFF = 0.4
#: Tokens whose scores a task keeps at a time.
CACHE_WORDS = 100_000
#: A word, for Java and for Python: letters with the marks that belong to them.
WORD = r"\p{L}[\p{L}\p{M}]*"
WORDS = regex.compile(WORD)
HELD_OUT_OF, HELD_OUT_REST = 5, 0


def remainder(doc_id, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def training_sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text) of at most ``per_lang`` labelled ids a language, in hash order.

    Hashes are uniform, so the share of a language's documents that ``per_lang`` is says below
    which hash nearly all of the first ones lie. Only those are ranked, in narrow rows; the few
    that are chosen then fetch their texts. An id that repeats in a language gives one text, the
    least one.
    """
    usable = docs.filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT_REST)
    )
    sizes = materialise(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lang")))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    early = (
        usable.select("doc_id", "lang", place.alias("place"))
        .join(broadcast_within(sizes, BROADCAST_LANGS), "lang")
        .filter(F.col("place") < MARGIN * per_lang / F.col("n_lang"))
    )
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = early.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_lang)
    chosen = materialise(chosen.select("doc_id", "lang").distinct())
    texts = usable.select("doc_id", "lang", "text").join(
        broadcast_within(chosen, BROADCAST_IDS), ["doc_id", "lang"], "left_semi"
    )
    return texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")


class Model:
    """Log frequencies of words and n-grams in each language.

    Tables map a key to a row of a matrix with a column for each language. Row 0 of the n-grams
    is that of a character never seen; the others have the penalty of their length included.
    """

    def __init__(self, langs, words, word_rows, grams, gram_rows):
        self.langs, self.words, self.word_rows, self.grams, self.gram_rows = langs, words, word_rows, grams, gram_rows

    def backoff_rows(self, word: str) -> list[int]:
        """The row of the longest known n-gram at each position of an unseen word."""
        padded, find = f"<{word}>", self.grams.get
        a, b, c, d = GRAM_LENGTHS
        return [
            find(padded[i : i + a]) or find(padded[i : i + b]) or find(padded[i : i + c]) or find(padded[i : i + d]) or 0
            for i in range(len(padded))
        ]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language."""
        scores = np.zeros((len(words), len(self.langs)))
        known = [(i, self.words[w]) for i, w in enumerate(words) if w in self.words]
        if known:
            at, rows = zip(*known, strict=True)
            scores[list(at)] = self.word_rows[list(rows)]
        fresh = [i for i, w in enumerate(words) if w not in self.words]
        if fresh:
            rows = [self.backoff_rows(words[i]) for i in fresh]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
            sums = np.add.reduceat(self.gram_rows[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])))
            scores[fresh] = sums / sizes[:, None]
        return scores


def train(docs: DataFrame) -> Model:
    """Count the model over the training sample, which bounds its tables.

    Words and n-grams seen once are left to shorter n-grams.
    """
    sample = materialise(training_sample(docs))
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not langs:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((1, 0)))
    found = F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))
    counted = materialise(
        sample.select("lang", F.explode(found).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    )
    padded = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    pieces = F.flatten(F.array(*[grams_of(padded, n) for n in GRAM_LENGTHS]))
    grams = (
        counted.select("lang", F.explode(pieces).alias("gram"), "n")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("size", F.length("gram"))
    )
    index = {lang: i for i, lang in enumerate(langs)}
    words, word_rows = log_table(counted.filter("n > 1").select("lang", "word", "n", F.lit(0)), index, 0.1)
    grams, gram_rows = log_table(grams.filter("n > 1").select("lang", "gram", "n", "size"), index, 0.5)
    for gram, row in grams.items():
        gram_rows[row] += (GRAM_LENGTHS[0] - len(gram)) * np.log(BACKOFF)
    shifted = {gram: row + 1 for gram, row in grams.items()}
    return Model(langs, words, word_rows, shifted, np.concatenate((np.zeros((1, len(langs))), gram_rows)))


def grams_of(word, length: int) -> F.Column:
    """All pieces of a word with so many characters, in order."""
    starts = F.sequence(F.lit(1), F.length(word) - length + 1)
    # a function of one argument: a second one would get the element's position
    return F.transform(F.when(F.length(word) >= length, starts).otherwise(F.array()), lambda i: F.substring(word, i, F.lit(length)))


def log_table(rows: DataFrame, index: dict, smooth: float) -> tuple[dict[str, int], np.ndarray]:
    """(lang, key, n, size) of bounded tables to a row number for each key, and log frequencies among keys of its size."""
    found = sorted(tuple(row) for row in rows.toLocalIterator() if row[0] in index)
    keys: dict[str, int] = {}
    for row in found:
        keys.setdefault(row[1], len(keys))
    counts, sizes = np.zeros((len(keys), len(index))), np.zeros(len(keys), np.int64)
    for lang, key, n, size in found:
        counts[keys[key], index[lang]] += n
        sizes[keys[key]] = size
    for size in np.unique(sizes):
        own = sizes == size
        counts[own] = np.log((counts[own] + smooth) / (counts[own].sum(axis=0) + smooth * own.sum()))
    return keys, counts


class Scores(dict):
    """Token -> row of a growing score matrix; new tokens are scored together when a text needs them."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.fresh, self.chars = model, [], 0
        self.matrix, self.words = np.zeros((1024, len(model.langs))), np.zeros(1024)

    def __missing__(self, token: str) -> int:
        self[token] = row = len(self)
        self.fresh.append(token)
        self.chars += len(token)
        return row

    def settle(self) -> None:
        """Score the tokens that came up since the last time."""
        if not self.fresh:
            return
        while len(self) > len(self.matrix):
            self.matrix = np.concatenate((self.matrix, np.zeros_like(self.matrix)))
            self.words = np.concatenate((self.words, np.zeros_like(self.words)))
        split = [WORDS.findall(token.lower()) for token in self.fresh]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        scores = self.model.word_scores(list(chain.from_iterable(split)))
        rows = np.arange(len(self) - len(self.fresh), len(self))
        np.add.at(self.matrix, np.repeat(rows, sizes), scores)
        self.words[rows] = sizes
        self.fresh = []

    def trimmed(self) -> Scores:
        return self if len(self) < CACHE_WORDS and self.chars < 16 * CACHE_WORDS else Scores(self.model)


def predict(model: Model, scores: Scores, text: str) -> tuple[str, float]:
    """The likeliest language of a whole text, with its share of the evidence."""
    tokens = text.split()
    if not model.langs or not tokens:
        return UNKNOWN, 0.0
    rows = np.fromiter(map(scores.__getitem__, tokens), np.int64, len(tokens))
    scores.settle()
    words = scores.words[rows].sum()
    if not words:
        return UNKNOWN, 0.0
    total = scores.matrix[rows].sum(axis=0)
    # words are not independent: the evidence of n of them counts as that of sqrt(n)
    likely = np.exp((total - total.max()) / np.sqrt(words))
    best = int(likely.argmax())
    return model.langs[best], float(likely[best] / likely.sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every document.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if no
    labelled document was found. Equal texts get equal results, repeated rows included; ties go
    to the first language by name. Texts of any length are scored whole. An empty table gives no
    rows. Other columns are not read, whatever their names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        held = {"scores": Scores(shipped.value)}

        def step(batch):
            found = []
            for text in texts_of(batch):
                held["scores"] = held["scores"].trimmed()
                found.append(predict(shipped.value, held["scores"], text.decode("utf-8", "replace")))
            return pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "doc_id"),
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

        return step

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, lang_pred string, score double"
    )


def language_id(docs: DataFrame) -> DataFrame:
    """Train on the labelled documents that are not held out and label every document.

    (doc_id, held_out, lang_pred, score); awkward rows are treated as in :func:`identify`.
    """
    held_out = remainder(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT_REST
    return identify(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """The documents whose language is told with a score of ``min_score`` or more, with all their columns.

    Null texts and texts without a letter go. Columns may have any names; rows may repeat.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    place = [name.lower() for name in names].index("text")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        held = {"scores": Scores(shipped.value)}

        def step(batch):
            keep = []
            for text in texts_of(batch, f"c{place}"):
                held["scores"] = held["scores"].trimmed()
                lang, score = predict(shipped.value, held["scores"], text.decode("utf-8", "replace"))
                keep.append(lang != UNKNOWN and score >= min_score)
            return batch.filter(pa.array(keep, pa.bool_()))

        return step

    return map_batches(plain, make, plain.schema).toDF(*names)
