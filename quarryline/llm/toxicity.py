"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: Unicode compatibility forms (full-width, mathematical and the like)
to plain ones, accents away, lower case, look-alike letters of other scripts to Latin ones, and
digits or signs that stand for letters next to a letter. The lexicon holds word beginnings and
words that labelled toxic documents use and others don't, weighted by their log odds. Phrases
around a match that labelled clean documents use are exceptions. The weighted matches,
alone and by length, go through a calibrated logistic function.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.arrow import column_of, map_batches, texts_of
from quarryline.llm.language_id import remainder
from quarryline.session import materialise

HELD_OUT_OF, HELD_OUT_REST = 3, 1
#: Bound of the training sample: labelled documents of each class.
SAMPLE_DOCS = 3000
#: One sampled document in so many calibrates the score; the lexicon comes from the others.
CALIBRATE_OF = 4
#: Lengths of word beginnings that may enter the lexicon; whole words of any length may, too.
SHORTEST, LONGEST = 4, 10
#: Different sampled toxic documents, and different words before it, that an entry needs; and its log odds.
LEAST_SHARE, LEAST_SEEN, LEAST_ODDS = 0.003, 3, 2.0
#: A longer beginning enters beside a shorter one only with so much better odds.
BETTER = 0.7
PREDICT_AT = 0.7
# fixed values: letters of other scripts that look like Latin letters, and characters used for letters
HOMOGLYPHS = str.maketrans(
    "\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u0501\u04bb\u03bf\u03b1\u03bd\u03b9\u03ba\u03c1\u03c5",
    "aeopcyxijsdhoavikpu",
)
SUBSTITUTES = str.maketrans("0134578@$", "oieastbas")
STANDS_IN = re.compile(r"(?<=[^\W\d_])[0134578@$]+|[0134578@$]+(?=[^\W\d_])")
MARKS = re.compile("[\u0300-\u036f]+")
BREAK = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """The folded words of a text, each with a space before and after it."""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().translate(HOMOGLYPHS)
    text = text.lower()
    text = STANDS_IN.sub(lambda m: m[0].translate(SUBSTITUTES), text)
    return f" {BREAK.sub(' ', text).strip()} "


def unexcused(hits: list[tuple], excused: list[tuple[int, int]]) -> list[tuple]:
    """The weighted hits that lie in no excused stretch, in one sweep over both by where they start."""
    found, at, reach = [], 0, -1
    excused = sorted(excused)
    for start, end, weight in sorted((h for h in hits if h[2] is not None), key=lambda h: h[:2]):
        while at < len(excused) and excused[at][0] <= start:
            reach = max(reach, excused[at][1])
            at += 1
        if end > reach:
            found.append((start, end, weight))
    return found


class Lexicon:
    """Weighted word beginnings and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], line=(0.0, 0.0, -3.0)):
        self.weights, self.exceptions, self.line = weights, exceptions, tuple(line)
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for stem, weight in self.weights.items():
                self._automaton.add_word(f" {stem}", (weight, len(stem) + 1))
            for phrase in self.exceptions:
                self._automaton.add_word(f" {phrase} ", (None, len(phrase) + 2))
            if self.weights or self.exceptions:
                self._automaton.make_automaton()
        return self._automaton

    def features(self, text: str) -> tuple[float, float]:
        """Weight of the matches outside exceptions: as a logarithm, and for each hundred words."""
        folded = fold(text)
        if not self.weights:
            return 0.0, 0.0
        hits = [(end - size + 1, end, weight) for end, (weight, size) in self.automaton().iter(folded)]
        excused = [(start, end) for start, end, weight in hits if weight is None]
        total = sum(weight for start, end, weight in unexcused(hits, excused))
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, folded.count(" ") - 1)))

    def score(self, text: str) -> float:
        x, y = self.features(text)
        a, b, c = self.line
        return float(1 / (1 + np.exp(-(a * x + b * y + c))))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, toxic, calibrates, text) of at most ``per_class`` labelled ids of each class, in hash order.

    A label that repeats counts once. An id that repeats in ``docs`` gives one text, the least one;
    an id labelled both ways gives it to both classes.
    """
    allowed = usable_labels(labels).distinct()
    order = F.xxhash64("doc_id", F.lit("toxic"))
    chosen = [
        allowed.filter(F.col("toxic") == c).withColumn("place", order).orderBy("place", "doc_id").limit(per_class)
        for c in (0, 1)
    ]
    chosen = chosen[0].unionByName(chosen[1]).select(
        "doc_id", "toxic", (F.pmod("place", F.lit(CALIBRATE_OF)) == 0).alias("calibrates")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    found = texts.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "toxic", "calibrates").agg(F.min("text").alias("text"))


def usable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learnt."""
    return labels.filter(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
        & (remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT_REST)
    ).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")


def folded_words(sample: DataFrame) -> DataFrame:
    """(doc_id, toxic, word, before) of the sample, with the word before each."""

    def make():
        def step(batch):
            folded = [fold(raw.decode("utf-8", "replace")) for raw in texts_of(batch)]
            return pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), column_of(batch, "toxic"), pa.array(folded, pa.string())],
                names=["doc_id", "toxic", "folded"],
            )

        return step

    rows = sample.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    split = map_batches(rows, make, "doc_id long, toxic int, folded string").select(
        "doc_id", "toxic", F.split(F.trim("folded"), " ").alias("words")
    )
    pairs = F.arrays_zip(F.col("words").alias("word"), F.concat(F.array(F.lit("")), F.col("words")).alias("before"))
    return (
        split.select("doc_id", "toxic", F.explode(pairs).alias("p"))
        .select("doc_id", "toxic", F.col("p.word").alias("word"), F.col("p.before").alias("before"))
        .filter(F.length("word") >= SHORTEST)
    )


def choose_stems(words: DataFrame, documents: dict[int, int]) -> dict[str, float]:
    """Word beginnings with their log odds.

    Copies of one document say a thing once: an entry counts as often as the fewer of its
    documents and the different words before it.
    """
    sizes = F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST)))
    sizes = F.array_union(sizes, F.array(F.length("word")))
    stems = words.select(
        "doc_id", "toxic", "before",
        F.explode(F.transform(sizes, lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("stem"),
    )
    needed = max(LEAST_SEEN, LEAST_SHARE * documents.get(1, 0))
    ratio = (documents.get(1, 0) + 1) / (documents.get(0, 0) + 1)
    often = stems.groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    often = often.filter((F.col("t") >= needed) & (F.col("t") > 2 * ratio * F.col("c"))).select("stem")
    fewer = lambda c: F.least(
        F.count_distinct(F.when(F.col("toxic") == c, F.col("doc_id"))),
        F.count_distinct(F.when(F.col("toxic") == c, F.col("before"))),
    )
    counted = stems.join(often, "stem").groupBy("stem").agg(fewer(1).alias("t"), fewer(0).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (F.col("c") + 0.5) / ratio)
    # each needs some documents of the sample, so its bound is one for these, too
    best = counted.filter(F.col("t") >= needed).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS).collect()
    kept: dict[str, float] = {}
    for row in sorted(best, key=lambda r: (len(r.stem), r.stem)):
        shorter = max((kept.get(row.stem[:n], 0.0) for n in range(SHORTEST, min(len(row.stem), LONGEST + 1))), default=0.0)
        if row.odds >= shorter + BETTER:
            kept[row.stem] = row.odds
    return kept


def choose_exceptions(words: DataFrame, weights: dict[str, float]) -> list[str]:
    """Two-word phrases with a match that clean documents repeat and toxic ones don't have."""
    if not weights:
        return []
    matched = F.lit(False)
    for n in sorted({len(stem) for stem in weights}):
        matched |= F.substring("word", 1, n).isin([stem for stem in weights if len(stem) == n])
    counted = words.filter(matched & (F.col("before") != "")).groupBy("before", "word").agg(
        F.count_distinct(F.when(F.col("toxic") == 0, F.col("doc_id"))).alias("clean"), F.sum("toxic").alias("toxic")
    )
    rows = counted.filter("clean >= 2 AND toxic = 0").collect()
    return sorted(f"{row.before} {row.word}" for row in rows)


def fit_line(rows: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Logistic weights of the two features and the intercept, shifted from equal classes to ``prior``."""
    if len(rows) == 0 or toxic.min() == toxic.max():
        return 1.0, 1.0, -3.0
    x = np.column_stack((rows, np.ones(len(rows))))
    share = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag([0.05, 0.05, 0.001]) * len(rows) / 100
        w += np.linalg.solve(curve, x.T @ (share * (toxic - p)) - np.array([0.05, 0.05, 0.001]) * w * len(rows) / 100)
    return float(w[0]), float(w[1]), float(w[2] + np.log(prior / (1 - prior)))


def train(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn the lexicon and its calibration from the labelled documents that are not held out."""
    sample = materialise(training_sample(docs, labels))
    fitting = sample.filter("NOT calibrates")
    documents = {row.toxic: row["count"] for row in fitting.groupBy("toxic").count().collect()}
    words = materialise(folded_words(fitting))
    weights = choose_stems(words, documents)
    lexicon = Lexicon(weights, choose_exceptions(words, weights))
    rows = [(lexicon.features(row.text), row.toxic) for row in sample.filter("calibrates").select("text", "toxic").toLocalIterator()]
    features = np.array([x for x, _ in rows]).reshape(-1, 2)
    lexicon.line = fit_line(features, np.array([t for _, t in rows], float), prior_of(labels))
    return lexicon


def prior_of(labels: DataFrame) -> float:
    """The share of toxic ones among the labels that may be learnt, of which one of each class is added."""
    counts = {row.toxic: row["count"] for row in usable_labels(labels).groupBy("toxic").count().collect()}
    return (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, predicted) for every document.

    Null and empty texts match nothing and get the score of a text without matches. Equal
    texts get equal scores, repeated rows included; a score at the limit is predicted toxic.
    Texts of any length are read whole, in time that grows with their length. Without labelled
    documents the lexicon is empty and every score is the same, below the limit. An empty table
    gives no rows. Other columns are not read, whatever their names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        def step(batch):
            scores = [shipped.value.score(raw.decode("utf-8", "replace")) for raw in texts_of(batch)]
            return pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= PREDICT_AT) for s in scores], pa.int32())],
                names=["doc_id", "score", "predicted"],
            )

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, make, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels that are not held out and score every document.

    (doc_id, held_out, score, predicted); awkward rows are treated as in :func:`score_toxicity`.
    """
    held_out = remainder(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT_REST
    return score_toxicity(docs, train(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
