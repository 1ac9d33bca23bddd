"""Which texts back which terms, by an inverted index of words and of the stems that begin within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import fold
from quarryline.session import broadcast_within, materialise

#: Letters of a stem; shorter terms have none.
STEM = 6
#: Words of letters and digits, and any other sign by itself.
TOKEN = r"[\p{L}0-9]+|[^\p{L}0-9\s]"
#: Stretches of STEM letters, which overlap.
WINDOW = "(?=([a-z]{%d}))" % STEM
#: Terms, or words that back a term, are broadcast up to this number.
BROADCAST_TERMS, BROADCAST_WORDS = 20_000, 200_000


def term_index(terms: DataFrame, term: str) -> DataFrame:
    """(term, folded, head, single, stem): of each term its longest token, whether it has no other, and the first letters a-z of one with enough."""
    folded = F.trim(fold(term))
    rows = terms.select(F.col(term).alias("term"), folded.alias("folded")).filter("folded <> ''").distinct()
    tokens = F.regexp_extract_all("folded", F.lit(TOKEN), F.lit(0))
    rows = rows.withColumn("tokens", tokens).withColumn("letters", F.regexp_replace("folded", "[^a-z]", ""))
    head = F.element_at(F.array_sort(F.transform("tokens", lambda t: F.struct((-F.length(t)).alias("size"), t.alias("token")))), 1)["token"]
    stem = F.when(F.length("letters") >= STEM, F.left("letters", F.lit(STEM)))
    return rows.select("term", "folded", head.alias("head"), (F.col("folded") == head).alias("single"), stem.alias("stem"))


def folded_once(text: str) -> Column:
    """What ``fold`` gives; texts of ASCII have no accents to look for."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(fold(text))


def quoted(wanted: str) -> Column:
    """A pattern of a folded term with no letter or digit on either side.

    It begins with the term itself, which is found fast; what stands before is looked at from there.
    """
    term = F.concat(F.lit(r"\Q"), wanted, F.lit(r"\E"))
    return F.concat(term, F.lit(r"(?<=(?<![\p{L}0-9])"), term, F.lit(r")(?![\p{L}0-9])"))


def evidence(texts: DataFrame, text_id: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(text_id, term) of the terms that a text backs.

    A text backs a term that stands in it, folded, with no letter or digit on either side, or whose
    first six letters stand in it anywhere, if it has as many. Null and empty ones back nothing.
    Up to BROADCAST_TERMS terms go to all tasks, and only what backs something leaves the task that
    reads the text; more of them meet the words of all texts in shuffles.
    """
    index = materialise(term_index(terms, term))
    folded = texts.select(F.col(text_id).alias("text_id"), folded_once(text).alias("folded_text"))
    if index.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        return where_texts_are(folded, index)
    return by_words(folded, index)


def where_texts_are(folded: DataFrame, index: DataFrame) -> DataFrame:
    """The tokens of a text against the terms' longest ones, its windows of letters against the stems, in the task that reads it."""
    # the text is a column of the exploded rows, for the terms of several words: no shuffle stands between
    tokens = folded.select("text_id", "folded_text", F.explode(F.array_distinct(F.regexp_extract_all("folded_text", F.lit(TOKEN), F.lit(0)))).alias("head"))
    heads = tokens.join(F.broadcast(index.select("head", "term", "single", F.col("folded").alias("wanted"))), "head")
    stands = heads.filter(F.col("single") | (F.contains("folded_text", "wanted") & F.rlike("folded_text", quoted("wanted"))))
    windows = folded.select("text_id", F.explode(F.regexp_extract_all("folded_text", F.lit(WINDOW), F.lit(1))).alias("stem"))
    begun = windows.join(F.broadcast(index.filter("stem IS NOT NULL").select("stem", "term")), "stem")
    return stands.select("text_id", "term").unionByName(begun.select("text_id", "term")).distinct()


def by_words(folded: DataFrame, index: DataFrame) -> DataFrame:
    """Each different word of a text is a row; the words of all texts, each once, are held against the terms.

    A term's longest word, and the stems within a word. Rows of texts meet only words that back
    something, so nothing is compared with every term. Terms of several words are verified in the text.
    """
    words = folded.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all("folded_text", F.lit(TOKEN), F.lit(0)))).alias("word"))
    known = materialise(words.select("word").distinct())
    whole = known.join(index.select(F.col("head").alias("word"), "term", F.col("single").alias("sure")), "word")
    # a stem may also stand across words in one that is written together, never across other signs: letters only
    runs = known.select("word", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit("[a-z]{%d,}" % STEM), F.lit(0)))).alias("run"))
    windows = runs.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - (STEM - 1)), lambda i: F.substring("run", i, F.lit(STEM)))).alias("stem")).distinct()
    stems = windows.join(index.filter("stem IS NOT NULL").select("stem", "term"), "stem").select("word", "term", F.lit(True).alias("sure"))
    backing = materialise(whole.unionByName(stems).groupBy("word", "term").agg(F.bool_or("sure").alias("sure")))
    met = words.join(broadcast_within(backing, BROADCAST_WORDS), "word").groupBy("text_id", "term").agg(F.bool_or("sure").alias("sure"))
    met = materialise(met)
    doubtful = met.filter("NOT sure").join(index.select("term", F.col("folded").alias("wanted")), "term").join(folded, "text_id")
    stands = doubtful.filter(F.contains("folded_text", "wanted")).filter(F.rlike("folded_text", quoted("wanted")))
    return met.filter("sure").select("text_id", "term").unionByName(stands.select("text_id", "term").distinct())


def unbacked(skills: DataFrame, skill: str, terms: DataFrame, term: str) -> DataFrame:
    """The skills that no search term is backed by: what a search misses."""
    listed = skills.select(F.col(skill).alias("skill")).distinct()
    found = evidence(listed.withColumn("skill_text", F.col("skill")), "skill", "skill_text", terms, term)
    return listed.join(found.select(F.col("text_id").alias("skill")).distinct(), "skill", "left_anti")
