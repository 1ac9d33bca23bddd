"""Mixing sources to target weights by hash order and distributed prefix sums.

Every document gets a hash-random key of its id and text. Within a source the keys are
range-partitioned by their leading digits (the keys are uniform, so the bounds are known
beforehand and a hot source spreads over all ranges). Token counts are summed per range, a
prefix sum over the ranges finds the one in which the budget ends, and the keys of that range
alone are sorted and summed to find the key at which the exact word is cut. Whole documents are
then compared with that key where they are. Whole epochs come before the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import broadcast_within, materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Relative weights, dealt to the sources in code point order, null last, and repeated.
WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its own words.
MAX_EPOCHS = 3
#: Leading hex digits of the key that name a range: 16 ** 3 ranges a source, and as many within the one that is cut.
RANGE_DIGITS = 3
#: The plan has one row per source; up to this many rows it is broadcast.
BROADCAST_SOURCES = 20_000


def word_count(text) -> F.Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id, text, seed: int) -> F.Column:
    """Hash-random, the same on every run, different for rows that differ in id or text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with its target.

    The total is shared by weight, and what a source cannot give is reshared by weight. That
    is one water level: sources are sorted by the level that fills them, and the first one
    that the words and weights left over do not fill sets the level for itself and the rest.
    """
    everyone = Window.partitionBy(F.lit(0))
    by_name = everyone.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("nth", F.row_number().over(by_name))
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
    )
    rising = everyone.orderBy(F.col("cap") / F.col("weight"), "nth")
    lower = rising.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("place", F.row_number().over(rising))
        .withColumn("words_left", F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(lower), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(lower), F.lit(0)))
    )
    fits = F.col("words_left") * F.col("weight") <= F.col("cap") * F.col("weight_left")
    level = F.min(F.when(fits, F.struct("place", "words_left", "weight_left"))).over(everyone)
    target = F.when(
        F.col("place") >= F.col("level.place"),
        F.col("level.words_left").cast("double") * F.col("weight") / F.col("level.weight_left"),
    ).otherwise(F.col("cap").cast("double"))
    return levels.withColumn("level", level).select("source", "source_size", target.alias("target"))


def budgets(sizes: DataFrame, weights, max_epochs: int) -> DataFrame:
    """(source, source_size, target, epochs, rest): whole epochs, and the words to take in the last one."""
    target = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))
    found = source_targets(sizes, weights, max_epochs).withColumn("epochs", whole)
    return found.withColumn("rest", target - F.col("epochs") * F.col("source_size"))


def cut_of(ranges: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` (source, rest, start, ...) with the first of (source, part, words) at which the rest ends.

    ``start`` are the words before the first part; ``part`` and the new ``start`` are null for a
    source that needs none.
    """
    so_far = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    prefix = ranges.withColumn("upto", F.sum("words").over(so_far)).withColumnRenamed("source", "r_source")
    mine = plan.join(prefix, F.col("source").eqNullSafe(F.col("r_source")), "left")
    ends = F.when(F.col("rest") < F.col("start") + F.col("upto"), F.struct("part", (F.col("start") + F.col("upto") - F.col("words")).alias("before")))
    kept = [F.first(c).alias(c) for c in plan.columns if c not in ("source", "start")]
    found = mine.groupBy("source").agg(*kept, F.min(ends).alias("cut"))
    return found.withColumns({"part": F.col("cut.part"), "start": F.col("cut.before")}).drop("cut")


def mixing_plan(docs: DataFrame, seed: int = 0, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size, target, epochs, rest, the key at which the rest ends and the words before it.

    A source that is used in whole epochs only has a null key.
    """
    keys = docs.select("source", order_key(F.col("doc_id"), F.col("text"), seed).alias("key"), word_count(F.col("text")).alias("words"))
    digits = lambda n: F.substring("key", 1, n)
    ranges = materialise(keys.groupBy("source", digits(RANGE_DIGITS).alias("part")).agg(F.sum("words").alias("words")))
    sizes = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = budgets(sizes, weights, max_epochs).withColumn("start", F.lit(0).cast("long"))
    plan = materialise(cut_of(ranges, plan).withColumnRenamed("part", "outer"))
    wanted = broadcast_within(plan.select(F.col("source").alias("p_source"), "outer"), BROADCAST_SOURCES)
    inside = F.col("source").eqNullSafe(F.col("p_source")) & (digits(RANGE_DIGITS) == F.col("outer"))
    # one key has the rows of one id and text, so it is summed before it is shuffled
    inner = materialise(keys.join(wanted, inside, "left_semi").groupBy("source", F.col("key").alias("part")).agg(F.sum("words").alias("words")))
    finer = inner.groupBy("source", F.substring("part", 1, 2 * RANGE_DIGITS).alias("part")).agg(F.sum("words").alias("words"))
    plan = materialise(cut_of(finer, plan.drop("outer")).withColumnRenamed("part", "outer"))
    last = inner.join(
        plan.select(F.col("source").alias("p_source"), "outer"),
        F.col("source").eqNullSafe(F.col("p_source")) & (F.substring("part", 1, 2 * RANGE_DIGITS) == F.col("outer")), "left_semi",
    )
    return materialise(cut_of(last, plan.drop("outer")).withColumnsRenamed({"part": "cut_key", "start": "before"}))


def free_prefix(names: list[str], prefix: str = "mix_") -> str:
    """``prefix``, or with more underscores before it if a column begins with it."""
    while any(name.lower().startswith(prefix) for name in names):
        prefix = f"_{prefix}"
    return prefix


def mix_sources(docs: DataFrame, seed: int = 0, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` with mix_words (its size), mix_size, mix_target and mix_taken added.

    A null source is a source of its own, last in order. A text without words (or null) has
    size 0 and gives nothing; texts of any length are counted whole. If a column of ``docs``
    begins with ``mix_``, the new ones begin with ``_mix_`` (or more underscores). Rows with the
    same id and text have the same key; where the cut falls among them, some are taken and the
    others not. No documents give no rows. The words taken of a source sum up to its target,
    rounded down. Rows are not shuffled, but for those with the very key at which a source is cut.
    """
    p = free_prefix(docs.columns)
    named = {c: f"{p}{c}" for c in ("source", "source_size", "target", "epochs", "rest", "cut_key", "before")}
    plan = broadcast_within(mixing_plan(docs, seed, weights, max_epochs).withColumnsRenamed(named), BROADCAST_SOURCES)
    c = lambda name: F.col(f"{p}{name}")
    keyed = docs.withColumns({f"{p}words": word_count(F.col("text")), f"{p}key": order_key(F.col("doc_id"), F.col("text"), seed)})
    planned = keyed.join(plan, F.col("source").eqNullSafe(c("source")), "inner")
    epochs = c("epochs") * c("words")
    at_cut = c("key").eqNullSafe(c("cut_key"))
    clear = planned.filter(~at_cut).withColumn(f"{p}taken", epochs + F.when(c("key") < c("cut_key"), c("words")).otherwise(F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(f"{p}source", f"{p}key").orderBy(f"{p}key"))
    room = F.greatest(F.lit(0), F.least(c("words"), c("rest") - c("before") - (nth - 1) * c("words")))
    cut = planned.filter(at_cut).withColumn(f"{p}taken", epochs + room)
    kept = [*docs.columns, *[f"{p}{name}" for name in ("words", "source_size", "target", "taken")]]
    return clear.unionByName(cut).select(*[F.col("`{}`".format(name.replace("`", "``"))) for name in kept]).withColumnRenamed(f"{p}source_size", f"{p}size")


def take_mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each epoch in which a document is used.

    The document at the cut is taken whole, so a source may exceed its target by less than it.
    Columns of ``docs`` may have any names.
    """
    times = F.ceil(F.col("mix_taken") / F.col("mix_words")).cast("int")
    mixed = mix_sources(docs.select("doc_id", "source", "text", F.struct("*").alias("whole")), seed)
    taken = mixed.filter(F.col("mix_taken") > 0)
    return taken.withColumn("mix_time", F.explode(F.sequence(F.lit(1), times))).select("whole.*")


MIXING_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(concat('0:', coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM s),
w AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight,
             3 * source_size AS cap FROM n),
p AS (SELECT *, row_number() OVER r AS place,
             (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER l, 0)::BIGINT AS words_left,
             (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER l, 0)::BIGINT AS weight_left
      FROM w WINDOW r AS (ORDER BY cap / weight, nth),
        l AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT place, words_left, weight_left FROM p
      WHERE words_left::HUGEINT * weight <= cap::HUGEINT * weight_left ORDER BY place LIMIT 1),
t AS (SELECT p.source, source_size,
             CASE WHEN p.place >= v.place THEN v.words_left::DOUBLE * weight / v.weight_left ELSE cap::DOUBLE END AS target
      FROM p LEFT JOIN v ON true),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
x AS (SELECT d.*, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS rest,
             (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM x
"""
