"""Near copies by the similarity of whole texts: shared shingles of all shingles of either text.

Ball hashing of SimHash fingerprints finds the closest of them, but texts at a similarity of
0.8 lie about ten of 64 bits apart, where balls would hold everything. So texts meet in buckets
of two kinds: the component of their fingerprint, and bands of least shingle hashes. The least
values of BANDS * ROWS permutations are cut into bands; a pair at 0.8 shares none of them in 3
of a million cases. Whatever meets is a candidate, and every pair that counts is verified with
the shingles of both whole texts:

* Each bucket's members are held against the one that meets most others, which joins large
  groups around their original without forming their pairs.
* Buckets whose members are then in different groups form pairs between groups, each pair in the
  first bucket it shares, if SKETCH_BITS one-bit sketches of both allow the similarity (a pair at
  0.8 fails that in 3 of 100,000 cases). Texts in great number a little less alike than asked make
  many of these; none is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import sieve
from quarryline.llm.arrow import column_of, map_batches, texts_of
from quarryline.operators.components import connected_components, let_go
from quarryline.llm.near_dedup import HASH_SEED, keep_least, near_groups, set_bits, shingle_hashes, words_of
from quarryline.session import broadcast_within, materialise

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: Shingles that are permuted at once.
CHUNK = 2048
#: Pairs with one text that a task verifies, about.
TASK_PAIRS = 2000
#: Texts with more pairs than that are broadcast up to this number.
BROADCAST_TEXTS = 100_000
#: Bits of a sketch, one for each of as many permutations, and standard deviations that a pair may be off.
SKETCH_BITS, SLACK = 512, 4
FACTORS, OFFSETS = np.random.RandomState(HASH_SEED).randint(0, 1 << 64, (2, SKETCH_BITS, 1), dtype=np.uint64)
FACTORS = FACTORS | np.uint64(1)


def node_of(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)


def shingles_of(words: list[bytes], width: int) -> np.ndarray:
    """Distinct hashes of all runs of ``width`` words; a shorter text is one shingle."""
    return np.unique(shingle_hashes(words, width))


def least_hashes(shingles: np.ndarray, permutations: int) -> np.ndarray:
    """The least value of each of the first permutations."""
    least = np.full(permutations, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(least, (shingles[at : at + CHUNK] * FACTORS[:permutations] + OFFSETS[:permutations]).min(axis=1), out=least)
    return least


def bands_of(shingles: np.ndarray) -> list[int]:
    """One hash for each band of least values."""
    least = least_hashes(shingles, BANDS * ROWS)
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """One bit of each least value: two texts differ in half the share that they don't have in common."""
    bits = (least_hashes(shingles, SKETCH_BITS) >> np.uint64(31) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<u8")


def most_different(similarity: float) -> int:
    """Sketch bits in which two texts of this similarity may differ."""
    share = (1 - similarity) / 2
    return int(SKETCH_BITS * share + SLACK * (SKETCH_BITS * share * (1 - share)) ** 0.5)


def longs(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def printed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, fp, bands): texts with the same words in order have the same node."""

    def make():
        def step(batch):
            nodes, prints, bands = [], [], []
            for text in texts_of(batch):
                words = words_of(text)
                hashes = shingle_hashes(words, width)
                nodes.append(node_of(words))
                prints.append(set_bits(hashes))
                bands += bands_of(np.unique(hashes))
            lists = pa.ListArray.from_arrays(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS, longs(bands))
            return pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), longs(nodes), longs(prints), lists], names=["doc_id", "node", "fp", "bands"])

        return step

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(chosen, make, "doc_id long, node long, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles, sketch) of the texts whose node is asked for; most others are not shuffled."""
    wanted = docs.sparkSession.sparkContext.broadcast(sieve.as_words(sieve.sieve(nodes, "node")))

    def named():
        def step(batch):
            found = np.array([node_of(words_of(t)) for t in texts_of(batch)], np.uint64).view(np.int64)
            named = pa.RecordBatch.from_arrays([pa.array(found), column_of(batch, "text")], names=["node", "text"])
            return named.filter(pa.array(sieve.falls_through(wanted.value, found)))

        return step

    def cut():
        def step(batch):
            sets = [shingles_of(words_of(t), width) for t in texts_of(batch)]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            sketches = np.concatenate([sketch_of(x) for x in sets])
            places = np.arange(len(sets) + 1, dtype=np.int32) * (SKETCH_BITS // 64)
            lists = [pa.ListArray.from_arrays(ends, longs(np.concatenate(sets))), pa.ListArray.from_arrays(places, longs(sketches))]
            return pa.RecordBatch.from_arrays([column_of(batch, "node"), *lists], names=["node", "shingles", "sketch"])

        return step

    texts = map_batches(docs.select(F.col("text").cast("string").alias("text")), named, "node long, text string")
    return map_batches(texts.join(nodes, "node", "left_semi").dropDuplicates(["node"]), cut, "node long, shingles array<long>, sketch array<long>")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose texts are as similar as asked. Texts with very many pairs go to several tasks."""
    rows = pairs = materialise(pairs)
    let_go(pairs.sparkSession)
    for end in ("u", "v"):
        many = pairs.groupBy(F.col(end).alias("many")).count().filter(F.col("count") > TASK_PAIRS)
        many = broadcast_within(materialise(many.select("many", F.ceil(F.col("count") / TASK_PAIRS).alias("copies"))), BROADCAST_TEXTS)
        copies = F.coalesce("copies", F.lit(1))
        dealt = rows.join(many, F.col(end) == F.col("many"), "left").withColumn("part", F.pmod(F.xxhash64("u", "v"), copies)).drop("many", "copies")
        copied = sets.join(many, F.col("node") == F.col("many"), "left").select(
            F.col("node").alias(end), F.col("shingles").alias(f"{end}_set"), F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("part")
        )
        rows = dealt.join(copied, [end, "part"]).drop("part")
    rows = rows.withColumn("both", F.size(F.array_intersect("u_set", "v_set")))
    return rows.filter(F.col("both") >= F.lit(similarity) * (F.size("u_set") + F.size("v_set") - F.col("both"))).select("u", "v")


def pair(u, v) -> list:
    return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]


def bucket_keys(prints: DataFrame) -> DataFrame:
    """(node, keys): for each text the component of its fingerprint by ball hashing, then its bands."""
    nodes = materialise(prints.select("node", "fp", "bands").dropDuplicates(["node"]))
    balls = near_groups(materialise(nodes.select("fp").distinct())).select("fp", F.xxhash64("root").alias("ball"))
    return materialise(nodes.join(balls, "fp").select("node", F.array_prepend("bands", F.col("ball")).alias("keys")))


def first_shared(one: str, other: str) -> F.Column:
    """The place of the first bucket that two texts share."""
    return F.array_position(F.zip_with(one, other, lambda a, b: a == b), True)


def similar_groups(nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, keys) to (node, root); root is the least node of all that are linked."""
    placed = nodes.select("node", F.posexplode("keys").alias("place", "key"))
    shared = materialise(placed.groupBy("place", "key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"))
    met = materialise(placed.join(shared, ["place", "key"]))
    known = materialise(met.groupBy("node").agg(F.sum("held").alias("meets")))
    sets = materialise(shingle_sets(docs, known.select("node"), width))
    let_go(docs.sparkSession)
    met = materialise(met.drop("held").join(known, "node"))
    leaders = materialise(met.groupBy("place", "key").agg(F.max(F.struct("meets", "node")).alias("leader")))
    led = met.join(leaders, ["place", "key"]).select("node", F.col("leader.node").alias("v"))
    let_go(docs.sparkSession)
    links = materialise(similar(led.filter("node <> v").select(*pair("node", "v")).distinct(), sets, similarity))
    let_go(docs.sparkSession)
    labelled = materialise(
        met.join(connected_components(links), "node", "left").select("place", "key", "node", F.coalesce("root", "node").alias("root"))
    )
    mixed = labelled.groupBy("place", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    mixed = labelled.join(materialise(mixed.select("place", "key")), ["place", "key"])
    mixed = materialise(mixed.join(nodes, "node").join(sets.select("node", "sketch"), "node"))
    let_go(docs.sparkSession)
    other = mixed.select("place", "key", *[F.col(c).alias(f"v_{c}") for c in ("node", "root", "keys", "sketch")])
    differ = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("v_sketch")[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.col("sketch")[0].bitwiseXOR(F.col("v_sketch")[0])))
    new = (F.col("node") > F.col("v_node")) & (F.col("root") != F.col("v_root")) & (differ <= most_different(similarity))
    rest = mixed.join(other, ["place", "key"]).filter(new & (first_shared("keys", "v_keys") == F.col("place") + 1))
    rest = rest.select(F.col("node").alias("u"), F.col("v_node").alias("v"))
    found = materialise(similar(rest, sets, similarity))
    let_go(docs.sparkSession)
    last = connected_components(links.unionByName(found))
    return nodes.join(last, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def drop_similar(docs: DataFrame, width: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of linked texts: the one with the smallest doc_id, with all its columns.

    Texts are linked if ``similarity`` or more of the distinct shingles of ``width`` words in
    either are in both. Texts without words, null ones included, are equal; texts of any length
    are compared whole. Ids and repeated rows are treated as in
    :func:`quarryline.llm.near_dedup.drop_near_copies`; an empty table stays empty.
    """
    let_go(docs.sparkSession)
    prints = materialise(printed(docs, width))
    keys = bucket_keys(prints)
    let_go(docs.sparkSession)
    groups = materialise(similar_groups(keys, docs, width, similarity))
    let_go(docs.sparkSession)
    least = prints.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(groups, "node")
    smallest = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = groups.join(smallest, "root").select("node", "component_id")
    return keep_least(docs, prints.select("doc_id", "node").join(named, "node"))
