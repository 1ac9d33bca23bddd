"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within three bits meet half-way: every distinct fingerprint emits all
variants at half the radius, variants are the shuffle key, and fingerprints that share one
are linked. Three is odd, so half of it is taken in two steps:

* Variants at one bit, all 64 bits kept. Fingerprints that share one are two bits apart at
  most, so a bucket (65 members at most) is linked to its least member as it stands.
* For pairs three bits apart, each of three blocks of bits is masked in turn. At least one of
  the differing bits lies in some block, so with it masked two remain, and the one-bit
  variants of the rest collide. These collisions are only candidates. Buckets whose members
  are in one component already are dropped before any pair is formed; pairs of the others
  are verified with their whole fingerprints. Members of very full buckets emit their variants
  at one and at two bits of all 64 instead, which links them without forming pairs.

Only distinct fingerprints take part; copies cost one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm import sieve
from quarryline.llm.arrow import column_of, map_batches, texts_of
from quarryline.operators.components import connected_components
from quarryline.session import broadcast_within, materialise

RADIUS = 3
SHINGLE_WORDS = 3
#: Bits of the blocks that are masked in turn.
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Members of a masked key that may form pairs.
CROWD = 64
#: Buckets with members of several components are broadcast up to this many keys.
BROADCAST_KEYS = 100_000
#: Variants that one task makes, about.
TASK_ROWS = 2_000_000
HASH_SEED = 42


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space with A-Z lowered."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order; a shorter text is one shingle, a wordless one has none."""
    if not words:
        return np.zeros(0, np.uint64)
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist() or [len(line)]
    return np.fromiter((digest(line[a:b], HASH_SEED) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops))


def set_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        octets = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: bytes, width: int) -> int:
    """64-bit SimHash of a UTF-8 text: A-Z lowered, words between ASCII white space, repeats counted."""
    return set_bits(shingle_hashes(words_of(text), width))


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the SimHash as a signed long. Null and wordless texts have 0."""

    def make():
        def step(batch):
            prints = np.array([simhash(text, width) for text in texts_of(batch)], dtype=np.uint64)
            return pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"]
            )

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, fp long")


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def one_bit_links(prints: DataFrame) -> DataFrame:
    """Links (u, v) that join exactly the fingerprints with a common variant at one bit or none."""
    masks = F.array(*[F.lit(signed(m)).cast("long") for m in (0, *(1 << i for i in range(64)))])
    variants = spread(prints, 65).select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")
    )
    bucket = Window.partitionBy("variant")
    return (
        variants.withColumn("least", F.min("fp").over(bucket))
        .filter("fp <> least")
        .select(F.col("fp").alias("u"), F.col("least").alias("v"))
        .distinct()
    )


def masked_variants(labelled: DataFrame) -> DataFrame:
    """(key, fp, root): for each masked block the fingerprint's variants at one other bit or none.

    Masked bits are zero in the key. Keys of different blocks may be equal by chance, which
    only adds candidates.
    """
    choices = []
    for low, high in BLOCKS:
        inside = ((1 << high) - 1) ^ ((1 << low) - 1)
        keep = signed(~inside & ((1 << 64) - 1))
        choices += [(keep, signed(m)) for m in (0, *(1 << i for i in range(64) if not inside >> i & 1))]
    rows = F.array(
        *[F.struct(F.lit(k).cast("long").alias("keep"), F.lit(m).cast("long").alias("mask")) for k, m in choices]
    )
    chosen = labelled.select("fp", "root", F.explode(rows).alias("c"))
    return chosen.select(F.col("fp").bitwiseAND(F.col("c.keep")).bitwiseXOR(F.col("c.mask")).alias("key"), "fp", "root")


def spread(prints: DataFrame, variants: int) -> DataFrame:
    """Deal fingerprints to as many tasks as their variants need, not as their own bytes would."""
    return prints.repartition(max(8, -(-prints.count() * variants // TASK_ROWS)), "fp")


def three_bit_links(labelled: DataFrame) -> DataFrame:
    """Links (u, v) between the roots of fingerprints within the radius in different components.

    Keys of CROWD fingerprints or fewer form their pairs, and whole fingerprints decide. Members of
    fuller keys meet in the variants of all their bits instead, which makes no pairs.
    """
    variants = masked_variants(spread(labelled, 64 * len(BLOCKS)))
    # nearly all keys are different: combining before the shuffle would only fill memory
    mixed = materialise(
        variants.select("key", "root")
        .repartition("key")
        .groupBy("key")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("held"))
        .filter("low <> high")
        .select("key", (F.col("held") > CROWD).alias("crowded"))
    )
    members = materialise(variants.join(broadcast_within(mixed, BROADCAST_KEYS, "merge"), "key"))
    few = members.filter("NOT crowded")
    other = few.select("key", F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS
    pairs = few.join(other.hint("merge"), "key").filter((F.col("root") < F.col("root2")) & near)
    paired = pairs.select(F.col("root2").alias("u"), F.col("root").alias("v"))
    return paired.unionByName(crowded_links(members.filter("crowded").select("fp", "root").distinct())).distinct()


def crowded_links(members: DataFrame) -> DataFrame:
    """Links (u, v) of roots, whole for all pairs within the radius, with rows that grow with the members only.

    Each emits its variants at one bit and at two. Whoever has a variant at two bits or fewer is three
    from those that have it at one or fewer, so it is linked to the least root of these. Spark takes
    variants to be as few as members and would broadcast them; the join sorts and merges instead.
    """
    bit = lambda name: F.expr(f"shiftleft(1L, {name})")
    one = members.select("fp", "root", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
    flipped = F.when(F.col("i") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(bit("i")))
    one = one.select("fp", "root", "i", flipped.alias("variant"))
    two = one.filter("i >= 0 AND i < 63").select("root", "variant", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
    two = two.select("root", F.col("variant").bitwiseXOR(bit("j")).alias("variant"))
    near = one.select("root", "variant")
    least = near.groupBy("variant").agg(F.min("root").alias("least"))
    met = near.unionByName(two).join(least.hint("merge"), "variant").filter("root <> least")
    return met.select(F.greatest("root", "least").alias("u"), F.least("root", "least").alias("v")).distinct()


def near_groups(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to the root of all that are linked to them."""
    first = connected_components(one_bit_links(prints))
    labelled = materialise(
        prints.join(first, prints.fp == first.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
    )
    second = connected_components(three_bit_links(labelled)).select(
        F.col("node").alias("root"), F.col("root").alias("last_root")
    )
    return labelled.join(second, "root", "left").select("fp", F.coalesce("last_root", "root").alias("root"))


def near_dedup(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Texts without words, null ones included, have fingerprint zero and are linked like any
    other; texts of any length are read whole. Repeated rows are equal and stay in the result. A
    null doc_id keeps its row; it names a component only if no member has an id. No documents give
    no rows. Other columns are not read, whatever their names.
    """
    printed = materialise(fingerprints(docs, width))
    groups = near_groups(materialise(printed.select("fp").distinct()))
    least = materialise(
        printed.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(groups, "fp").select("fp", "root", "doc_id")
    )
    smallest = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = least.join(smallest, "root").select("fp", "component_id")
    return printed.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, with all its columns.

    Rows that repeat its id stay if their texts differ from each other; equal ones become one.
    Columns of ``docs`` may have any names.
    """
    return keep_least(docs, near_dedup(docs, width))


def keep_least(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the component_id of a member with that id.

    Rows whose id is surely neither dropped nor repeated stay where they are; only the others
    are shuffled to look theirs up.
    """
    ids = members.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("q_rows"), F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("q_kept")
    )
    special = materialise(ids.filter("q_rows > 1 OR NOT q_kept").select(F.col("doc_id").alias("q_id"), "q_rows", "q_kept"))
    own = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.struct("*").alias("whole"))
    unsure, sure = sieve.split(own, F.xxhash64("own_id"), sieve.sieve(special.select(F.xxhash64("q_id").alias("place")), "place"))
    known = unsure.join(special, F.col("own_id").eqNullSafe(F.col("q_id")), "left").filter(F.coalesce("q_kept", F.lit(True)))
    once, again = known.filter("q_rows IS NULL"), known.filter("q_rows IS NOT NULL").withColumn("own_text", F.col("whole.text"))
    again = again.dropDuplicates(["own_id", "own_text"])
    return sure.select("whole.*").unionByName(once.select("whole.*")).unionByName(again.select("whole.*"))
