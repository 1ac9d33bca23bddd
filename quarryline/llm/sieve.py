"""A sieve of fixed size for keys: what falls through is in the keys perhaps, the rest surely not.

It lets most rows skip a shuffle join whose other side is small beside them but may be of any
size: only rows that fall through need the join. It has 2 ** 24 bits whatever the number of
keys, so it may be broadcast; with very many keys everything falls through, which is only slower.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits.
WORD_BITS = 18


def places(key) -> tuple[F.Column, F.Column]:
    """The word and the bit of a long that is evenly distributed."""
    key = F.col(key) if isinstance(key, str) else key
    return key.bitwiseAND(F.lit((1 << WORD_BITS) - 1)), F.shiftrightunsigned(key, WORD_BITS).bitwiseAND(F.lit(63).cast("long")).cast("int")


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """(sieve_word, sieve_bits) of the keys: 2 ** 18 rows at most."""
    word, bit = places(key)
    placed = keys.select(word.alias("sieve_word"), bit.alias("sieve_bit"))
    return placed.groupBy("sieve_word").agg(F.bit_or(F.expr("shiftleft(1L, sieve_bit)")).alias("sieve_bits"))


def as_words(found: DataFrame) -> np.ndarray:
    """The sieve as an array for Python workers."""
    table, words = found.toArrow(), np.zeros(1 << WORD_BITS, np.int64)
    if table.num_rows:
        words[table["sieve_word"].to_numpy()] = table["sieve_bits"].to_numpy()
    return words


def falls_through(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys = keys.astype(np.int64)
    return (words[keys & ((1 << WORD_BITS) - 1)] >> (keys >> WORD_BITS & 63) & 1).astype(bool)


def split(rows: DataFrame, key, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key falls through, and all others. No key (null) falls through."""
    word, bit = places(key)
    tried = rows.withColumns({"try_word": word, "try_bit": bit})
    tried = tried.join(F.broadcast(found), F.col("try_word") == F.col("sieve_word"), "left")
    through = F.coalesce(F.expr("(shiftrightunsigned(sieve_bits, try_bit) & 1L) = 1L"), F.col("try_word").isNull())
    return tried.filter(through).select(*rows.columns), tried.filter(~through).select(*rows.columns)
