"""Deterministic hashing: Spark's Murmur3 (seed 42) over the string form of a value.

Every draw the engine makes (pool choice, VID inside a pool, synthetic data) is a
hash of data, so results do not depend on partitioning, retries or executor loss.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the hash is a signed 32-bit int; dividing by 2**32 and adding 0.5
# maps it onto [0, 1).  Multiplying by the exact reciprocal gives the same bits
# and, unlike a division, is never NULL, so Catalyst adds no null filters that
# would evaluate the hash a second time.
TWO_POW_32 = float(2 ** 32)
INV_TWO_POW_32 = 2.0 ** -32


def to_uniform(h: Column) -> Column:
    """Map a 32-bit hash onto [0, 1)."""
    return h * F.lit(INV_TWO_POW_32) + F.lit(0.5)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_string(c) -> Column:
    """Murmur3 hash of the value's string form (NULL hashes to the seed, 42)."""
    return F.hash(_col(c).cast("string"))


def hash_uniform(c) -> Column:
    """Uniform draw in [0, 1) from the hash of the value's string form."""
    return to_uniform(hash_string(c))


def seeded_uniform(seed: int, *cols) -> Column:
    """Uniform in [0, 1) from ``seed|col1|col2...`` (reproducible random numbers)."""
    parts = [F.lit(str(seed))] + [_col(c).cast("string") for c in cols]
    return to_uniform(F.hash(F.concat_ws("|", *parts)))


CHAIN_PIECE = 128  # draws per inner array of a hash chain


def vid_chain(n, start, size, seed) -> Column:
    """``n`` VIDs inside ``[start, start + size)`` by a hash chain.

    ``v1 = pmod(hash(str(seed)), size) + start`` and
    ``vk = pmod(hash(str(v(k-1))), size) + start``.  ``n < 1`` gives an empty
    array, a NULL ``n`` gives NULL (no rows after ``explode``).  Repeats are
    possible, as with any draw with replacement.  The chain grows by pieces of
    ``CHAIN_PIECE`` draws, so the arrays that are copied while it grows stay short.
    """
    n, start, size, seed = (_col(x) for x in (n, start, size, seed))
    n, size, start = n.cast("bigint"), size.cast("bigint"), start.cast("bigint")
    one = F.lit(1).cast("bigint")

    def step(prev: Column) -> Column:
        return F.pmod(F.hash(prev.cast("string")).cast("bigint"), size) + start

    def piece(prev: Column, length: Column) -> Column:
        first = F.array(step(prev))
        more = F.aggregate(F.sequence(one, length - 1), first,
                           lambda acc, _i: F.concat(acc, F.array(step(F.element_at(acc, -1)))))
        return F.when(length > 1, more).otherwise(first)

    width = F.lit(CHAIN_PIECE).cast("bigint")
    pieces = F.aggregate(
        F.sequence(one, F.floor((n - 1) / width).cast("bigint")),
        F.array(piece(seed.cast("bigint"), F.least(n, width))),
        lambda acc, i: F.concat(acc, F.array(
            piece(F.element_at(F.element_at(acc, -1), -1), F.least(width, n - i * width)))))
    empty = F.array().cast("array<bigint>")
    return (F.when(n.isNull(), F.lit(None))
            .when(n > width, F.flatten(pieces))
            .when(n >= 1, piece(seed.cast("bigint"), n))
            .otherwise(empty))


CHAIN_ROWS = 4096  # draws of a piece of a chain that is one array


def vid_chain_pieces(n, start, size, seed, piece: int = CHAIN_ROWS) -> Column:
    """The chain of ``vid_chain`` cut into pieces: an array of ``(seed, length)`` whose chains
    ``vid_chain(length, start, size, seed)``, one after the other, are the whole chain.

    Only the state of one BIGINT goes from piece to piece, so a row of any ``n`` holds n / ``piece`` states,
    and after ``explode`` each piece is an array of at most ``piece`` draws.  ``n < 1`` and NULL give an empty
    array.
    """
    n, start, size, seed = (_col(x) for x in (n, start, size, seed))
    n, size, start = n.cast("bigint"), size.cast("bigint"), start.cast("bigint")
    width = F.lit(int(piece)).cast("bigint")
    one = F.lit(1).cast("bigint")

    def last(prev: Column) -> Column:
        """State behind a whole piece."""
        return F.aggregate(F.sequence(one, width), prev, lambda acc, _i: F.pmod(F.hash(acc.cast("string")).cast("bigint"), size) + start)

    states = F.when(n > width, F.aggregate(
        F.sequence(one, F.floor((n - 1) / width).cast("bigint")), F.array(seed.cast("bigint")),
        lambda acc, _i: F.concat(acc, F.array(last(F.element_at(acc, -1)))))).otherwise(F.array(seed.cast("bigint")))
    pieces = F.transform(states, lambda s, i: F.struct(s.alias("seed"), F.least(width, n - i * width).alias("length")))
    return F.when(n >= 1, pieces).otherwise(F.array().cast("array<struct<seed:bigint,length:bigint>>"))
