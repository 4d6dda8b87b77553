"""Words, rolling hashes and bit arithmetic as Spark expressions, for operators that run without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\u000b\f\r"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once.

    A lambda that refers to a column sees its whole expression, which the
    optimiser may have drawn into the lambda; as a lambda's own variable it is
    a value.
    """
    return F.transform(F.array(value), use).getItem(0)


def spaced_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; an empty array for none or null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return bind(bare, lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+")))


def rolling_hashes(words: Column, k: int) -> Column:
    """Hashes of k consecutive words by the place of the first; an empty array for fewer words."""

    def rolled(w: Column) -> Column:
        last = F.size(w) - k
        of = lambda i: F.xxhash64(*[F.get(w, i + j if j else i) for j in range(k)])
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), of)).otherwise(F.array().cast("array<bigint>"))

    return bind(words, rolled)


def simhash(hashes: Column) -> Column:
    """A bit is set if it is set in over half the hashes."""

    def voted(hs: Column) -> Column:
        ones = lambda b: F.aggregate(hs, F.lit(0), lambda n, h: n + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("long")).cast("int"))
        bit = lambda b: F.when(ones(b) * 2 > F.size(hs), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda n, b: n.bitwiseOR(bit(b)))

    return bind(hashes, voted)


def _block(fingerprint: Column, many: int, i: int) -> Column:
    low, high = 64 * i // many, 64 * (i + 1) // many
    return F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))


def blocks(fingerprint: Column, many: int) -> Column:
    """(block, value) of a 64-bit fingerprint cut into ``many`` blocks, for a multi-index."""
    return bind(fingerprint, lambda fp: F.array(*[F.struct(F.lit(i).alias("block"), _block(fp, many, i).alias("value")) for i in range(many)]))


def first_zero_block(difference: Column, many: int) -> Column:
    """The first block that is zero; null if none is."""
    return F.coalesce(*[F.when(_block(difference, many, i) == 0, F.lit(i)) for i in range(many)])


def multiset_overlap(a: Column, b: Column) -> Column:
    """The sum over distinct values of the smaller of their two counts."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.struct(a.alias("a"), b.alias("b"))
    return bind(both, lambda p: F.aggregate(F.array_distinct(p["a"]), F.lit(0), lambda n, x: n + F.least(count(p["a"], x), count(p["b"], x))))
