"""The 64 features of an identifier, as one array column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from . import text as T

#: Blocks of code points whose shares are features 20 to 27.
BLOCKS = (r"[\x{0}-\x{7F}]", r"[\x{80}-\x{FF}]", r"[\x{100}-\x{17F}]", r"[\x{180}-\x{24F}]", r"[\x{300}-\x{36F}]", r"[\x{1E00}-\x{1EFF}]", r"[\x{3000}-\x{9FFF}]", r"[\x{10000}-\x{10FFFF}]")
STYLES = ("SnakeCase", "CamelCase", "PascalCase", "ScreamingSnake", "MixedCase")


def length_bucket(s: Column) -> Column:
    n = F.octet_length(s)
    return F.when(n <= 1, 0).when(n <= 3, 1).when(n <= 7, 2).when(n <= 15, 3).when(n <= 31, 4).otherwise(5)


def _let(x: Column, f) -> Column:
    """f(x) with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _times(x: Column, k: int) -> Column:
    """x * k modulo 2**32, for 0 <= x < 2**32, without overflow."""
    return _let(x, lambda v: (v * (k & 0xFFFF) + ((v * (k >> 16)).bitwiseAND(0xFFFF)) * 65536).bitwiseAND(0xFFFFFFFF))


def _turn(x: Column, by: int) -> Column:
    return _let(x, lambda v: F.shiftleft(v, by).bitwiseAND(0xFFFFFFFF).bitwiseOR(F.shiftright(v, 32 - by)))


def _mixed(x: Column, by: int) -> Column:
    return _let(x, lambda v: v.bitwiseXOR(F.shiftright(v, by)))


def murmur3(parts: Column, seed: int) -> Column:
    """Murmur3 (x86, 32 bits) of an array of little-endian 32-bit numbers."""

    def step(h, p):
        k = _times(_turn(_times(p, 0xCC9E2D51), 15), 0x1B873593)
        return (_turn(h.bitwiseXOR(k), 13) * 5 + 0xE6546B64).bitwiseAND(0xFFFFFFFF)

    h = F.aggregate(parts, F.lit(seed).cast("long"), step)
    h = h.bitwiseXOR((F.size(parts) * 4).cast("long"))
    return _mixed(_times(_mixed(_times(_mixed(h, 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)


def ngram_buckets(s: Column, n: int, seed: int) -> Column:
    """16 shares of hashed n-grams of code points."""
    points = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def shares(cps):
        count = F.greatest(F.size(cps) - (n - 1), F.lit(0))
        at = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        hashed = F.transform(at, lambda i: murmur3(F.slice(cps, i, F.lit(n)), seed).bitwiseAND(15))
        over = F.greatest(F.size(cps) - 1, F.lit(1))
        return _let(hashed, lambda hs: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.size(F.filter(hs, lambda h: h == b.cast("long"))) / over))

    return _let(points, shares)


def features(s: Column) -> Column:
    n, size = F.length(s), F.octet_length(s)
    share = lambda p: F.when(n > 0, F.regexp_count(s, F.lit(p)) / n).otherwise(0.0)
    byte = lambda p: F.when(size > 0, F.regexp_count(s, F.lit(p)) / size).otherwise(0.0)
    flag = lambda c: c.cast("int").cast("double")
    style = T.naming_style(s)
    unicode_share = share(r"[^\x00-\x7F]")
    head = [
        unicode_share, T.vietnamese_ratio(s), 1 - unicode_share, share(C.MARK), length_bucket(s) / 5, F.least(size, F.lit(64)) / 64, flag(T.has_vietnamese(s)), flag(F.instr(s, "_") > 0), flag(F.instr(s, "-") > 0),
        *[flag(style == x) for x in STYLES], byte("[A-Z]"), byte("[a-z]"), byte("[0-9]"), flag(s.rlike("^[A-Z]")), flag(s.startswith("_")), flag(s.rlike("[0-9]$")), *[share(b) for b in BLOCKS],
    ]
    tail = F.array_repeat(F.lit(0.0), 4)
    return reduce(lambda a, b: F.concat(a, b), [F.array(*[h.cast("double") for h in head]), ngram_buckets(s, 2, 42), ngram_buckets(s, 3, 137), tail]).cast("array<float>")
