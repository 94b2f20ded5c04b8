"""Hashes that decide where keys and shards lie."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 32-bit and 64-bit FNV-1a offsets and primes, the number of shards, and the splitmix64 finaliser.
FNV32_OFFSET, FNV32_PRIME = 2166136261, 16777619
FNV64_OFFSET, FNV64_PRIME = 0xCBF29CE484222325, 0x100000001B3
SHARDS = 64
SPLITMIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))
MASK64, MASK32 = (1 << 64) - 1, (1 << 32) - 1


def _octets(key: Column) -> Column:
    digits = F.hex(F.encode(key, "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint"))


def fnv1a32(key: Column) -> Column:
    """FNV-1a of the UTF-8 bytes of a string as a BIGINT; an empty key gives the offset. Built-in expressions only."""
    return F.aggregate(_octets(key), F.lit(FNV32_OFFSET).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV32_PRIME)).bitwiseAND(F.lit(MASK32)))


def fnv1a64(key: Column) -> Column:
    """The 64-bit FNV-1a of a string as a struct of two 32-bit halves (hi, lo), as a signed BIGINT can't hold its products."""
    low_prime, up = FNV64_PRIME & MASK32, (FNV64_PRIME >> 32).bit_length() - 1  # the prime is 2**(32 + up) + low_prime
    half = lambda v, n: v.cast("bigint").alias(n)

    def step(h: Column, b: Column) -> Column:
        x = h["lo"].bitwiseXOR(b)
        low = x * F.lit(low_prime)
        high = h["hi"] * F.lit(low_prime) + F.shiftright(low, 32) + x * F.lit(1 << up)
        return F.struct(half(high.bitwiseAND(F.lit(MASK32)), "hi"), half(low.bitwiseAND(F.lit(MASK32)), "lo"))

    return F.aggregate(_octets(key), F.struct(half(F.lit(FNV64_OFFSET >> 32), "hi"), half(F.lit(FNV64_OFFSET & MASK32), "lo")), step)


def draw(n: int, *parts: Column) -> Column:
    """A number below n that the parts decide, the same in any partitioning."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(n))


def key_shard(key: Column) -> Column:
    return F.pmod(fnv1a32(key), F.lit(SHARDS)).cast("int")


def mixed64(*words: int) -> int:
    """FNV-1a over 64-bit little-endian words, finalised; for the driver, where a ring has at most 64 points for each group."""
    h = FNV64_OFFSET
    for octet in b"".join(w.to_bytes(8, "little") for w in words):
        h = (h ^ octet) * FNV64_PRIME & MASK64
    for shift, factor in SPLITMIX:
        h = (h ^ h >> shift) * factor & MASK64
    return h
