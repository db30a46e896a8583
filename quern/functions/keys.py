"""Key expressions shared by operators and queries: normal forms, hash buckets, deterministic orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def K(c: Column | str) -> Column:
    """c in lower case without anything but a-z and 0-9; null stays null."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def record_name(c: Column | str) -> Column:
    """Normal form of a record's file-like id: trimmed, last path part, without an image suffix, then K."""
    last = F.regexp_replace(F.btrim(c, F.lit(" \t\r\n")), r"^(?s:.*)/", "")
    return K(F.regexp_replace(last, r"(?i)\.(?:jpe?g|png|tif|webp)\z", ""))


def bucket(salt: str, key: Column, buckets: int = 10_000) -> Column:
    """Bucket of ``salt:key`` by the first four bytes of its SHA-256, big-endian, modulo buckets."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), key.cast("string")), 256), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def shard(key: Column, shards: int) -> Column:
    """Shard of key by the first eight bytes of its SHA-256 as an unsigned number, modulo shards."""
    return (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(shards)).cast("int")


def hash_order(key: Column, seed: str | int | None = None) -> Column:
    """A deterministic, input-order-free sort key: SHA-256 of the key, after ``seed:`` if one is given."""
    text = key.cast("string")
    return F.sha2(text if seed is None else F.concat(F.lit(f"{seed}:"), text), 256)


def unit(seed: str, *keys: Column) -> Column:
    """A number in (0, 1), fixed by seed and keys: the upper 52 bits of a 64-bit hash, centred in its step."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
