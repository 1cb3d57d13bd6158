"""Minimal perfect hashing of distinct integers below 2**32, built in buckets by Spark, and dense vectors that its values index.

Keys are dealt to buckets by a hash.  A bucket's function has levels: each is
a bit array of about twice as many bits as keys are left, in which a bit is
set where exactly one key falls; keys that share a place go on to the next
level.  A key's value is the number of set bits before its own, over all
buckets and levels in turn, so that n keys have the values 0 to n - 1.  The
keys themselves are kept in the order of their values: a key that the function
was not built for is told from them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.storage import stored

#: Keys a bucket, on average, and levels at most; more happen with repeated keys only.
BUCKET, LEVELS = 1 << 15, 64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of integers."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dealt(keys: np.ndarray) -> np.ndarray:
    """The 32 bits of a key's hash that choose its bucket."""
    return (mixed(keys, 0) >> np.uint64(32)).astype(np.int64)


def one_bucket(keys: np.ndarray, roomy: float = 2.0) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels' bits as words of 64, and the keys in the order of their values."""
    levels, order, left = [], [], keys
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("keys of a perfect hash function must be distinct")
        size = 64 * (int(roomy * len(left)) // 64 + 1)
        at = (mixed(left, 1 + len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        hit = alone[at]
        order.append(left[hit][np.argsort(at[hit])])
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~hit]
    return levels, np.concatenate(order) if order else keys


@dataclass
class PerfectHash:
    """A function over all buckets, small enough for every task: some 4 bits and 4 bytes a key."""

    words: np.ndarray
    before: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray

    def values(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys; -1 for those that it was not built for."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        bucket, left = dealt(keys) % len(self.starts), np.arange(len(keys))
        for level in range(self.starts.shape[1]):
            some = bucket[left]
            size = self.sizes[some, level]
            there = size > 0
            left, some, size = left[there], some[there], size[there]
            if not len(left):
                break
            at = (mixed(keys[left], 1 + level) % (size * 64).astype(np.uint64)).astype(np.int64)
            place, bit = self.starts[some, level] + (at >> 6), (at & 63).astype(np.uint64)
            word = self.words[place]
            hit = (word >> bit & np.uint64(1)).astype(bool)
            rest = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[place[hit]] + np.bitwise_count(rest).astype(np.int64)
            left = left[~hit]
        known = out >= 0
        out[known] = np.where(self.keys[out[known]] == keys[known], out[known], -1)
        return out


def assembled(rows: list) -> PerfectHash:
    """The function of rows (bucket, sizes, bits, keys), one a bucket from 0 on."""
    rows = sorted(rows, key=lambda r: r["bucket"])
    depth = max((len(r["sizes"]) for r in rows), default=0)
    sizes = np.zeros((len(rows), depth), np.int64)
    for k, r in enumerate(rows):
        sizes[k, : len(r["sizes"])] = r["sizes"]
    words = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), "<u8")
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    set_bits = np.cumsum(np.bitwise_count(words).astype(np.int64))
    return PerfectHash(words, np.r_[0, set_bits[:-1]] if len(words) else set_bits, ends - sizes, sizes, np.frombuffer(b"".join(bytes(r["keys"]) for r in rows), "<u4"))


def build(keys: DataFrame, n: int) -> PerfectHash:
    """The function of a stored table of ``n`` distinct keys (key, dealt); every bucket is built in a task.

    It is put together in the driver: the caller checks ``n``.
    """
    buckets = max(1, -(-n // BUCKET))

    def built(bucket: tuple, table: pa.Table) -> pa.Table:
        levels, order = one_bucket(table.column("key").to_numpy().astype(np.uint32))
        bits = b"".join(w.tobytes() for w in levels)
        return pa.table({"bucket": pa.array([bucket[0].as_py()], pa.int64()), "sizes": pa.array([[len(w) for w in levels]], pa.list_(pa.int32())), "bits": pa.array([bits], pa.binary()), "keys": pa.array([order.astype("<u4").tobytes()], pa.binary())})

    by_bucket = keys.select("key", F.pmod("dealt", F.lit(buckets)).alias("bucket")).groupBy("bucket")
    rows = stored(by_bucket.applyInArrow(built, "bucket long, sizes array<int>, bits binary, keys binary"), "perfect-hash")
    found = [r.asDict() for r in rows.collect()]
    there = {r["bucket"] for r in found}
    return assembled(found + [{"bucket": b, "sizes": [], "bits": b"", "keys": b""} for b in range(buckets) if b not in there])


def tree_sum(vectors: DataFrame, parts: int, fan: int = 32) -> DataFrame:
    """Vectors of 64-bit integers in pieces (piece, part, counts binary), of parts from 0 to ``parts`` - 1 -> their sum (piece, counts).

    In every round, the same piece of at most ``fan`` parts meets in a group.
    """

    def add(key: tuple, table: pa.Table) -> pa.Table:
        own = [np.frombuffer(c, "<i8") for c in table.column("counts").to_pylist()]
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([np.sum(own, axis=0).astype("<i8").tobytes()], pa.binary())})

    while parts > 1:
        vectors = vectors.withColumn("part", F.expr(f"part div {fan}")).groupBy("piece", "part").applyInArrow(add, "piece long, part long, counts binary")
        parts = -(-parts // fan)
    return vectors.select("piece", "counts")
