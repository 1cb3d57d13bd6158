"""SimHash near-duplicates: fingerprints compared bit plane by bit plane.

A fingerprint has 64 bits from the XXH64 hashes of word shingles.  Two
fingerprints within the radius agree wholly on some of the blocks of bits that
they are cut into, so rows are keyed by every choice of such blocks and only
rows that share a key meet.  Within a task the rows of all keys lie in bit
planes (one bit a row), and the distances of every row to the one d places on
are counted for 64 rows at a time by carry-save bitwise counters; words whose
rows all exceed the radius are given up early.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.components import components
from trackframe.llm.storage import partitions_for, row_hash, salted_join, slices, stored

BITS = 64


def hashes(text: str | None, width: int = 4, seed: int = 42) -> Iterator[np.ndarray]:
    """The XXH64 hashes of a text's word shingles, in parts of bounded length; none without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    count = max(1, len(words) - width + 1)
    ends = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    starts, ends = starts[:count].tolist(), ends.tolist()
    for at in range(0, count, 1 << 16):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], np.uint64)


def folded(parts: Iterator[np.ndarray]) -> int:
    """The fingerprint of hashes, as an unsigned number; zero without any."""
    ones, count = np.zeros(BITS, np.int64), 0
    for part in parts:
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(part)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text, as an unsigned number; zero without a word."""
    return folded(hashes(text, width, seed))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """documents -> (doc_id, row, fingerprint): row is a hash of the id and text, fingerprint a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1024):
            found = np.array([fingerprint(t, width, seed) for t in some.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(found)], names=["doc_id", "row", "fingerprint"])

    name = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_hash(docs, ["doc_id", "text"]).alias("row"), "text").mapInArrow(of, f"doc_id {name}, row long, fingerprint long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """One mask of bits for every choice of the blocks that must be untouched."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    whole = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(whole, blocks - radius)]


class Planes:
    """Fingerprints stored vertically: plane b holds bit b of every row, 64 rows a word."""

    def __init__(self, prints: np.ndarray):
        n = len(prints)
        self.words = (n + 63) // 64
        bits = np.zeros((self.words * 64 + 64 * (self.words + 1), 8), np.uint8)
        bits[:n] = prints.view(np.uint8).reshape(-1, 8)
        flat = np.unpackbits(bits, axis=1, bitorder="little").T
        self.planes = np.packbits(np.ascontiguousarray(flat), axis=1, bitorder="little").view(np.uint64)

    def _moved(self, plane: np.ndarray, at: np.ndarray, d: int) -> np.ndarray:
        q, r = divmod(d, 64)
        low = plane[at + q]
        return low if r == 0 else (low >> np.uint64(r)) | (plane[at + q + 1] << np.uint64(64 - r))

    def close(self, d: int, lanes: np.ndarray, radius: int) -> np.ndarray:
        """Of the rows whose bit in lanes (words of 64 rows) is set, those within the radius of the row d places on."""
        at = np.flatnonzero(lanes)
        alive = lanes[at]
        size = max(3, int(radius).bit_length() + 1)
        counter = [np.zeros(len(at), np.uint64) for _ in range(size)]
        over = np.zeros(len(at), np.uint64)
        for b in range(0, BITS, 2):
            x = self.planes[b][at] ^ self._moved(self.planes[b], at, d)
            y = self.planes[b + 1][at] ^ self._moved(self.planes[b + 1], at, d)
            c = counter[0]
            half = x ^ y  # full adder of the two planes and the lowest counter
            carry = (x & y) | (half & c)
            counter[0] = half ^ c
            for k in range(1, size):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if b % 8 == 6:
                alive = alive & ~(over | self._above(counter, radius))
                left = np.flatnonzero(alive)
                if len(left) < len(at):
                    at, alive, over = at[left], alive[left], over[left]
                    counter = [z[left] for z in counter]
                    if not len(at):
                        break
        rows = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, bit = np.nonzero(rows)
        return at[word] * 64 + bit

    @staticmethod
    def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
        """Lanes whose counter is more than the radius, compared from the highest bit down."""
        more, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
        for k in reversed(range(len(counter))):
            if radius >> k & 1:
                same = same & counter[k]
            else:
                more = more | (same & counter[k])
                same = same & ~counter[k]
        return more


def links_in_runs(keys: np.ndarray, prints: np.ndarray, radius: int, same: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows with equal, adjacent keys, as two arrays of rows.

    ``same`` has the last word on two rows within the radius, if given.
    """
    n = len(prints)
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[begins, n])
    rest = np.repeat(begins + lengths, lengths) - np.arange(n)  # rows from this one to the end of its run
    planes, root = Planes(prints), np.arange(n)
    found_a: list[int] = []
    found_b: list[int] = []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for d in range(1, int(lengths.max(initial=1))):
        mask = np.zeros(planes.words * 64, np.uint8)
        mask[:n] = rest > d
        a = planes.close(d, np.packbits(mask, bitorder="little").view(np.uint64), radius)
        new = root[a] != root[a + d]
        for i in a[new].tolist():
            p, q = top(i), top(i + d)
            if p != q and (same is None or same(i, i + d)):
                root[max(p, q)] = min(p, q)
                found_a.append(i)
                found_b.append(i + d)
        if new.any():
            while not np.array_equal(up := root[root], root):
                root = up
    return np.array(found_a, np.int64), np.array(found_b, np.int64)


def blocks_for(count: int, radius: int, most: int) -> int:
    """The least number of blocks for which random fingerprints seldom give a key more than ``most`` rows.

    More blocks mean more bits a key and more keys a fingerprint; any number
    finds all links.
    """
    for blocks in range(radius + 2, radius + 6):
        bits = min(bin(m).count("1") for m in block_masks(radius, blocks))
        if 4 * count <= most << bits:
            break
    return blocks


def links(nodes: DataFrame, radius: int = 4, blocks: int | None = None, most: int = 4096) -> DataFrame:
    """Distinct fingerprints (column fingerprint, a stored table) -> (a, b): links that connect what any chain of links connects.

    Every pair within the radius shares a key; the number of blocks is chosen
    by the number of fingerprints, if it is not given.  A key with over ``most``
    fingerprints is cut into parts and its rows go to one group for each two
    parts, so that no group has more than twice that many.
    """
    spark = nodes.sparkSession
    n = partitions_for(spark)
    masks = block_masks(radius, blocks or blocks_for(nodes.count(), radius, most))
    keyed = nodes.select(
        "fingerprint",
        F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("fingerprint").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for k, m in enumerate(masks)))).alias("key"),
    )
    large = keyed.groupBy("key").count().filter(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fingerprint", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = keyed.join(large, "key", "left").withColumn("part", part)
    other = F.when(F.coalesce("parts", F.lit(1)) == 1, F.array(F.lit(0))).otherwise(F.expr("filter(sequence(0, parts - 1), x -> x <> part)"))
    dealt = dealt.withColumn("other", F.explode(other)).select(
        F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "fingerprint"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(k: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
            same = np.r_[False, k[1:] == k[:-1]]
            paired = same | np.r_[same[1:], False]  # rows that are alone with their key have nothing to meet
            k, p = k[paired], p[paired]
            if len(k):
                a, b = links_in_runs(k, p, radius)
                yield pa.RecordBatch.from_arrays([pa.array(p[a]), pa.array(p[b])], names=["a", "b"])

        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            prints = np.r_[prints, batch.column(1).to_numpy(zero_copy_only=False)]
            if len(keys) >= 1 << 16 and keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1], "left"))
                yield from out(keys[:cut], prints[:cut])
                keys, prints = keys[cut:], prints[cut:]
        if len(keys):
            yield from out(keys, prints)

    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def _marked(docs: DataFrame, width: int, radius: int, blocks: int | None, most: int) -> DataFrame:
    """documents -> (doc_id, row, fingerprint, root, component_id); root is a fingerprint that names the component."""
    prints = stored(fingerprints(docs, width), "fingerprints")
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "nodes")
    found = components(links(nodes.select("fingerprint"), radius, blocks, most))
    rooted = nodes.join(found, nodes.fingerprint == found.node, "left").select("fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = stored(salted_join(rooted, least, ["root"], ["fingerprint"]).select("fingerprint", "root", "component_id"), "named")
    return salted_join(prints, named, ["fingerprint"], ["doc_id", "row"]).select("doc_id", "row", "fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, blocks: int | None = None, most: int = 4096) -> DataFrame:
    """documents -> (doc_id, row, fingerprint, component_id), a row for each row of ``docs``.

    ``component_id`` is the smallest doc_id that links of at most ``radius``
    differing bits reach.  Null and empty texts and those of white space alone
    have fingerprint zero and are linked like any other; a null doc_id gets
    the component of its fingerprint, and a component of null ids alone is
    null.  Repeated rows come back as often as they came; other columns are
    not looked at; a text of any length is folded in bounded parts.  Each exact
    fingerprint is compared once, however many documents have it, and its
    documents are joined salted.
    """
    return _marked(docs, width, radius, blocks, most).drop("root")


def hex16(column) -> F.Column:
    """A long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4, blocks: int | None = None, most: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id.

    All columns are kept, whatever their names.  Of repeated rows one stays,
    of different texts with the smallest doc_id the one with the smaller hash;
    a null doc_id stays only where a component has no other.
    """
    marked = _marked(docs, width, radius, blocks, most)
    return chosen_rows(docs, marked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m")))


def chosen_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and row hash are in column m, a struct, of ``chosen``; of repeated rows one."""
    chosen = chosen.select(F.col("m.doc_id").alias("_id"), F.col("m.row").alias("_row"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col("doc_id").alias("id"), row_hash(docs, ["doc_id", "text"]).alias("row"))
    kept = own.join(chosen, (own.row == chosen._row) & own.id.eqNullSafe(chosen._id), "left_semi")
    return kept.dropDuplicates(["row", "id"]).select("d.*")
