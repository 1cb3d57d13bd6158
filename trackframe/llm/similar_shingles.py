"""Near-duplicates by the Jaccard similarity of word shingles.

Sets of shingles that share a band of min-hashes are candidates; these links
are closed to loose components by plain grouped minima.  Within a loose
component all sets meet: bit planes of SimHash fingerprints with a wide radius
keep far pairs out, and the similarity of every other pair that nothing links
yet is computed from the whole sets.  Only links so verified make components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.components import components
from trackframe.llm.simhash_planes import chosen_rows, folded, hashes, links_in_runs
from trackframe.llm.storage import partitions_for, row_hash, salted_join, slices, stored

#: Sets with similarity 0.8 share none of 24 bands of 5 with a chance of 0.00007, and differ in over 24 bits far more rarely.
WIDTH, SIMILARITY, BANDS, ROWS, RADIUS = 5, 0.8, 24, 5, 24
_random = np.random.default_rng(42)
_MASKS, _FACTORS = _random.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_FACTORS |= np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles in order; a text of fewer words is one shingle."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashes(text, width)]))


def node(own: np.ndarray) -> int:
    """A signed number that names a set; zero for the empty one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64)) if len(own) else 0


def band_keys(own: np.ndarray) -> list[int]:
    """A number for each band of min-hashes; none for the empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), 512):
        np.minimum(least, ((own[at : at + 512] ^ _MASKS) * _FACTORS).min(axis=1), out=least)
    return [xxhash.xxh3_64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(least.reshape(BANDS, ROWS))]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets in order."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / max(1, len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, row, node, bytes, keys)."""
    name = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", row_hash(docs, ["doc_id", "text"]).alias("row"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            nodes, keys = [], []
            for text in some.column(3).to_pylist():
                found = shingle_set(text)
                nodes.append(node(found))
                keys.append(band_keys(found))
            columns = [*some.columns[:2], pa.array(nodes, pa.int64()), some.column(2), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "node", "bytes", "keys"])

    return own.mapInArrow(of, f"doc_id {name}, row long, node long, bytes long, keys array<long>")


def _verified(texts: DataFrame, partitions: int) -> DataFrame:
    """(key, text) -> (a, b): links between the sets of texts with equal keys that connect what all similar pairs connect."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        sets: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            def same(i: int, j: int) -> bool:
                x, y = sorted((len(sets[i]), len(sets[j])))
                return x >= SIMILARITY * y and similarity(sets[i], sets[j]) >= SIMILARITY

            prints = np.array([folded([s]) for s in sets], np.uint64).view(np.int64)
            a, b = links_in_runs(np.array(keys, np.int64), prints, RADIUS, same)
            names = np.array([node(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], names=["a", "b"])

        for some in slices(batches):
            for key, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                if keys and key != keys[-1] and (len(keys) >= 1024 or size >= 1 << 21):
                    yield from out()
                    keys, sets, size = [], [], 0
                keys.append(key)
                sets.append(shingle_set(text))
                size += len(sets[-1])
        if keys:
            yield from out()

    return texts.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame, most: int = 2048, most_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of similar texts the one with the smallest doc_id.

    Texts are similar if their sets of shingles have a Jaccard similarity of
    at least 0.8; those without a word are equal.  Loose components with over
    ``most`` sets or ``most_bytes`` of text are cut into parts; every two
    parts meet in a group of their own.  A text of any length is one set of
    all its shingles; an empty table gives an empty one.  All columns are
    kept, whatever their names; repeated rows and null ids are treated as by simhash_planes.keep_one.
    """
    nodes = stored(
        sketches(docs).groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("m"), F.max("bytes").alias("bytes"), F.first("keys").alias("keys")),
        "sketches",
    )
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("last")).filter("least <> last").drop("last")
    loose = stored(components(salted_join(keyed, shared, ["key"], ["node"]).select(F.col("node").alias("a"), F.col("least").alias("b"))), "loose")
    members = stored(loose.join(nodes, "node").select("node", F.col("root").alias("loose"), F.col("m.row").alias("_row"), "bytes"), "members")
    cuts = F.ceil(F.greatest(F.count("*") / most, F.sum("bytes") / most_bytes)).cast("int").alias("parts")
    members = salted_join(members, members.groupBy("loose").agg(cuts), ["loose"], ["node"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int"))
    other = F.when(F.col("parts") <= 1, F.array(F.lit(0))).otherwise(F.expr("filter(sequence(0, parts - 1), x -> x <> part)"))
    texts = docs.select(row_hash(docs, ["doc_id", "text"]).alias("row"), "text")
    texts = texts.join(members, texts.row == members._row).withColumn("other", F.explode(other))
    texts = texts.select(F.xxhash64("loose", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "text")
    found = components(_verified(texts, partitions_for(docs.sparkSession)))
    rooted = nodes.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    return chosen_rows(docs, rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("m").alias("m")))
