"""Ranked lexical search turned round: the items to be searched for are indexed, the documents stream through.

Terms are runs of ASCII letters and digits and of characters beyond ASCII;
only A to Z are lower-cased.  One pass over the texts keeps each document's
length and its counts of the items' terms, in a stored table from which the
corpus-wide figures are taken.  The inverted index over the items' terms, with
their weights, is then sent to every task: a document's counts go through it
and add up to its scores for all items at once, and each item keeps its best
documents in a heap of fixed size.  The heaps of all tasks are merged in two
steps.  Items beyond ``SHARD`` bytes of text are searched in shards, one after
the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.storage import slices, stored

#: Text of the items of a shard in bytes, so that its index fits into every task; cells of documents and items that are scored at once.
SHARD, CELLS = 32 << 20, 1 << 21
#: Every byte of a term as it counts, blanks for all others.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_in(text: str, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in turn, in lists of bounded size."""
    own = text.encode().translate(LOWER)
    at = 0
    while at < len(own):
        end = own.find(b" ", at + piece) if at + piece < len(own) else -1
        end = len(own) if end < 0 else end
        yield own[at:end].split()
        at = end


@dataclass
class Index:
    """Postings of a shard: the items of each term one after the other, and the terms' weights."""

    items: list
    starts: np.ndarray
    sizes: np.ndarray
    postings: np.ndarray
    weights: np.ndarray


class Heaps:
    """The ``most`` best documents of each item: higher scores first, then lower ids."""

    def __init__(self, n_items: int, most: int):
        self.n, self.most = n_items, most
        self.item, self.score, self.doc = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.ones(n_items, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """Scores of documents (rows) for all items (columns)."""
        least = self.least
        if len(docs) > self.most:
            least = np.maximum(least, np.partition(scores, len(docs) - self.most, axis=0)[len(docs) - self.most])
        row, item = np.nonzero(scores >= least)
        self.put(item, scores[row, item], docs[row])

    def put(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        if not len(item):
            return
        item, score, doc = np.r_[self.item, item], np.r_[self.score, score], np.r_[self.doc, doc]
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.item, self.score, self.doc = (a[place < self.most] for a in (item, score, doc))
        full = place == self.most - 1
        self.least[item[full]] = score[full]


def counted(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms and its counts of those of the vocabulary, by their numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in slices(batches, 1024):
            lengths, terms, tfs = [], [], []
            for text in batch.column(1).to_pylist():
                n, own = 0, []
                for some in terms_in(text or ""):
                    n += len(some)
                    own += [i for i in map(number, some) if i is not None]
                at, tf = np.unique(np.array(own, np.int32), return_counts=True)
                lengths.append(n)
                terms.append(at)
                tfs.append(tf)
            offsets = pa.array(np.cumsum([0, *map(len, terms)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(k))) for x, k in ((terms, np.int32), (tfs, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def searched(counts: DataFrame, index: Broadcast, n_docs: int, n_terms: int, most: int) -> DataFrame:
    """(part, item, doc_id, score): the heaps of all items that each task is left with."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        wide = len(own.items)
        heaps = Heaps(wide, most)
        for batch in slices(batches, max(1, min(4096, CELLS // wide))):
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            doc, term = np.repeat(np.arange(batch.num_rows), sizes), lists.flatten().to_numpy()
            tf = batch.column(3).flatten().to_numpy()
            m = 100 - 90 + 90 * batch.column(1).to_numpy() * n_docs // n_terms
            value = own.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            scores = np.zeros((batch.num_rows, wide), np.int64)
            # Whole documents, as many at once as keep the matches few.
            each = own.sizes[term]
            stops = np.cumsum(each)
            first = 0
            while first < len(term):
                last = max(first + 1, int(np.searchsorted(stops, (stops[first - 1] if first else 0) + 4 * CELLS, "right")))
                n, ends = each[first:last], np.cumsum(each[first:last])
                at = np.repeat(own.starts[term[first:last]] - (ends - n), n) + np.arange(ends[-1])
                np.add.at(scores.reshape(-1), np.repeat(doc[first:last] * wide, n) + own.postings[at], np.repeat(value[first:last], n))
                first = last
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            heaps.add(scores[named], batch.column(0).drop_null().to_numpy())
        part = np.full(len(heaps.item), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part, heaps.item, heaps.doc, heaps.score)], names=["part", "item", "doc_id", "score"])

    return counts.mapInArrow(search, "part long, item long, doc_id long, score long")


def best(heaps: DataFrame, most: int, by: list[str]) -> DataFrame:
    """The first ``most`` rows of each group, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def rank(docs: DataFrame, items: DataFrame, most: int = 10, shard: int = SHARD) -> DataFrame:
    """Documents (doc_id, text) and items (item_id, text) -> (item_id, rank, doc_id, score), the ``most`` best documents of each item.

    Only scores above 0 rank; equal ones by ascending doc_id.  Null and empty
    texts have no terms, items without any or without a match no rows.  Rows
    of items with the same item_id (a null one, too) are one item with the
    terms of all.  Repeated documents rank each; those of a null doc_id count
    in all corpus-wide figures but are not ranked, as nothing names them.
    Texts of any length are counted whole, in pieces; empty tables give an
    empty one, and further columns are not looked at.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            ids, found = batch.column(0).to_pylist(), [sorted({t for some in terms_in(x or "") for t in some}) for x in batch.column(1).to_pylist()]
            rows = [(i, t.decode()) for i, own in zip(ids, found) for t in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["item_id", "term"])

    terms = stored(items.select("item_id", "text").mapInArrow(split, "item_id long, term string").distinct(), "item-terms")
    size = terms.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    shards = max(1, -(-size // shard))
    out = None
    for k in range(shards):
        own = terms.filter(F.pmod(F.hash("item_id"), F.lit(shards)) == k).collect()
        if not own and k:
            continue
        found = _ranked(docs, own, most)
        out = found if out is None else out.unionByName(found)
    return out


def _ranked(docs: DataFrame, pairs: list, most: int) -> DataFrame:
    """The ranks of one shard, given as (item_id, term)."""
    spark = docs.sparkSession
    names = sorted({t for _, t in pairs})
    number = {t: k for k, t in enumerate(names)}
    ids = sorted({i for i, _ in pairs}, key=lambda i: (i is not None, i))
    at = {i: k for k, i in enumerate(ids)}
    vocabulary = spark.sparkContext.broadcast({t.encode(): k for t, k in number.items()})
    counts = stored(counted(docs, vocabulary), "term-counts")
    vocabulary.destroy()
    n_docs, n_terms = counts.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = np.zeros(len(names), np.int64)
    for term, w in held.select("term", weight.alias("w")).collect():
        weights[term] = w
    term, item = np.array([number[t] for _, t in pairs], np.int64), np.array([at[i] for i, _ in pairs], np.int64)
    order = np.lexsort((item, term))
    sizes = np.bincount(term, minlength=len(names))
    if not ids or not n_terms:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # A term of weight 0 adds nothing.
    index = spark.sparkContext.broadcast(Index(ids, np.cumsum(sizes) - sizes, np.where(weights > 0, sizes, 0), item[order], weights))
    heaps = searched(counts, index, n_docs, n_terms, most).withColumn("some", F.expr("part div 256"))
    merged = best(best(heaps, most, ["item", "some"]).drop("rank"), most, ["item"])
    named = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
    return merged.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
