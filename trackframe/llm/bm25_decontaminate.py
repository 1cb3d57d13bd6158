"""Benchmark decontamination: training passages are queries against a BM25 inverted index of test items.

Items are cut into pieces of bounded length, which are the documents of the
index; its terms are pairs of adjacent words, as single words of a language are
shared by all its texts and would keep no passage out.  Postings hold impacts divided by the piece's score against itself, so
that one threshold fits all pieces, and are cut into blocks that know their
largest impact.  Every passage of every training document is a query; a
document-at-a-time WAND with block maxima returns all pieces above the
threshold.  The items so found are verified on the whole document: enough of
the words of both question and answer must lie in word shingles that the
document holds.  A short answer counts near the question; an item without a
question mark is judged as a whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.storage import row_hash, slices

_WORD = re.compile(r"\w+")
#: Letters of scripts that set no blanks between words (Thai to Lao, Burmese, Khmer, kana, Han): each is a word by itself.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_UNSPACED, _WORD_OR_LETTER = re.compile(f"[{_UNSPACED}]"), re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_END = 1 << 60


@dataclass(frozen=True)
class Settings:
    """Lengths in words; ``threshold`` is a share of a piece's score against itself."""

    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.5
    piece: int = 32  # longest piece of an item
    passage: int = 64  # a passage; the next one starts half as many words on
    shingle: int = 5
    overlap: float = 0.8  # of the words of the question, and of the answer; of the whole item without a question mark
    block: int = 64  # postings a block
    shard_bytes: int = 8 << 20  # item text that one broadcast index may hold


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without punctuation; of scripts without blanks, letters."""
    text = text or ""
    return (_WORD if text.isascii() or not _HAS_UNSPACED.search(text) else _WORD_OR_LETTER).findall(text.lower())


def question_end(text: str) -> int:
    """The place after the last question mark that words follow; -1 without one."""
    at = max(text.rfind("?"), text.rfind("？"))
    return at + 1 if at >= 0 and words_of(text[at:]) else -1


def split_item(text: str | None) -> tuple[list[str], list[str]]:
    """Question and answer of an item: up to its last question mark and what follows, or all sentences and the last."""
    text = (text or "").strip()
    at = question_end(text)
    if at < 0:
        ends = [m.end() for m in re.finditer(r"[.!?]+\s|[。！？]", text)]
        at = ends[-1] if ends else len(text)
    return words_of(text[:at]), words_of(text[at:])


def shingles_of(words: list[str], m: int) -> Iterator[tuple[str, ...]]:
    """Every run of m words, in order."""
    return zip(*(words[k:] for k in range(m)))


def covered(own: list[str], held: set[tuple[str, ...]], m: int) -> np.ndarray:
    """The words of ``own`` that lie in shingles of m words that are held."""
    out = np.zeros(len(own), bool)
    for k, shingle in enumerate(shingles_of(own, m)):
        if shingle in held:
            out[k : k + m] = True
    return out


def pairs_of(words: list[str]) -> list[str]:
    """The terms of a piece."""
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def pieces_of(words: list[str], most: int) -> list[list[str]]:
    """The words in even pieces of at most ``most``."""
    count = max(1, math.ceil(len(words) / most))
    cuts = [len(words) * k // count for k in range(count + 1)]
    return [words[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


class Index:
    """The inverted index of some items; term statistics are given, as they are those of all items."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], n_pieces: int, mean: float, settings: Settings):
        self.settings, self.items = settings, [(i, *split_item(t)) for i, t in items]
        self.asked = [question_end((t or "").strip()) >= 0 for _, t in items]
        self.owner: list[int] = []
        found: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for at, (_, question, answer) in enumerate(self.items):
            for piece in pieces_of(question + answer, settings.piece):
                terms = pairs_of(piece)
                if not terms:
                    continue
                norm = settings.k1 * (1 - settings.b + settings.b * len(terms) / mean)
                impact = {t: self._idf(frequency.get(t, 1), n_pieces) * n * (settings.k1 + 1) / (n + norm) for t, n in Counter(terms).items()}
                whole = sum(impact.values())
                for t, x in impact.items():
                    found[t].append((len(self.owner), x / whole))
                self.owner.append(at)
        # A pair's key is made of the numbers of its words; keys lie in order, with the numbers of their terms.
        pairs = [t.split(" ") for t in found]
        self.words = {w: k for k, w in enumerate(sorted({w for p in pairs for w in p}))}
        keys = np.array([self.words[a] * len(self.words) + self.words[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.rows = [np.array([r for r, _ in p], np.int64) for p in found.values()]
        self.impacts = [np.array([x for _, x in p]) for p in found.values()]
        self.block_ends = [r[settings.block - 1 :: settings.block].tolist() + r[-1:].tolist() for r in self.rows]
        self.block_max = [np.maximum.reduceat(x, np.arange(0, len(x), settings.block)).tolist() for x in self.impacts]
        self.most = np.array([x.max() for x in self.impacts] + [0.0])  # the last: words of no item

    @staticmethod
    def _idf(n: int, total: int) -> float:
        return math.log(1 + (total - n + 0.5) / (n + 0.5))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Pieces with a score of at least the threshold for a query of distinct terms, by block-max WAND."""
        limit = self.settings.threshold - 1e-9
        block = self.settings.block
        at = dict.fromkeys(terms, 0)
        out = []
        head = {t: int(self.rows[t][0]) for t in terms}
        while True:
            order = sorted((t for t in terms if head[t] < _END), key=head.__getitem__)
            bound, pivot = 0.0, None
            for k, t in enumerate(order):
                bound += self.most[t]
                if bound >= limit:
                    pivot = k
                    break
            if pivot is None:
                return out
            row = head[order[pivot]]
            while pivot + 1 < len(order) and head[order[pivot + 1]] == row:
                pivot += 1
            near, end, tight = order[: pivot + 1], _END, 0.0
            for t in near:  # the blocks that would hold the row
                k = at[t] // block
                while self.block_ends[t][k] < row and k + 1 < len(self.block_max[t]):
                    k += 1
                if self.block_ends[t][k] >= row:
                    tight += self.block_max[t][k]
                    end = min(end, self.block_ends[t][k])
            if tight < limit:  # no row up to the end of these blocks can reach it
                following = head[order[pivot + 1]] if pivot + 1 < len(order) else _END
                row = max(row + 1, min(end + 1, following))
            elif head[order[0]] == row:
                score = sum(self.impacts[t][at[t]] for t in near)
                if score >= limit:
                    out.append((row, float(score)))
                row += 1
            for t in near:
                if head[t] < row:
                    at[t] = int(np.searchsorted(self.rows[t], row))
                    head[t] = int(self.rows[t][at[t]]) if at[t] < len(self.rows[t]) else _END

    def _terms(self, words: list[str]) -> np.ndarray:
        """The terms that start at each word of a document; the number of terms where that is none of the index."""
        unknown = -len(self.words) * len(self.words) - 1  # no sum with it is a key
        at = np.fromiter(map(self.words.get, words, repeat(unknown)), np.int64, len(words))
        if len(at) < 2 or not len(self.keys):
            return np.empty(0, np.int64)
        keys = at[:-1] * len(self.words) + at[1:]
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.order[place], len(self.rows))

    def candidates(self, words: list[str]) -> dict[int, float]:
        """Items (by place) of which some passage finds a piece, with the best score."""
        ids = self._terms(words)
        none = len(self.rows)
        size, step = self.settings.passage, max(1, self.settings.passage // 2)
        total = np.r_[0.0, np.cumsum(self.most[ids])]
        starts = np.arange(0, max(1, len(ids) - size + step), step)
        bounds = total[np.minimum(starts + size, len(ids))] - total[np.minimum(starts, len(ids))]
        found: dict[int, float] = {}
        for start in starts[bounds >= self.settings.threshold - 1e-9].tolist():
            terms = sorted({t for t in ids[start : start + size].tolist() if t != none})
            if terms and self.most[terms].sum() >= self.settings.threshold - 1e-9:
                for row, score in self.search(terms):
                    item = self.owner[row]
                    found[item] = max(found.get(item, 0.0), score)
        return found

    def _answered(self, words: list[str], question: list[str], answer: list[str]) -> float:
        """1 if the document holds the short answer at most a passage away from a shingle of the question, else 0."""
        m, n = min(self.settings.shingle, len(question)), len(answer)
        own = set(shingles_of(question, m))
        at = np.array([k for k, s in enumerate(shingles_of(words, m)) if s in own], np.int64)
        said = np.array([k for k, s in enumerate(shingles_of(words, n)) if s == tuple(answer)], np.int64)
        # Of the shingles, only the next on each side of an answer can be near enough; an answer within one is part of the question.
        right = np.searchsorted(at, said + n)
        left = np.searchsorted(at, said - m, "right") - 1
        near = (right < len(at)) & (at[np.minimum(right, len(at) - 1)] - said - n <= self.settings.passage)
        near |= (left >= 0) & (said - at[np.maximum(left, 0)] - m <= self.settings.passage)
        inside = np.searchsorted(at, said, "right") - np.searchsorted(at, said + n - m, "left") > 0
        return float((near & ~inside).any())

    def verified(self, words: list[str]) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question overlap, answer overlap) of the candidates that a document holds."""
        found = self.candidates(words)
        least = self.settings.overlap
        held: dict[int, set[tuple[str, ...]]] = {}

        def share(own: list[str], m: int) -> np.ndarray:
            if m not in held:
                held[m] = set(shingles_of(words, m))
            return covered(own, held[m], m)

        out = []
        for at, score in found.items():
            name, question, answer = self.items[at]
            n = self.settings.shingle
            whole = share(question + answer, min(n, len(question) + len(answer)))
            parts = whole[: len(question)], whole[len(question) :]
            q, a = (float(x.mean()) if len(x) else 1.0 for x in parts)
            leak = min(q, a) >= least
            if not leak and not self.asked[at]:
                leak = float(whole.mean()) >= least
            elif not leak and question and answer:
                # Each by itself as well, as other words may lie between.
                if len(question) < n:
                    q = max(q, float(share(question, len(question)).mean()))
                if len(answer) < n and q >= least:
                    a = max(a, self._answered(words, question, answer))
                leak = min(q, a) >= least
            if leak:
                out.append((name, score, q, a))
        return out


def indexes(items: DataFrame, settings: Settings) -> Iterator[Index]:
    """Indexes of the items, a shard of bounded size at a time; their statistics are those of all items."""
    items = items.select(F.col("item_id").cast("long"), "text").filter("text is not null and item_id is not null").distinct()
    piece = settings.piece

    @F.pandas_udf("array<struct<term: string, n: int>>")
    def terms(texts: pd.Series) -> pd.Series:
        def count(text: str):
            question, answer = split_item(text)
            cut = pieces_of(question + answer, piece)
            return [{"term": t, "n": n} for t, n in Counter(t for p in cut for t in set(pairs_of(p))).items()] + [{"term": None, "n": len(p) - 1} for p in cut if len(p) > 1]

        return texts.map(count)

    counted = items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(1 << 20)).alias("place"), F.explode(terms("text")).alias("t")).select("place", "t.term", "t.n")
    whole = items.agg(F.sum(F.octet_length("text"))).first()[0]
    if not whole:
        return
    n_pieces, mean = counted.filter("term is null").agg(F.count("*"), F.avg("n")).first()
    if not n_pieces:
        return
    shards = math.ceil(whole / settings.shard_bytes)
    frequency = counted.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    for k in range(shards):
        own = items if shards == 1 else items.filter(F.pmod(F.pmod(F.xxhash64("item_id", "text"), F.lit(1 << 20)), F.lit(shards)) == k)
        used = frequency
        if shards > 1:
            here = counted.filter((F.pmod("place", F.lit(shards)) == k) & F.col("term").isNotNull()).select("term").distinct()
            used = frequency.join(here, "term", "left_semi")
        rows = [(r.item_id, r.text) for r in own.sort("item_id", "text").collect()]
        if rows:
            yield Index(rows, {r.term: r.df for r in used.collect()}, n_pieces, mean, settings)


def leaks(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, row, item_id, score, question_overlap, answer_overlap): every verified test item in every document.

    ``row`` is a hash of the document's id and text.  Items are indexed in
    shards of at most ``shard_bytes`` of text (a sum that Spark computes
    first); each shard's index is broadcast and all documents pass by it once,
    without a shuffle.  Items that are null or have fewer than two words are in no index;
    items of the same id and text count once.  Null and empty texts have no
    leak, documents of any length are searched whole, repeated rows are each
    reported.  No item gives an empty table.
    """
    spark = docs.sparkSession
    name = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {name}, row long, item_id long, score double, question_overlap double, answer_overlap double"
    own = docs.select("doc_id", row_hash(docs, ["doc_id", "text"]).alias("row"), "text")
    out = None
    for index in indexes(items, settings):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches):
                at, found = [], []
                for k, text in enumerate(batch.column(2).to_pylist()):
                    for hit in index.verified(words_of(text)):
                        at.append(k)
                        found.append(hit)
                if at:
                    kept = batch.select(["doc_id", "row"]).take(pa.array(at))
                    ids, scores, questions, answers = zip(*found)
                    columns = [*kept.columns, pa.array(ids, pa.int64()), *(pa.array(x, pa.float64()) for x in (scores, questions, answers))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "item_id", "score", "question_overlap", "answer_overlap"])

        part = own.mapInArrow(search, ddl)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], ddl) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without a verified test item; all columns stay.

    Each shard's index filters the rows where they lie, so nothing is
    shuffled.  Null, empty and repeated rows are treated as by ``leaks``.
    """
    at = docs.columns.index("text")
    for index in indexes(items, settings):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def free(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for some in slices(batches):
                kept = [not index.verified(words_of(t)) for t in some.column(at).to_pylist()]
                yield some.filter(pa.array(kept, pa.bool_()))

        docs = docs.mapInArrow(free, docs.schema)
    return docs
