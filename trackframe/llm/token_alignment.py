"""Alignment of the tokens of two tokenizers, with corpus-wide counts of the pairs of ids that they link.

A is a byte-level BPE (a file of the tokenizers library), B a sentencepiece
model.  A encodes a blank and the text, B the text, to which it adds the
blank itself, so both cut the same bytes.  Where tokens of both end, groups
end.  A link is a token of A and one of B whose bytes overlap: between two
neighbouring ends of either there is exactly one, so links are the union of
both lists of ends.

Neither tokenizer joins anything over a single blank between characters that
are no white space (checked on the files).  A text is therefore a row of
words, each beginning with its blank, and all figures of a text are sums over
its words.  Words that were aligned before are kept, in bounded memory; new
ones are encoded together.

The first pass over the documents counts, within a task, the documents that
hold each pair.  A minimal perfect hash function of the distinct pairs turns
these counts into dense vectors, which are summed as a tree.  The second pass
aligns the documents again and looks the counts up; the function keeps the
pairs, so one that the first pass has not met is an error.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm import perfect_hash
from trackframe.llm.storage import slices, stored

#: A pair is one number: A's id times this plus B's, so B has at most so many ids and A 2**17.
B_IDS = 1 << 15
#: Pairs whose function and counts (some 13 bytes each) are sent to every task; beyond it the second pass meets the counts in a join.
MOST_PAIRS = 8_000_000
#: Counts in a piece of a dense vector.
PIECE = 1 << 14
FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: A's cutting of texts, as the library's byte-level pre-tokenizer has it (a fixed value).
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_CUT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on in turn."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    """What a piece of B stands for."""
    byte = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


class Words:
    """The links of words, each word with the blank before it: (keys of its links as bytes, tokens of A, of B, groups, with ``strings`` ``a|b;a|b``), or None.

    None is a word whose tokens do not give its bytes back.
    """

    SPLIT = re.compile(r"(?<=\S) (?=\S)")
    #: White space of any library, at a word's edge; or nothing at all.
    BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    EDGE = rf"^(?:{BLANK}|$)|{BLANK}$"

    def __init__(self, a_path: str, b_path: str, strings: bool = True, most: int = 200_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            content = f.read()
        file = json.loads(content)
        self.a = Tokenizer.from_str(content)
        self.a.encode_special_tokens = True
        letters = byte_of_letter()
        special = {t["id"] for t in file["added_tokens"]}
        vocab = file["model"]["vocab"]
        self.a_bytes = {i: t.encode() if i in special else bytes(letters[c] for c in t) for t, i in (vocab | {t["content"]: t["id"] for t in file["added_tokens"]}).items()}
        # A byte-level BPE whose ids follow its merges is told by its ranks; that library is several times faster.
        ranked = {self.a_bytes[i]: i for i in vocab.values() if i not in special}
        plain = file["normalizer"] is None and file["pre_tokenizer"] == PLAIN_CUT and file["post_processor"] is None
        merged = [self.a_bytes[vocab["".join(m.split(" ") if isinstance(m, str) else m)]] for m in file["model"]["merges"]]
        in_turn = [ranked[m] for m in merged] == list(range(256, 256 + len(merged)))
        self.ranks = tiktoken.Encoding("a", pat_str=CUT, mergeable_ranks=ranked, special_tokens={}) if plain and in_turn else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(pieces) > B_IDS or max(self.a_bytes) >= 1 << 17:
            raise ValueError("too many token ids for the keys of pairs")
        self.b_bytes = list(map(piece_bytes, pieces))
        self.apart = plain and not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_sizes = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_sizes = np.array(list(map(len, self.b_bytes)))
        text = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.shown = [[text(len(s), end) for end in (",", last)] for s, last in ((self.a_sizes, "|"), (self.b_sizes, ";"))]
        self.strings, self.most, self.longest = strings, most, longest
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def encoded(self, text: str, latin: bool) -> tuple[list[int], list[int]]:
        """The ids of both; ``latin`` texts have no letters on which the libraries' tables of characters could differ."""
        a = self.ranks.encode_ordinary(" " + text) if self.ranks and latin else self.a.encode(" " + text, add_special_tokens=False).ids
        return a, self.b.encode(text, num_threads=1)

    def aligned(self, words: list[str], latin: bool) -> list[tuple | None]:
        """Words that neither begin nor end with white space (or one word of any kind), put into one text with blanks."""
        text = " ".join(words)
        a, b = self.encoded(text, latin)
        whole = " " + text
        if b"".join([self.a_bytes[i] for i in a]) != (raw := whole.encode()) or b"".join([self.b_bytes[i] for i in b]) != raw:
            return [None] if len(words) == 1 else [r for w in words for r in self.aligned([w], latin)]
        a, b = np.array(a), np.array(b)
        # For every byte: whether tokens of A (1) or B (2) end there, and how many did before.
        here = np.zeros(len(raw) + 1, np.uint8)
        here[np.cumsum(self.a_sizes[a])] |= 1
        here[np.cumsum(self.b_sizes[b])] |= 2
        ends = np.flatnonzero(here)
        here = here[ends]
        of_a, of_b, common = np.cumsum(here & 1, dtype=np.int64), np.cumsum(here >> 1, dtype=np.int64), here == 3
        keys = (a[of_a - (here & 1)] * B_IDS + b[of_b - (here >> 1)]).astype("<u4").tobytes()
        stops = np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in words]), "right")
        cuts = [[0, *c[stops - 1].tolist()] for c in (of_a, of_b, np.cumsum(common))]
        links = [0, *stops.tolist()]
        found = zip(links, links[1:], *(side for c in cuts for side in (c, c[1:])))
        if not self.strings:
            return [(keys[4 * e0 : 4 * e1], a1 - a0, b1 - b0, g1 - g0, "") for e0, e1, a0, a1, b0, b1, g0, g1 in found]
        # The tokens of both in the order in which they are shown: A's of a group, then B's.
        n_a, n_b = of_a[common], of_b[common]
        a_at, b_at = np.flatnonzero(here & 1), np.flatnonzero(here & 2)
        group = np.cumsum(common) - common
        shown = np.empty(len(a) + len(b), object)
        for ids, at, last, tables in ((a, np.arange(len(a)) + np.r_[0, n_b][group[a_at]], common[a_at], self.shown[0]), (b, np.arange(len(b)) + n_a[group[b_at]], common[b_at], self.shown[1])):
            shown[at] = np.where(last, tables[1][ids], tables[0][ids])
        shown = shown.tolist()
        return [(keys[4 * e0 : 4 * e1], a1 - a0, b1 - b0, g1 - g0, "".join(shown[a0 + b0 : a1 + b1])[:-1]) for e0, e1, a0, a1, b0, b1, g0, g1 in found]

    def of(self, words: list[str]) -> list[tuple | None]:
        """The alignments of distinct words."""
        if len(self.young) > self.most // 2:
            self.old, self.young = self.young, {}
        out: list = list(map(self.young.get, words))
        latin: list[int] = []
        other: list[int] = []
        for k in [k for k, r in enumerate(out) if r is None]:
            w = words[k]
            if w in self.old:
                self.young[w] = out[k] = self.old[w]
            elif w and w not in self.young:
                (latin if w.isascii() or max(w) < "ɐ" else other).append(k)
        for some, plain in ((latin, True), (other, False)):
            together = [k for k in some if not (words[k][0].isspace() or words[k][-1].isspace())] if self.apart else []
            runs = [together[k : k + 1000] for k in range(0, len(together), 1000)]
            for ks in runs + [[k] for k in sorted(set(some).difference(together))]:
                for k, record in zip(ks, self.aligned([words[k] for k in ks], plain)):
                    out[k] = record
                    if len(words[k]) <= self.longest:
                        self.young[words[k]] = record
        return out

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Texts as numbers of distinct words: the words' numbers, text after text, the texts' ends among them, and the words."""
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes, ends = coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy()[1:].astype(np.int64) - parts.offsets[0].as_py()
        # Blanks beside white space, or at a text's ends, stay within words.
        odd = pc.match_substring_regex(coded.dictionary, self.EDGE).to_numpy(zero_copy_only=False)
        if not self.apart:
            odd[:] = True
        bad = np.flatnonzero(np.add.reduceat(odd[codes].astype(np.int64), ends - np.diff(np.r_[0, ends]))) if len(ends) else []
        if len(bad):
            known = {w: k for k, w in enumerate(words)}
            own = np.split(codes, ends[:-1])
            for k in bad.tolist():
                text = texts[k].as_py()
                found = (self.SPLIT.split(text) if self.apart else [text]) if text else []
                own[k] = np.array([known.setdefault(w, len(known)) for w in found], np.int64)
            words, codes, ends = list(known), np.concatenate(own), np.cumsum(list(map(len, own)))
        return codes, ends, words


@lru_cache(maxsize=1)
def _words(a_path: str, b_path: str, strings: bool) -> Words:
    """The words of this Python worker, which the next tasks find known; with ``strings``, their groups too."""
    return Words(a_path, b_path, strings)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; sorting is faster than hashing here."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class Batch:
    """The texts of a batch as words with their alignments."""

    def __init__(self, words: Words, texts: pa.Array):
        self.codes, self.ends, names = words.split(texts)
        used = distinct(self.codes)  # words that only a text's first splitting had are in no text
        self.codes = np.searchsorted(used, self.codes)
        self.records = words.of([names[k] for k in used.tolist()])
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64) if len(self.ends) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[0, self.ends])
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        wrong = np.array([r is None for r in self.records], bool)
        self.sound = sizes > 0
        if wrong.any():
            self.sound[self.doc[wrong[self.codes]]] = False
        self.keys = np.frombuffer(b"".join([r[0] if r else b"" for r in self.records]), "<u4")
        self.links = np.array([len(r[0]) // 4 if r else 0 for r in self.records], np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over each text's words; 0 for texts that are not sound."""
        out = np.zeros(len(self.sound), np.int64)
        np.add.at(out, self.doc, values[self.codes])
        return np.where(self.sound, out, 0)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The texts and the keys of their distinct pairs."""
        there = self.sound[self.doc]
        at = distinct(self.doc[there] * len(self.records) + self.codes[there])
        doc, word = np.divmod(at, max(1, len(self.records)))
        each = self.links[word]
        ends = np.cumsum(each)
        first = (np.cumsum(self.links) - self.links)[word]
        keys = self.keys[np.repeat(first - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        both = distinct(np.repeat(doc, each).astype(np.uint64) << np.uint64(32) | keys.astype(np.uint64))
        return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def shown(self, k: int) -> str:
        """The groups of a text; empty if it is not sound."""
        if not self.sound[k]:
            return ""
        return ";".join([self.records[c][4] for c in self.codes[self.starts[k] : self.ends[k]].tolist()])


def pairs_by_task(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(key, dealt, n): how many texts of a task hold each pair of ids, and the hash by which keys are dealt."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(a_path, b_path, False)
        keys, counts, waiting, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([keys, *(k for k, _ in waiting)]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([counts, *(n for _, n in waiting)]), len(every)).astype(np.int64)

        for batch in slices(batches, 1024):
            _, own = Batch(words, batch.column(0)).pairs()
            own.sort()
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
            waiting.append((own[first], np.diff(np.r_[first, len(own)])))
            size += len(waiting[-1][0])
            if size > 2_000_000:
                keys, counts = merged()
                waiting, size = [], 0
        keys, counts = merged()
        for k in range(0, len(keys), 50_000):
            own = keys[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(perfect_hash.dealt(own)), pa.array(counts[k : k + 50_000])], names=["key", "dealt", "n"])

    return docs.select("text").mapInArrow(counted, "key long, dealt long, n long")


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a_id, b_id, n_docs, best): the documents that hold each linked pair, and whether no pair of its A id has more.

    Null and empty texts, and those whose tokens do not give their bytes back,
    hold none; repeated rows count each.  A table without pairs is empty.
    """
    return _counts(stored(pairs_by_task(docs, a_path, b_path), "pairs"))


def _counts(pairs: DataFrame) -> DataFrame:
    n = pairs.groupBy("key").agg(F.sum("n").alias("n_docs")).select(F.expr(f"key div {B_IDS}").alias("a_id"), F.expr(f"key % {B_IDS}").alias("b_id"), "n_docs")
    most = n.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    return n.join(most, "a_id").select("a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def dense_counts(pairs: DataFrame, function: Broadcast, n: int) -> np.ndarray:
    """The counts of all pairs in the order of the function's values: a dense vector a task, summed as a tree."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(n, "<i8")
        for batch in batches:
            at = function.value.values(batch.column(0).to_numpy())
            if (at < 0).any():
                raise ValueError("a pair is not among those that the function was built for")
            np.add.at(own, at, batch.column(1).to_numpy())
        part = TaskContext.get().partitionId()
        for k in range(0, n, PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([k // PIECE], pa.int64()), pa.array([part], pa.int64()), pa.array([own[k : k + PIECE].tobytes()], pa.binary())], names=["piece", "part", "counts"])

    made = stored(pairs.select("key", "n").mapInArrow(vectors, "piece long, part long, counts binary"), "count-vectors")
    parts = (made.agg(F.max("part")).first()[0] or 0) + 1
    rows = stored(perfect_hash.tree_sum(made, parts), "counts").collect()
    return np.frombuffer(b"".join(bytes(r["counts"]) for r in sorted(rows, key=lambda r: r["piece"])), "<i8")


def align(docs: DataFrame, a_path: str, b_path: str, most_pairs: int = MOST_PAIRS, groups: bool = False) -> DataFrame:
    """Documents -> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and ``groups`` itself if asked for.

    ``groups`` is ``a,a|b;a|b,b``: the ids of A and B of each group; its hash
    is empty for a text without tokens.  Null and empty texts, and texts whose
    tokens' bytes differ from a blank and the text (those with U+2581), have
    no tokens and figures of 0; texts of any length are aligned whole.  Each
    row counts as a document, repeated ones and those of a null doc_id too;
    an empty table gives an empty one, and further columns are not looked at.

    Up to ``most_pairs`` distinct pairs, their function and counts go to every
    task; beyond it the links of each row are joined with the counts.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    pairs = stored(pairs_by_task(docs, a_path, b_path), "pairs")
    keys = stored(pairs.select("key", "dealt").distinct(), "keys")
    n = keys.count()
    if n > most_pairs:
        return _joined(docs, pairs, a_path, b_path, groups)
    built = perfect_hash.build(keys, n)
    function = spark.sparkContext.broadcast(built)
    counts = dense_counts(pairs, function, n)
    function.destroy()
    most = np.zeros(1 << 17, np.int64)
    np.maximum.at(most, built.keys // B_IDS, counts)
    known = spark.sparkContext.broadcast((built, counts, counts == most[built.keys // B_IDS]))

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function, counts, best = known.value
        words = _words(a_path, b_path, True)
        for some in slices(batches, 1024):
            own = Batch(words, some.column(1))
            at = function.values(own.keys)
            if not (at >= 0).all() and own.sound.all():
                raise ValueError("a pair of ids is linked that the first pass has not met")
            word = np.repeat(np.arange(len(own.links)), own.links)
            total = [np.bincount(word, np.where(at >= 0, v[at], 0) if n else None, len(own.links)).astype(np.int64) for v in (best, counts)]
            yield _rows(some.column(0), own, total, groups)

    return docs.mapInArrow(figures, _ddl(groups))


def _ddl(groups: bool) -> str:
    return "doc_id long, " + ", ".join(f"{c} long" for c in FIGURES) + ", groups_sha256 string" + ", groups string" * groups


def _rows(doc_id: pa.Array, own: Batch, total: list[np.ndarray], groups: bool) -> pa.RecordBatch:
    """The rows of a batch; ``total`` has n_best and count_sum of each word."""
    values = [np.array([r[k] if r else 0 for r in own.records], np.int64) for k in (1, 2, 3)] + [own.links, *total]
    columns = [doc_id.cast(pa.int64()), *(pa.array(own.sums(v)) for v in values)]
    shown = [own.shown(k) for k in range(len(doc_id))]
    columns.append(pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown], pa.string()))
    names = ["doc_id", *FIGURES, "groups_sha256"]
    return pa.RecordBatch.from_arrays(columns + [pa.array(shown, pa.string())] * groups, names=names + ["groups"] * groups)


def _joined(docs: DataFrame, pairs: DataFrame, a_path: str, b_path: str, groups: bool) -> DataFrame:
    """As align, for pairs of any number: the links of a row, counted by pair, meet the pairs' counts in a join."""

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(a_path, b_path, True)
        for some in slices(batches, 256):
            own = Batch(words, some.column(1))
            nothing = np.zeros(len(own.links), np.int64)
            rows = _rows(some.column(0), own, [nothing, nothing], groups)
            ends = np.cumsum(own.links)
            lists = []
            for k in range(len(own.sound)):
                codes = own.codes[own.starts[k] : own.ends[k]] if own.sound[k] else []
                keys = np.concatenate([own.keys[ends[c] - own.links[c] : ends[c]] for c in codes]) if len(codes) else np.empty(0, np.int64)
                lists.append(np.unique(keys.astype(np.int64), return_counts=True))
            columns = [pa.array([x[i].tolist() for x in lists], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, "keys", "times"])

    own = docs.mapInArrow(figures, _ddl(groups) + ", keys array<long>, times array<long>")
    own = stored(own.withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = own.select("row", F.explode(F.arrays_zip("keys", "times")).alias("l")).select("row", F.col("l.keys").alias("key"), F.col("l.times").alias("times"))
    counts = _counts(pairs).select((F.col("a_id") * B_IDS + F.col("b_id")).alias("key"), "n_docs", "best")
    sums = links.join(counts, "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n_docs")).alias("total"))
    out = own.join(sums, "row", "left").withColumns({"n_best": F.coalesce("best", F.lit(0)), "count_sum": F.coalesce("total", F.lit(0))})
    return out.select("doc_id", *FIGURES, "groups_sha256", *(["groups"] * groups))
