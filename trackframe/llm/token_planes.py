"""Token ids in files of compressed bit or byte planes.

Documents are dealt by ranges of their order (that of doc_id, unless told
otherwise), sorted, encoded and packed into files.  A file holds blocks of a fixed number of 32-bit ids (the last of a file
may be shorter).  A block is transposed so that all lowest bytes (or bits) come
first, then the next ones; every plane is compressed by zstandard.  An index of
the blocks and of the documents follows:

    "TKPL" | planes a block u32 | partition u32 | file of the partition u32
    the planes, block after block
    block index: for each block, offset u64, ids u32, crc32 of the ids u32, a length u32 for each plane
    document index (zstandard): for each document, has an id u8; id i64; ids u64
    ids u64 | documents u64 | offset of the block index u64 | of the document index u64 | "TKPLEND\\n"

All numbers are little-endian.  The files are written through Spark's text
writer, one value a file, whose line separator is the last byte of the file;
so they can lie in any file system that Spark knows, and a lost task is
committed once.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackframe.llm.storage import partitions_for, slices, stored

HEAD, TAIL = b"TKPL", b"TKPLEND\n"
_FOOT = struct.Struct("<QQQQ8s")


def split_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids: 4 of bytes, or 32 of bits (eight ids a byte)."""
    table = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [table[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(table, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block from its planes."""
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def pack(part: int, seq: int, docs: list[tuple[int | None, int]], ids: np.ndarray, block: int, kind: str, level: int) -> bytes:
    """One file as bytes."""
    squeeze = zstandard.ZstdCompressor(level=level)
    count = 4 if kind == "byte" else 32
    out, index = [HEAD, struct.pack("<III", count, part, seq)], []
    at = 16
    for k in range(0, len(ids), block):
        own = ids[k : k + block]
        planes = [squeeze.compress(p) for p in split_planes(own, kind)]
        index.append(struct.pack(f"<QII{count}I", at, len(own), zlib.crc32(own.astype("<u4").tobytes()), *map(len, planes)))
        out += planes
        at += sum(map(len, planes))
    blocks_at = at
    out += index
    at += sum(map(len, index))
    known = np.array([d is not None for d, _ in docs], np.uint8)
    table = squeeze.compress(known.tobytes() + np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([n for _, n in docs], "<u8").tobytes())
    out += [table, _FOOT.pack(len(ids), len(docs), blocks_at, at, TAIL)]
    return b"".join(out)


def _foot(content: bytes) -> tuple[int, int, int, int, int, int, int]:
    n_ids, n_docs, blocks_at, docs_at, tail = _FOOT.unpack_from(content, len(content) - _FOOT.size)
    if content[:4] != HEAD or tail != TAIL:
        raise ValueError("not a file of token planes")
    return (n_ids, n_docs, blocks_at, docs_at, *struct.unpack_from("<III", content, 4))


def unpack(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The doc_ids of a file, their numbers of ids, and all its ids; every block is checked."""
    n_ids, n_docs, blocks_at, docs_at, count, _, _ = _foot(content)
    entry, read = struct.Struct(f"<QII{count}I"), zstandard.ZstdDecompressor()
    parts = []
    for at in range(blocks_at, docs_at, entry.size):
        where, n, crc, *sizes = entry.unpack_from(content, at)
        planes = []
        for size in sizes:
            planes.append(read.decompress(content[where : where + size]))
            where += size
        ids = join_planes(planes, n)
        if len(ids) != n or zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block of token ids is damaged")
        parts.append(ids)
    table = read.decompress(content[docs_at : len(content) - _FOOT.size])
    known = np.frombuffer(table, np.uint8, n_docs)
    names = np.frombuffer(table, "<i8", n_docs, n_docs)
    sizes = np.frombuffer(table, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    ids = np.concatenate(parts) if parts else np.empty(0, "<u4")
    if len(ids) != n_ids or sizes.sum() != n_ids:
        raise ValueError("a file of token planes is incomplete")
    return [int(d) if k else None for d, k in zip(names.tolist(), known)], sizes, ids


#: The normalizer and pre-tokenizer that WordEncoder's fast path stands for, as tokenizer files state them.
FAST = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def may_split_words(tokenizer: str) -> bool:
    """Whether a tokenizer (its file's content) cuts texts as WordEncoder's fast path does, so that words can be encoded one by one."""
    file = json.loads(tokenizer)
    special = [t["content"] for t in file.get("added_tokens") or []]
    return (
        all(file.get(k) == v for k, v in FAST.items())
        and not file.get("truncation") and not file.get("padding")
        and all(t.startswith("<|") for t in special)
    )


class WordEncoder:
    """Encodes texts with a tokenizer; where its pieces never cross white space, a distinct word once a batch.

    Tokenizers with another normalizer or pre-tokenizer than ``FAST`` get
    every text whole.

    A text of Latin-1 characters is lower-cased, the punctuation at the end of
    a word is set apart and the text is split at blanks, all in Arrow's
    kernels and as the tokenizer would have it; there its normalizer has
    nothing left to do.  Other texts, and those with "<|" (special tokens are
    found before any lower-casing), go to the tokenizer whole.  The ids of
    words are kept (as bytes) in a young and an old half of bounded size:
    words that are met again move to the young one, the old one is forgotten
    in time.
    """

    ODD = r"[^\x00-\x{ff}]|<\|"
    END = r"([\pL\pN])([.,!?;:]+)([ \n\t\r]|$)"

    def __init__(self, path: str, most: int = 400_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            content = f.read()
        self.fast = may_split_words(content)
        self.whole, self.bare = Tokenizer.from_str(content), Tokenizer.from_str(content)
        self.bare.normalizer = None
        self.most, self.longest = most, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; none for nulls."""
        odd = pc.fill_null(pc.match_substring_regex(texts, self.ODD), True) if self.fast else pa.array(np.ones(len(texts), bool))
        out = [np.empty(0, "<u4")] * len(texts)
        for k in pc.indices_nonzero(odd).to_pylist():
            if texts[k].is_valid:
                out[k] = np.array(self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4")
        plain = pc.indices_nonzero(pc.invert(odd))
        if len(plain):
            own = pc.replace_substring_regex(pc.utf8_lower(texts.take(plain)), self.END, r"\1 \2\3")
            for blank in "\n\t\r":
                own = pc.replace_substring(own, blank, " ")
            split = pc.split_pattern(own, " ")
            words = split.flatten().dictionary_encode()
            pool = self._ids(words.dictionary.to_pylist())
            lengths = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
            starts, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(pool), "<u4")
            at = words.indices.to_numpy()
            each = lengths[at]
            ends = np.cumsum(each)
            ids = flat[np.repeat(starts[at] - (ends - each), each) + np.arange(ends[-1])]
            cuts = np.r_[0, ends][split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
            for k, begin, end in zip(plain.to_pylist(), cuts, cuts[1:]):
                out[k] = ids[begin:end]
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.young) > self.most // 2:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, words))
        new: list[int] = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            w = words[k]
            if w in self.old:
                self.young[w] = out[k] = self.old[w]
            else:
                new.append(k)
        single = [k for k in new if words[k].isalpha()]  # one piece of the pre-tokenizer each
        for some, pieces in ((single, True), ([k for k in new if not words[k].isalpha()], False)):
            for first in range(0, len(some), 20_000):
                ks = some[first : first + 20_000]
                own = [words[k] for k in ks]
                found = self.bare.encode(" ".join(own), add_special_tokens=False)
                ids = np.array(found.ids, "<u4").tobytes()
                if pieces:
                    at = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(own) + 1))
                else:
                    at = np.searchsorted(np.array([a for a, _ in found.offsets], np.int64), np.cumsum([0] + [len(w) + 1 for w in own]))
                at = (4 * at).tolist()
                for k, w, begin, end in zip(ks, own, at, at[1:]):
                    out[k] = ids[begin:end]
                    if len(w) <= self.longest:
                        self.young[w] = out[k]
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, whose words the next tasks find known."""
    return WordEncoder(path)


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, file_ids: int = 4 << 20, block: int = 1 << 16, kind: str = "byte", level: int = 3, order: tuple[str, ...] = ("doc_id",)
) -> None:
    """Encodes the texts of ``docs`` and writes the files of ids in ascending order of the ``order`` columns under ``path``.

    Null and empty texts give the end id alone.  Nulls come first in the
    order; rows that are equal in it follow one another, ordered by a hash of
    doc_id and text, by which they are also dealt to tasks.  A file is closed
    after the document that brings it to ``file_ids`` ids; a document of any
    length is encoded whole and stays in one file.  ``tokenizer`` is a path
    that every executor has.  An empty table gives no file of ids.  Other
    columns are not looked at.
    """
    end = np.array([end_id], "<u4")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        names: list[tuple[int | None, int]] = []
        kept: list[np.ndarray] = []
        total = 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(kept)
            return pa.RecordBatch.from_arrays([pa.array([pack(part, seq, names, ids, block, kind, level)[:-1]], pa.binary())], names=["file"])

        for some in slices(batches, 2048):
            for doc, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1))):
                kept += (ids, end)
                names.append((doc, len(ids) + 1))
                total += len(ids) + 1
                if total >= file_ids:
                    yield closed()
                    names, kept, total, seq = [], [], 0, seq + 1
        if names:
            yield closed()

    n = partitions_for(docs.sparkSession)
    keys = [F.col(f"k.k{i}") for i in range(len(order))] + [F.col("k.tie")]
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)), F.xxhash64("doc_id", "text").alias("tie"))
    dealt = docs.select("doc_id", "text", key.alias("k")).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    packed = dealt.select("doc_id", "text").mapInArrow(files, "file binary").select(F.col("file").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files of ids -> (doc_id, start, n_tokens, ids_crc32), a row for each document.

    ``start`` counts the ids of all documents before it: those of the
    partitions before, of the files before in its own partition and those
    before it in its own file.  Files are read once; what they hold of
    documents is stored before sums are taken, first within partitions and
    then over one row a partition, in groups of 1024.  No file gives an empty
    table.
    """
    rows = "part long, seq long, doc_id long, local long, n_tokens long, ids_crc32 long"
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                content = batch.column(0)[k].as_buffer().to_pybytes()
                names, sizes, ids = unpack(content)
                *_, part, seq = _foot(content)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(names)
                columns = [[part] * n, [seq] * n, names, starts, sizes, crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    found = stored(raw.mapInArrow(documents, rows), "token-rows")
    files = stored(found.groupBy("part", "seq").agg(F.sum("n_tokens").alias("total")), "token-files")
    parts = files.groupBy("part", F.expr("part div 1024").alias("some")).agg(F.sum("total").alias("total"))
    some = parts.groupBy("some").agg(F.sum("total").alias("total"))

    def before(*by: str, within: str | None = None):
        """The sum of total over the earlier rows, of the same group if one is named."""
        over = Window.partitionBy(within) if within else Window.partitionBy(F.lit(0))
        return F.coalesce(F.sum("total").over(over.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    far = some.select("some", before("some").alias("far"))
    middle = parts.select("part", "some", before("part", within="some").alias("middle")).join(far, "some")
    base = files.select("part", "seq", before("seq", within="part").alias("near")).join(middle, "part")
    base = base.select("part", "seq", (F.col("far") + F.col("middle") + F.col("near")).alias("base"))
    return found.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Files of ids -> (doc_id, ids), the ids as an array of longs."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names, sizes, ids = unpack(batch.column(0)[k].as_buffer().to_pybytes())
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), lists], names=["doc_id", "ids"])

    return raw.mapInArrow(documents, "doc_id long, ids array<long>")
