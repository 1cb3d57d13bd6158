"""Substring dedup over sliding runs of sentences.

From every sentence the shortest run forwards, and to every sentence the
shortest run backwards, of at least so many sentences and words is hashed.
Equal runs meet in one shuffle; all but the first (by document, then by place)
are repeated, and the sentences that they cover are removed.  A run that
occurs several times among the rows of one batch is sent once: the others are
later than that one, so they are repeated whatever the rest of the corpus
holds.  What repeats within a batch is remembered for the later batches of the
task (in bounded memory), so a run that a third of the corpus shares gives
little more than a row a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.storage import fresh, row_hash

_BREAK = re.compile(r"(?<=[.!?…])[ \t\r]+|[ \t\r]*\n\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """The places (start, end) of a text's sentences: they end at .!?… before a blank, or with the line."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def runs(text: str, least: int, words: int) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentence after the last, 128-bit hash) of the shortest runs from and to each sentence."""
    parts = [text[a:b].lower().split() for a, b in sentences(text)]
    n = len(parts)
    hashes = [xxhash.xxh3_128_digest(" ".join(p)) for p in parts]
    total = np.r_[0, np.cumsum([len(p) for p in parts])] if n else np.zeros(1, np.int64)
    # The shortest run from i ends where both bounds hold; to j likewise.
    i = np.arange(n)
    ends = np.maximum(np.searchsorted(total, total[i] + words, "left"), i + least)
    j = np.arange(1, n + 1)
    begins = np.minimum(np.searchsorted(total, total[j] - words, "right") - 1, j - least)
    spans = {(a, b) for a, b in zip(i.tolist(), ends.tolist()) if b <= n}
    spans |= {(a, b) for a, b in zip(begins.tolist(), j.tolist()) if a >= 0}
    return [(a, b, xxhash.xxh3_128_digest(b"".join(hashes[a:b]))) for a, b in spans]


def repeated_runs(docs: DataFrame, least: int = 2, words: int = 4, most_known: int = 100_000) -> DataFrame:
    """documents -> (doc_id, row, first, after): the runs of sentences that occur at an earlier place too.

    ``row`` is a hash of id and text; repeated rows are one document.  Places
    are ordered by doc_id (nulls last), row and sentence.
    """
    name = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", row_hash(docs, ["doc_id", "text"]).alias("row"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}  # runs that repeat, with the smallest place sent
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            kind = batch.column(0).type
            best: dict[bytes, tuple[tuple, int]] = {}
            again: set[bytes] = set()
            at, first, after, digests = [], [], [], []
            for start in range(0, batch.num_rows, 512):
                for k, text in enumerate(batch.column(2).slice(start, 512).to_pylist(), start):
                    for a, b, digest in runs(text or "", least, words):
                        at.append(k)
                        first.append(a)
                        after.append(b)
                        digests.append(digest)
            later = np.zeros(len(at), bool)
            for n, digest in enumerate(digests):
                k = at[n]
                place = (ids[k] is None, ids[k] or 0, int(rows[k]), first[n])
                sent = known.get(digest)
                if sent is not None and place > sent:
                    later[n] = True
                    continue
                seen = best.get(digest)
                if seen is None:
                    best[digest] = (place, n)
                elif place == seen[0]:
                    pass  # a repeated row
                elif place > seen[0]:
                    later[n] = True
                    again.add(digest)
                else:
                    later[seen[1]] = True
                    best[digest] = (place, n)
                    again.add(digest)
            if len(known) > most_known:
                known.clear()
            known.update((digest, best[digest][0]) for digest in again)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).copy() if digests else np.empty((0, 2), np.int64)
            halves[later] = np.random.default_rng(len(at)).integers(-(1 << 62), 1 << 62, (int(later.sum()), 2))  # theirs is decided; they only spread
            taken = pa.array(at, pa.int64())
            columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(taken).cast(kind), batch.column(1).take(taken)]
            columns += [pa.array(first, pa.int32()), pa.array(after, pa.int32()), pa.array(later)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "g", "doc_id", "row", "first", "after", "later"])

    found = own.mapInArrow(hashed, f"h long, g long, doc_id {name}, row long, first int, after int, later boolean")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row", "first")
    least_place = F.min(place).over(Window.partitionBy("h", "g"))
    marked = found.withColumn("least", least_place).filter(F.col("later") | (place != F.col("least")))
    return marked.select("doc_id", "row", "first", "after")


def removals(docs: DataFrame, least: int = 2, words: int = 4) -> DataFrame:
    """documents -> (doc_id, row, runs): for each document with repeated runs, an array of (first, after)."""
    found = repeated_runs(docs, least, words)
    return found.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("first", "after"))).alias("runs"))


def cut(text: str | None, found: list[tuple[int, int]]) -> tuple[str | None, int, int, list[tuple[int, int]]]:
    """The text without the sentences of the runs; its sentences, those removed, and the places removed (code points)."""
    places = sentences(text or "")
    gone = np.zeros(len(places) + 1, np.int64)
    for a, b in found:
        gone[a] += 1
        gone[b] -= 1
    gone = np.cumsum(gone)[: len(places)] > 0
    if not gone.any():
        return text, len(places), 0, []
    out, removed, at, k = [], [], 0, 0
    while k < len(places):
        if gone[k]:
            last = k
            while last + 1 < len(places) and gone[last + 1]:
                last += 1
            # What separates the sentences goes with the one before it.
            end = places[last + 1][0] if last + 1 < len(places) else len(text)
            out.append(text[at : places[k][0]])
            removed.append((places[k][0], end))
            at, k = end, last + 1
        else:
            k += 1
    out.append(text[at:])
    return "".join(out), len(places), int(gone.sum()), removed


def deduplicate(docs: DataFrame, least: int = 2, words: int = 4) -> DataFrame:
    """documents -> (doc_id, n_sentences, n_removed, removed, text), a row for each row of ``docs``.

    A sentence is removed if a run that covers it, of at least ``least``
    sentences and ``words`` words, occurs at an earlier place in the corpus or
    the same text.  ``removed`` holds places (start, end) in code points,
    ``text`` what is left (null for null).  Texts with fewer sentences or
    words are left alone.  Repeated rows (same id and text) are one document
    and share its outcome; of equal texts under different ids that with the
    smallest id stays.  Null ids come last.  Texts of any length are taken
    whole.  Other columns are not looked at; no row gives an empty table.
    """
    found = removals(docs, least, words)
    own = docs.select("doc_id", row_hash(docs, ["doc_id", "text"]).alias("row"), "text")
    both = own.join(found.withColumnsRenamed({"doc_id": "_id", "row": "_row"}), (own.row == F.col("_row")) & own.doc_id.eqNullSafe(F.col("_id")), "left")

    @F.pandas_udf("struct<n_sentences: long, n_removed: long, removed: array<struct<start: long, end: long>>, text: string>")
    def parts(texts: pd.Series, taken: pd.Series) -> pd.DataFrame:
        rows = []
        for t, r in zip(texts, taken):
            left, n, m, places = cut(t, [] if r is None else [(x["first"], x["after"]) for x in r])
            rows.append((n, m, [{"start": a, "end": b} for a, b in places], left))
        return pd.DataFrame(rows, columns=["n_sentences", "n_removed", "removed", "text"])

    (p,) = fresh(docs, "_p")
    return both.select("doc_id", parts("text", "runs").alias(p)).select("doc_id", f"{p}.*")
