"""The corpus pipeline and the registered queries on the smallest tables."""

import os
import re
from collections import Counter

import pytest

pytest.importorskip("trackframe.llm")
import corpus_pipeline  # noqa: E402
from trackframe.llm import mixing, queries  # noqa: E402
from trackframe.llm.storage import stored  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, columns = docs, docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        kept.append(docs)
        if name != "token_ids":
            assert docs.columns == columns
    quality, near, free, mixture, ids = kept
    texts = {r.doc_id: r.text for r in first.collect()}
    for r in quality.collect():
        assert set(r.text.split("\n")) <= set(texts[r.doc_id].split("\n")) and r.n_chars == len(r.text)
    from tests.llm.test_documents import slow_leaks
    from tests.llm.test_similar_shingles import slow_tops

    rows = quality.collect()
    least = {}
    for r, t in zip(rows, slow_tops([r.text for r in rows])):
        least[t] = min(r.doc_id, least.get(t, r.doc_id))
    assert sorted(r.doc_id for r in near.collect()) == sorted(least.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in near.collect()]
    bad = {d for d, _ in slow_leaks(items, rows)}
    assert sorted(r.doc_id for r in free.collect()) == sorted(d for d, _ in rows if d not in bad)
    uses = Counter(r.doc_id for r in mixture.collect())
    assert set(uses) == {r.doc_id for r in free.collect()} and max(uses.values()) <= 3
    assert Counter(r.doc_id for r in ids.collect()) == uses
    starts = sorted((r.start, r.n_tokens) for r in ids.collect())
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:k]) for k in range(len(starts))]
    laid = sorted((u.block, u.slot, u.doc_id) for u in mixing.arranged(mixture).collect())
    assert [r.doc_id for r in sorted(ids.collect(), key=lambda r: r.start)] == [d for _, _, d in laid]


def odd_rows():
    long = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    fine = "The river rose in the night, and by morning the bridge was gone. People stood on both banks and called across the water to each other."
    rows = [(None, fine, "en", None, 3), (1, None, None, "a", None), (2, "", "en", "a", 0), (3, fine, "en", "a", len(fine)), (3, fine, "en", "a", len(fine)), (4, long, "en", "b", None), (5, fine + " Then it rained.", None, None, 1)]
    return rows, "doc_id long, text string, lang string, source string, n_chars long"


def test_odd_rows_and_empty_tables(spark):
    from pyspark.sql import functions as F

    rows, schema = odd_rows()
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name in ("row", "block", "slot", "tokens", "m", "node", "key", "kept", "cleaned"):
            docs = docs.withColumn(name, F.lit(7))
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), name)
            if name != "token_ids":
                assert docs.columns == columns
        found = docs.collect()
        assert {r.doc_id for r in found} == ({3, 4} if data else set())
        assert sum(r.n_tokens for r in found) == max((r.start + r.n_tokens for r in found), default=0)


def test_names(spark):
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
