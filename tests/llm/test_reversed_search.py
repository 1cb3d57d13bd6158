"""Reversed search against a plain version of its scores."""

import math
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("trackframe.llm")
from trackframe.llm import queries, reversed_search  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM, DOC = "item_id long, text string", "doc_id long, text string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, most=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i].update(terms(t))
    out = []
    for i, ts in wanted.items():
        scored = []
        for d, c in own:
            if d is None or not c:
                continue
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                scored.append((-score, d))
        out += [(i, k, d, -s) for k, (s, d) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_the_query_equals_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()]
    assert found(queries.op13_lexical_search(spark, sf)) == plain(read("documents", ("doc_id", "text")), read("benchmark", ("item_id", "text")))


def test_odd_rows_ties_and_shards(spark):
    from pyspark.sql import functions as F

    texts = [None, "", " .,- ", "Alpha beta", "alpha BETA", "alpha", "École école éCOLE", "x" * 5000, "alpha " * 3000, "a1 2b _c", "日本語 alpha", "gamma\x00delta", "delta\x85gamma"]
    docs = [(100 - k, t) for k, t in enumerate(texts)] + [(97, "Alpha beta"), (None, "alpha gamma"), (None, None)] + [(k, "beta common words") for k in range(30)]
    items = [(1, "Alpha beta"), (1, "gamma"), (2, None), (3, ""), (None, "école delta"), (4, "nothing of it"), (5, "common"), (5, "common"), (6, "x" * 5000 + " a1")]
    d, i = spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, ITEM)
    for n in ("item_id", "n", "terms", "term", "score", "rank", "part"):
        d = d.withColumn(n, F.lit(1))
    i = i.withColumn("doc_id", F.lit(1)).withColumn("term", F.lit("z"))
    want = plain(docs, items)
    assert found(reversed_search.rank(d, i)) == want
    assert found(reversed_search.rank(d, i, shard=20)) == want
    assert found(reversed_search.rank(d, i, most=3)) == plain(docs, items, 3)


def test_blocks_of_few_documents_give_the_same(spark, monkeypatch):
    docs = [(k, " ".join(f"t{(k * j) % 23}" for j in range(1, 12))) for k in range(80)]
    items = [(k, f"t{k} t{k + 3} t{2 * k % 23}") for k in range(20)]
    monkeypatch.setattr(reversed_search, "CELLS", 60)
    d = spark.createDataFrame(docs, DOC).repartition(2)
    assert found(reversed_search.rank(d, spark.createDataFrame(items, ITEM))) == plain(docs, items)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b")], DOC)
    assert found(reversed_search.rank(none, spark.createDataFrame([(1, "a")], ITEM))) == []
    assert found(reversed_search.rank(some, spark.createDataFrame([], ITEM))) == []


def test_long_texts_are_cut_between_terms():
    text = "ab cd, " * 1000
    assert [t.decode() for some in reversed_search.terms_in(text, 100) for t in some] == terms(text)
