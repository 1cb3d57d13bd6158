"""The toxicity classifier: n-grams against a plain count, held-out accuracy, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("trackframe.llm")
from trackframe.llm import queries, toxic_ngrams  # noqa: E402

S = toxic_ngrams.Settings()
DOC, LABEL = "doc_id long, text string", "doc_id long, quality int, toxic int"


def held(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def corpus(n=400):
    rng = random.Random(5)
    docs, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 80))]
        toxic = k % 6 == 0
        if toxic:
            for w in ("you", "blockhead", "dunce"):
                words.insert(rng.randrange(len(words)), w)
        docs.append((k, " ".join(words)))
        labels.append((k, None, int(toxic)))
    return docs, labels


@pytest.mark.parametrize("text", ["", "  \n", "a", "ab", "Abc  abc\tABC", "É" * 50, "x y " * 4000])
def test_ngrams_are_those_of_a_plain_count(text):
    own = " ".join(text.lower().split())
    plain = Counter(f" {own} "[k : k + n] for n in S.lengths for k in range(len(own) + 3 - n)) if own else Counter()
    for piece in (1 << 20, 7):
        at, n = toxic_ngrams.buckets(text, S, piece)
        assert sorted(n.tolist()) == sorted(plain.values())  # no two of these fall into one bucket
        assert len(set(at.tolist())) == len(at) and (np.diff(at) > 0).all()


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(labels, LABEL)
    found = {r.doc_id: r for r in toxic_ngrams.score(d, toxic_ngrams.fit(d, lab)).collect()}
    assert len(found) == len(docs)
    assert all(r.held_out == held(k) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for k, r in found.items())
    own = [(found[k].predicted, t) for k, _, t in labels if held(k)]
    assert sum(p == t for p, t in own) / len(own) > 0.97 and sum(t for _, t in own) > 5


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, DOC).repartition(3)
    turned = [(k, q, 1 - t if held(k) else t) for k, q, t in labels]
    score = lambda rows: {r.doc_id: round(r.score, 6) for r in toxic_ngrams.score(d, toxic_ngrams.fit(d, spark.createDataFrame(rows, LABEL))).collect()}
    assert score(labels) == score(turned)


def test_a_bounded_sample_weighs_as_much_as_its_class(spark):
    _, labels = corpus()
    rows = toxic_ngrams.training_rows(spark.createDataFrame(labels, LABEL), toxic_ngrams.Settings(rows=20)).collect()
    n = Counter(t for k, _, t in labels if not held(k))
    for y in (0, 1):
        own = [r.weight for r in rows if r.label == y]
        assert len(own) == 20 and math.isclose(sum(own), n[y])


def test_odd_rows_and_labels(spark):
    from pyspark.sql import functions as F

    docs, labels = corpus()
    docs += [(1, docs[1][1]), (1000, None), (1001, ""), (None, "blockhead dunce"), (None, None), (1002, "word " * 30_000), (1003, "퟿ é 日本")]
    labels += [(None, 1, 1), (2, 1, None), (6, 1, 0), (5000, 0, 1), (7, None, 3)]
    d, lab = spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(labels, LABEL)
    for n in ("label", "weight", "bucket", "score", "toxic", "held_out"):
        d = d.withColumn(n, F.lit(2))
    found = toxic_ngrams.score(d, toxic_ngrams.fit(d, lab.withColumn("label", F.lit(9)).withColumn("text", F.lit("a")))).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by[1000].score == by[1001].score
    assert [r.held_out for r in found if r.doc_id is None] == [False, False]


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0.0), ([(1, 0, 1), (2, 0, 1), (3, 0, 1)], 1.0), ([(k, 0, k % 2) for k in range(10_000, 10_100)], None)])
def test_without_both_classes(spark, labels, score):
    d = spark.createDataFrame([(1, "a b"), (2, None)], DOC)
    assert {r.score for r in toxic_ngrams.score(d, toxic_ngrams.fit(d, spark.createDataFrame(labels, LABEL))).collect()} == {score} or score is None
    none = spark.createDataFrame([], DOC)
    assert toxic_ngrams.score(none, toxic_ngrams.fit(none, spark.createDataFrame(labels, LABEL))).collect() == []


def test_the_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op12_toxicity(spark, sf).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in found]
    assert len(found) == 1000
    own = [(found[k].score, t) for k, t in labels if found[k].held_out]
    toxic, other = [s for s, t in own if t], [s for s, t in own if not t]
    above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in other) / (len(toxic) * len(other))
    assert above > 0.8 and sum(s >= 0.5 for s in other) <= 0.02 * len(other)
