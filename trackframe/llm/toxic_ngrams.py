"""Toxicity by a linear classifier on character n-grams, whose features are scaled by naive Bayes log-count ratios.

N-grams of lower-cased text, white space as single blanks, fall into hashed
buckets; a document's feature is the logarithm of one more than a bucket's
count in it.  Over the labelled documents that train, Spark sums the features
of each class; a bucket's ratio is the logarithm of its share in the toxic
class over that in the other, and the buckets whose sums differ most between
the classes are kept.  A logistic regression (Spark
ML, over all training rows) is fitted on the kept features times their ratios.
All texts are then scored in one pass, with the weights in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trackframe.llm.storage import new_path, slices, stored


@dataclass(frozen=True)
class Settings:
    """``lengths`` of n-grams, 2**``bits`` buckets, ``kept`` of them, the most training rows of either class (``rows``), the ratios' smoothing and the fit's penalty."""

    lengths: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 20
    kept: int = 1 << 15
    rows: int = 10_000
    smoothing: float = 1.0
    penalty: float = 1e-3
    rounds: int = 60


@dataclass
class Model:
    """What every task needs: the place of a bucket among the kept ones (-1: none), their weights (ratios included) and the intercept."""

    place: np.ndarray
    weights: np.ndarray
    intercept: float


def buckets(text: str, s: Settings, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and how often each is met; none for a text without characters."""
    own = " ".join(text.lower().split())
    if not own:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letters = np.frombuffer(f" {own} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found, counts = [], []
    for start in range(0, len(letters), piece):
        some = letters[start : start + piece + max(s.lengths) - 1]
        h = np.zeros(len(some), np.uint64)
        parts = []
        for n in range(1, max(s.lengths) + 1):
            if n > len(some):
                break
            h = h[: len(some) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + some[n - 1 :] + np.uint64(1)
            if n in s.lengths:
                mixed = (h[:piece] ^ (h[:piece] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                parts.append((mixed >> np.uint64(64 - s.bits)).astype(np.int32))
        if parts:
            at, n = np.unique(np.concatenate(parts), return_counts=True)
            found.append(at)
            counts.append(n)
    if len(found) == 1:
        return found[0], counts[0]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, where = np.unique(np.concatenate(found), return_inverse=True)
    return at, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def features(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their values."""
    at, n = buckets(text or "", s)
    return at, np.log1p(n)


def training_rows(labels: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, label, weight): at most ``s.rows`` labelled documents of either class outside the held-out fifth, those of the smallest hashes.

    A class that is cut weighs as much as all its rows.  A doc_id with both
    labels counts as toxic; null ids and labels are none.
    """
    own = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label")).filter(~held_out(F.col("doc_id")))
    own = stored(own.filter("label IN (0, 1)"), "toxic-labels")
    sizes = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    parts = [own.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.rows).withColumn("weight", F.lit(max(1.0, n / s.rows))) for y, n in sizes.items()]
    if not parts:
        return own.withColumn("weight", F.lit(1.0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stored(out, "toxic-training")


def held_out(doc_id):
    """Whether a document only tests: crc32 of its id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """The model of documents (doc_id, text) and labels (doc_id, toxic).

    Bounded: at most ``s.rows`` training documents of either class, whose ids
    are sent to every task, so that no text is shuffled, ``2**s.bits`` sums
    and ``s.kept`` weights.  Repeated documents train each.  Without both
    classes, or without a text, every score is the share of toxic labels (0.5
    without labels).
    """
    spark = docs.sparkSession
    rows = training_rows(labels, s)
    sizes = {r["label"]: r["weight"] for r in rows.groupBy("label").agg(F.sum("weight").alias("weight")).collect()}
    if len(sizes) < 2:
        return Model(np.full(1 << s.bits, -1, np.int32), np.zeros(0), 0.0 if not sizes else np.inf if 1.0 in sizes else -np.inf)
    own = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "label", "weight")
    ddl = "bucket int, toxic double, other double"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << s.bits))
        for batch in slices(batches, 256):
            for text, label, weight in zip(*(c.to_pylist() for c in batch.columns)):
                at, value = features(text, s)
                total[int(label), at] += weight * value
        there = np.flatnonzero(total.any(axis=0)).astype(np.int32)
        for k in range(0, len(there), 50_000):
            at = there[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[1, at]), pa.array(total[0, at])], names=["bucket", "toxic", "other"])

    summed = stored(own.mapInArrow(sums, ddl).groupBy("bucket").agg(F.round(F.sum("toxic"), 6).alias("toxic"), F.round(F.sum("other"), 6).alias("other")), "ngram-sums")
    n, toxic, other = summed.agg(F.count("*"), F.sum("toxic"), F.sum("other")).first()
    if not n:  # no labelled document has a text
        return Model(np.full(1 << s.bits, -1, np.int32), np.zeros(0), float(np.log(sizes[1.0] / sizes[0.0])))
    ratio = F.log((F.col("toxic") + s.smoothing) / F.lit(toxic + s.smoothing * n)) - F.log((F.col("other") + s.smoothing) / F.lit(other + s.smoothing * n))
    # Buckets that tell the classes apart: the ratio times the root of what is there of them.
    gain = F.abs("ratio") * F.sqrt(F.col("toxic") / sizes[1.0] + F.col("other") / sizes[0.0])
    best = summed.withColumn("ratio", ratio).orderBy(F.round(gain, 9).desc(), "bucket").limit(s.kept).select("bucket", "ratio").collect()
    place, ratios = np.full(1 << s.bits, -1, np.int32), np.array([r.ratio for r in best])
    place[[r.bucket for r in best]] = np.arange(len(best))
    sent = spark.sparkContext.broadcast((place, ratios))
    sparse = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ratios = sent.value
        for batch in slices(batches, 256):
            out = []
            for text in batch.column(0).to_pylist():
                at, value = kept(text, place, s)
                out.append({"type": 0, "size": len(ratios), "indices": at, "values": value * ratios[at]})
            yield pa.RecordBatch.from_arrays([pa.array(out, sparse), batch.column(1), batch.column(2)], names=["features", "label", "weight"])

    path = new_path(spark, "toxic-features")
    own.mapInArrow(vectors, "features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>, label double, weight double").write.parquet(path)
    train = spark.read.schema(StructType([StructField("features", VectorUDT()), StructField("label", DoubleType()), StructField("weight", DoubleType())])).parquet(path)
    fitted = LogisticRegression(weightCol="weight", regParam=s.penalty, standardization=False, maxIter=s.rounds, tol=1e-7).fit(train)
    return Model(place, fitted.coefficients.toArray() * ratios, float(fitted.intercept))


def kept(text: str | None, place: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's kept buckets, ascending, and their values."""
    at, value = features(text, s)
    own = place[at]
    there = own >= 0
    order = np.argsort(own[there])
    return own[there][order], value[there][order]


def score(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """Documents -> (doc_id, held_out, score, predicted).

    Null and empty texts have no n-grams and get the intercept's score; texts
    of any length are scored whole.  Every row is scored by its text alone, so
    repeated ones are equal.  An empty table gives an empty one, and further
    columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, 512):
            sums = []
            for text in batch.column(1).to_pylist():
                at, value = kept(text, m.place, s) if len(m.weights) else ((), ())
                sums.append(m.intercept + float(np.dot(m.weights[at], value)) if len(at) else m.intercept)
            with np.errstate(over="ignore"):
                out = 1 / (1 + np.exp(-np.array(sums, float)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out)], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
