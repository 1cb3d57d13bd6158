"""Temperature mixing of sources to target weights, in DataFrame operations alone.

Every source's share of tokens is raised to an exponent and normalised.  The
exponent is found by bisection into many sections at a time: the entropy of the weights must meet a target,
and no source may be repeated more often than a limit.  The weights are
realised on documents: each source is a sequence of permutations of its
documents (one an epoch), cut where its quota of tokens is reached and laid
over blocks of a token budget, so that every block holds the weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.storage import fresh, row_hash, salted_join, stored

#: Rows of a table of sources that may be broadcast.
MOST_SENT = 100_000


@dataclass(frozen=True)
class Mix:
    """``entropy`` is a share of that of equal weights; ``budget`` None: the least that uses every document."""

    entropy: float | None = 0.97
    repetitions: float | None = 4.0
    budget: int | None = None
    block_tokens: int = 1 << 18
    rounds: int = 5  # of the search for the exponent,
    sections: int = 32  # each of so many sections
    seed: int = 42
    digits: int = 3  # of the permutation's hash that name a bucket of prefix sums


def token_estimate(text: Column) -> Column:
    """Tokens of a text, by its UTF-8 bytes: one for each four, and at least one."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4)).cast("long")


def _source(column: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col(column).cast("string")), F.lit("none"))


def distinct_rows(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, source, row, mixed_source, tokens): equal rows (doc_id, text and source) are one document."""
    own = docs.select("doc_id", "source", row_hash(docs, ["doc_id", "text", "source"]).alias("row"), _source().alias("mixed_source"), token_estimate(F.col("text")).alias("tokens"))
    return own.dropDuplicates(["doc_id", "row"])


def _totals(rows: DataFrame) -> DataFrame:
    totals = stored(rows.groupBy("mixed_source").agg(F.sum("tokens").alias("tokens")), "totals")
    whole = totals.agg(F.sum("tokens")).first()[0] or 1
    return totals.select("mixed_source", "tokens", (F.col("tokens").cast("double") / F.lit(whole)).alias("share"))


def source_totals(docs: DataFrame) -> DataFrame:
    """documents -> (mixed_source, tokens, share), a row for each source; null is a source of its own, equal rows count once."""
    return _totals(distinct_rows(docs))


def states(totals: DataFrame, exponents: list[float], budget: int | None = None) -> dict[float, tuple[float, float]]:
    """For each exponent the entropy of the weights, and the most repetitions at the budget (None: the least that uses all documents).

    All exponents are summed up in one job; the sums are a row an exponent.
    """
    power = F.pow("share", F.col("a"))
    every = totals.select("share", "tokens", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    sums = every.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log(power)).alias("plog"), F.min(power / F.col("tokens")).alias("least"), F.max(power / F.col("tokens")).alias("most"))
    return {r.a: (math.log(r.z) - r.plog / r.z, r.most / r.least if budget is None else r.most / r.z * budget) for r in sums.collect()}


def exponent_for(totals: DataFrame, mix: Mix) -> float:
    """The exponent between 0 and 1 that meets the entropy target, or a larger one that keeps the repetition limit.

    Shares as they are (exponent 1) already spread enough, or repetitions that
    not even they keep, give 1.  Entropy and repetitions fall as the exponent
    grows, so a section search, of ``sections`` exponents a job, finds where
    either crosses its limit.
    """
    sources = totals.count()
    if not sources:
        return 1.0

    def crossing(low: float, high: float, before) -> tuple[float, float]:
        """The ends of the last section, where ``before`` holds at the lower and not at the higher one."""
        for _ in range(mix.rounds):
            points = [low + (high - low) * k / mix.sections for k in range(mix.sections + 1)]
            found = states(totals, points[1:-1], mix.budget)
            k = sum(before(found[p]) for p in points[1:-1])
            low, high = points[k], points[k + 1]
        return low, high

    ends = states(totals, [0.0, 1.0], mix.budget)
    flat = 1.0
    if mix.entropy is not None and sources > 1:
        target = mix.entropy * math.log(sources)
        if ends[1.0][0] < target:
            flat = crossing(0.0, 1.0, lambda s: s[0] >= target)[0]
    if mix.repetitions is None or flat >= 1.0 or states(totals, [flat], mix.budget)[flat][1] <= mix.repetitions:
        return flat
    return crossing(flat, 1.0, lambda s: s[1] > mix.repetitions)[1]


def _quotas(rows: DataFrame, mix: Mix) -> DataFrame:
    totals = _totals(rows)
    exponent = exponent_for(totals, mix)
    power = F.pow("share", F.lit(exponent))
    z = totals.agg(F.sum(power)).first()[0] or 1.0
    every = totals.select("mixed_source", "tokens", "share", F.lit(exponent).alias("exponent"), F.round(power / F.lit(z), 9).alias("weight"))
    budget = mix.budget
    if budget is None:
        budget = every.agg(F.ceil(F.max(F.col("tokens") / F.greatest(F.col("weight"), F.lit(1e-9))))).first()[0] or 0
    quota = F.floor(F.col("weight") * F.lit(budget))
    if mix.budget is None:
        quota = F.greatest(quota, F.col("tokens"))  # rounding must not cost a document
    return stored(
        every.select("mixed_source", "tokens", "share", "exponent", "weight", quota.cast("long").alias("quota"), F.greatest(F.lit(1), F.lit(math.ceil(budget / mix.block_tokens))).cast("long").alias("n_blocks")),
        "quotas",
    )


def quotas(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """documents -> (mixed_source, tokens, share, exponent, weight, quota, n_blocks).

    Equal rows count once.  Weights are rounded to nine places, quotas are
    whole tokens.
    """
    return _quotas(distinct_rows(docs), mix)


def _in_epoch(used: DataFrame, mix: Mix) -> DataFrame:
    """Uses (mixed_source, epoch, doc_id, row, tokens) -> with the tokens before them in their epoch's permutation.

    The permutation is the order of a hash.  Prefix sums are taken in two
    steps, within buckets of the hash and over the buckets, so that no task
    holds a whole source.
    """
    key = F.md5(F.concat_ws("|", F.lit(mix.seed), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    used = used.withColumn("key", key).withColumn("bucket", F.substring("key", 1, mix.digits))
    group = ["mixed_source", "epoch", "bucket"]
    sums = used.groupBy(*group).agg(F.sum("tokens").alias("in_bucket"))
    over = Window.partitionBy("mixed_source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*group, F.coalesce(F.sum("in_bucket").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*group).orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    return used.join(bases, group).withColumn("before", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))


def _block(before: Column, quota: Column, n_blocks: Column) -> Column:
    return F.least(F.floor(before.cast("double") / quota.cast("double") * n_blocks), n_blocks - 1).cast("long")


def blocks(docs: DataFrame, mix: Mix = Mix(), most_sent: int = MOST_SENT) -> DataFrame:
    """documents -> (doc_id, source, row, tokens, epoch, block): every use of a document in the mixture.

    Equal rows (doc_id, text and source) are one document, in totals and
    quotas too; null and empty texts have one token; a null source is one
    source; a text of any length is one document of one block, which it may
    overfill.  A source's documents are permuted anew in each epoch.  A source's
    quota is cut at the first document that starts beyond it.  The table of
    sources and epochs is broadcast up to ``most_sent`` rows; beyond, it is
    joined with hot sources salted.
    """
    rows = stored(distinct_rows(docs), "rows")
    shares = _quotas(rows, mix)
    epochs = shares.select(
        "mixed_source", F.col("tokens").alias("whole"), "quota", "n_blocks",
        F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr("(quota - 1) div tokens"))).alias("epochs"),
    )
    used = rows.join(F.broadcast(epochs), "mixed_source") if shares.count() <= most_sent else salted_join(rows, epochs, ["mixed_source"], ["row"])
    used = _in_epoch(used.withColumn("epoch", F.explode("epochs")).drop("epochs"), mix)
    used = used.withColumn("before", F.col("epoch") * F.col("whole") + F.col("before")).filter("before < quota")
    return used.select("doc_id", "source", "row", "tokens", "epoch", _block(F.col("before"), F.col("quota"), F.col("n_blocks")).alias("block"))


def arranged(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A mixed table -> (doc_id, source, row, tokens, epoch, block, slot), a row for each row of ``docs``.

    Rows that repeat are uses in epochs one after another, as ``blocks`` lays
    them: each source's uses are spread evenly over all blocks, so that every
    block holds the sources by their shares of the table.
    """
    rows = docs.groupBy("doc_id", "source", row_hash(docs, ["doc_id", "text", "source"]).alias("row"), _source().alias("mixed_source"), token_estimate(F.col("text")).alias("tokens"))
    used = stored(rows.agg(F.count("*").alias("n")).select("*", F.explode(F.expr("sequence(0L, n - 1)")).alias("epoch")).drop("n"), "uses")
    sums = stored(used.groupBy("mixed_source", "epoch").agg(F.sum("tokens").alias("own")), "epochs")
    of = Window.partitionBy("mixed_source")
    bases = sums.select(
        "mixed_source", "epoch", F.sum("own").over(of).alias("quota"),
        F.coalesce(F.sum("own").over(of.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
    )
    whole = sums.agg(F.sum("own")).first()[0] or 0
    n_blocks = F.lit(max(1, math.ceil(whole / mix.block_tokens))).cast("long")
    placed = _in_epoch(used, mix)
    placed = placed.join(F.broadcast(bases), ["mixed_source", "epoch"]) if sums.count() <= MOST_SENT else salted_join(stored(placed, "placed"), bases, ["mixed_source", "epoch"], ["row"])
    return _slots(placed.select("doc_id", "source", "row", "tokens", "epoch", _block(F.col("earlier") + F.col("before"), F.col("quota"), n_blocks).alias("block")), mix.seed)


def texts_in_order(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A mixed table -> (doc_id, text, block, slot), a row for each row of ``docs``."""
    places = arranged(docs, mix).select("row", _id_hash("doc_id"), "block", "slot")
    own = docs.select(row_hash(docs, ["doc_id", "text", "source"]).alias("row"), _id_hash("doc_id"), "doc_id", "text").dropDuplicates(["row", "id_hash"])
    return own.join(places, ["row", "id_hash"]).select("doc_id", "text", "block", "slot")


def _id_hash(column: str) -> Column:
    """A second hash beside that of the row, by which equal ones of different documents are told apart."""
    return F.xxhash64(F.lit(7), column).alias("id_hash")


def _slots(used: DataFrame, seed: int) -> DataFrame:
    """Uses with their slot: those of a block are permuted; a block has a bounded number of tokens."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("block"), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    slot = F.row_number().over(Window.partitionBy("block").orderBy("key", "doc_id", "epoch", "row"))
    return used.withColumn("key", key).withColumn("slot", (slot - 1).cast("long")).drop("key")


def order(used: DataFrame, seed: int = 42) -> DataFrame:
    """Uses as ``blocks`` gives them -> (doc_id, source, tokens, epoch, block, slot)."""
    return _slots(used, seed).select("doc_id", "source", "tokens", "epoch", "block", "slot")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture uses it; all columns stay, whatever their names.

    Equal rows are one document first.
    """
    uses, row, name, whole = fresh(docs, "_uses", "_row", "_name", "_whole")
    times = blocks(docs, mix).groupBy(F.col("row").alias(row), _id_hash("doc_id").alias(name)).agg(F.count("*").cast("int").alias(uses))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(whole), row_hash(docs, ["doc_id", "text", "source"]).alias(row), _id_hash("doc_id").alias(name))
    kept = own.dropDuplicates([row, name]).join(times, [row, name])
    return kept.select(whole, F.explode(F.sequence(F.lit(1), F.col(uses)))).select(f"{whole}.*")
