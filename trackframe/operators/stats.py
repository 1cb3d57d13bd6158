"""Statistics over score and timing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def finite(c: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def union_runs(runs: dict[int | str, DataFrame], label: str = "run_label") -> DataFrame:
    """Tables of several runs as one, with a label."""
    return reduce(DataFrame.unionByName, (df.withColumn(label, F.lit(name)) for name, df in runs.items()))


def median_spread(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, n, median, low, high): the median with the distances down to the 16th and up to the 84th percentile."""
    at = F.percentile(x, F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84)))
    found = df.filter(finite(C(x))).groupBy(*by).agg(F.count("*").alias("n"), at.alias("p"))
    return found.select(*by, "n", C("p")[1].alias("median"), (C("p")[1] - C("p")[0]).alias("low"), (C("p")[2] - C("p")[1]).alias("high"))


def mean_std(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, n, mean, std) of finite values, std over all of them."""
    return df.filter(finite(C(x))).groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """The number of a value's bin from 0; the last bin holds its upper edge, values outside have none."""
    at = F.floor((x - low) / F.lit((high - low) / bins)).cast("long")
    return F.when((x >= low) & (x <= high), F.least(at, F.lit(bins - 1).cast("long")))


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int, by: list[str] = ()) -> DataFrame:
    """(by, bin, n) of bins that hold something."""
    return df.withColumn("bin", bin_of(C(x), low, high, bins)).filter("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def clipped_histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """As histogram, values outside counted in the bins at the ends."""
    clipped = F.least(F.greatest(C(x), F.lit(low)), F.lit(high))
    return histogram(df.filter(finite(C(x))).withColumn(x, clipped), x, low, high, bins)


def histogram2d(df: DataFrame, x: str, y: str, edges_x: tuple, edges_y: tuple) -> DataFrame:
    """(bin_x, bin_y, n)."""
    both = df.withColumns({"bin_x": bin_of(C(x), *edges_x), "bin_y": bin_of(C(y), *edges_y)})
    return both.filter("bin_x IS NOT NULL AND bin_y IS NOT NULL").groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"))


def binned_median(df: DataFrame, x: str, y: str, width: float, last: float) -> DataFrame:
    """(bin, n, median): median of y by bins of x of one width; the last bin holds everything from ``last`` on."""
    at = F.floor(F.least(C(x), F.lit(last)) / F.lit(width)).cast("long")
    return df.filter(finite(C(y))).withColumn("bin", at).groupBy("bin").agg(F.count("*").alias("n"), F.median(y).alias("median"))


def fraction_within(df: DataFrame, by: list[str], x: str, limits: list[float]) -> DataFrame:
    """(by, n, within_<i>): share of finite values nearer to zero than each limit."""
    shares = (F.avg(F.when(F.abs(x) < t, 1.0).otherwise(0.0)).alias(f"within_{i}") for i, t in enumerate(limits))
    return df.filter(finite(C(x))).groupBy(*by).agg(F.count("*").alias("n"), *shares)


def share(condition: Column) -> Column:
    """Share of rows that fulfil a condition."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def f1_fractions(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, none, perfect, good): shares of tracks with an f1 of 0, of 1, and of at least 0.67."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), share(C("f1") == 0).alias("none"), share(C("f1") == 1).alias("perfect"), share(C("f1") >= 0.67).alias("good"))


def rank_efficiency(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, found, ghosts_clones, efficiency): ranks 1 to 4, ranks 5 and 6, and the share of the former."""
    count = lambda c: F.count(F.when(c, 1))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), count(C("rank") <= 4).alias("found"), count(C("rank") >= 5).alias("ghosts_clones"), share(C("rank") <= 4).alias("efficiency")
    )


def rank_normalised(df: DataFrame, truth: int) -> DataFrame:
    """(rank, n, of_found, of_truth): counts of ranks, by the number found (ranks 1 to 4) and by a fixed number of true tracks."""
    counts = df.groupBy("rank").agg(F.count("*").alias("n"))
    found = F.sum(F.when(C("rank") <= 4, C("n")).otherwise(0)).over(Window.partitionBy())
    return counts.select("rank", "n", (C("n") / found).alias("of_found"), (C("n") / F.lit(truth)).alias("of_truth"))


def nlogn_fit(medians: DataFrame, x: str, y: str, leave: int = 0) -> DataFrame:
    """(a, n): least squares of y = a x ln x through zero; the last ``leave`` points (by x) are left out."""
    order = Window.orderBy(F.desc(x))
    used = medians.withColumn("from_end", F.row_number().over(order)).filter(C("from_end") > leave) if leave else medians
    f = C(x) * F.log(C(x))
    return used.filter(C(x) > 0).agg((F.sum(f * C(y)) / F.sum(f * f)).alias("a"), F.count("*").alias("n"))


def bin_gaps(medians: DataFrame, first: int, last: int, y: str = "median") -> DataFrame:
    """(bin, value, empty, filled): every bin of a range; empty ones are filled on the line between the bins around them.

    The table has a row for each bin, of which there are few.
    """
    every = medians.sparkSession.range(first, last + 1).withColumnRenamed("id", "bin").join(medians.select("bin", C(y).alias("value")), "bin", "left")
    back = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    on = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    held = F.when(C("value").isNotNull(), F.struct("bin", "value"))
    around = every.withColumns({"before": F.last(held, True).over(back), "after": F.first(held, True).over(on)})
    gap = F.when(C("after.bin") > C("before.bin"), C("after.bin") - C("before.bin"))
    line = C("before.value") + (C("after.value") - C("before.value")) * (C("bin") - C("before.bin")) / gap
    return around.select("bin", "value", C("value").isNull().alias("empty"), F.coalesce("value", line, "before.value", "after.value").alias("filled"))


def quality_mask(df: DataFrame, x: str, longer: float = 15, f1: float = 0.95) -> DataFrame:
    """Rows with a finite positive value, a long track and a high f1."""
    return df.filter(finite(C(x)) & (C(x) > 0) & (C("length") > longer) & (C("f1") >= f1))


def momentum(px: Column, py: Column, pz: Column) -> tuple[Column, Column]:
    """Momentum and its transverse part."""
    return F.sqrt(px * px + py * py + pz * pz), F.hypot(px, py)


def relative_residual(found: Column, true: Column) -> Column:
    """(found - true) / true; null where the truth is zero."""
    return (found - true) / F.when(true != 0, true)


def perfect_matches(scores: DataFrame) -> DataFrame:
    """(event_id, track_id, reco_id): matches with an f1 of 1."""
    return scores.filter("f1 = 1").select("event_id", "track_id", F.col("match").alias("reco_id"))


def multiplicity(hits: DataFrame) -> DataFrame:
    """(n_tracks, n_events): how many events have so many tracks."""
    per = hits.groupBy("event_id").agg(F.countDistinct("track_id").alias("n_tracks"))
    return per.groupBy("n_tracks").agg(F.count("*").alias("n_events"))


def run_means(timing: DataFrame, plateau: int = 200, below: int = 50) -> DataFrame:
    """(run, mean_time, plateau_time, hits_per_track, share_below): means of each run, that of large events alone, median hits a track, share of small events."""
    return timing.groupBy("run").agg(
        F.avg("tottime").alias("mean_time"), F.avg(F.when(C("hits") > plateau, C("tottime"))).alias("plateau_time"),
        F.median(C("hits") / C("trks")).alias("hits_per_track"), share(C("hits") < below).alias("share_below"),
    )


def compare_runs(df: DataFrame, first, second, x: str) -> DataFrame:
    """(rank, n_a, mean_a, n_b, mean_b, difference) of two runs, side by side."""
    per = df.filter(C("run").isin(first, second)).groupBy("rank").agg(
        *(F.count(F.when(C("run") == r, 1)).alias(f"n_{k}") for k, r in (("a", first), ("b", second))),
        *(F.avg(F.when(C("run") == r, C(x))).alias(f"mean_{k}") for k, r in (("a", first), ("b", second))),
    )
    return per.withColumn("difference", C("mean_b") - C("mean_a"))


def drop_z_sentinel(df: DataFrame, z: str = "disz", below: float = 180) -> DataFrame:
    """Rows whose z residual is no sentinel."""
    return df.filter(C(z) < below)
