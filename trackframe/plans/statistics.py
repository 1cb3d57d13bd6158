"""Queries on score and timing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.operators import score, stats
from trackframe.plans.registry import query
from trackframe.plans.scoring import GIVEN, MORE, RESIDUALS, given
from trackframe.sources.fixtures import event_tasks

C = F.col


def rounded(df, names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("SELECT run_label, count(*) AS n, round(avg(length), 6) AS mean_length FROM (SELECT *, run AS run_label FROM f_scores) GROUP BY ALL", "f_scores")
def union_runs(v):
    every = stats.union_runs({k: v("f_scores").filter(C("run") == k) for k in (0, 1, 2)})
    return rounded(every.withColumn("run_label", C("run_label").cast("long")).groupBy("run_label").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length")), ["mean_length"])


@query("SELECT rank, count(*) AS n, round(quantile_cont(radius, 0.5), 4) AS median, round(quantile_cont(radius, 0.5) - quantile_cont(radius, 0.16), 4) AS low, round(quantile_cont(radius, 0.84) - quantile_cont(radius, 0.5), 4) AS high FROM f_scores GROUP BY rank", "f_scores")
def median_spread(v):
    return rounded(stats.median_spread(v("f_scores"), ["rank"], "radius"), ["median", "low", "high"], 4)


@query("SELECT rank, count(*) AS n, round(avg(radius), 4) AS mean, round(stddev_pop(radius), 4) AS std FROM f_scores GROUP BY rank", "f_scores")
def mean_std(v):
    return rounded(stats.mean_std(v("f_scores"), ["rank"], "radius"), ["mean", "std"], 4)


def _bin(x: str, low: float, high: float, bins: int) -> str:
    return f"least(floor(({x} - {low!r}::DOUBLE) / {(high - low) / bins!r}::DOUBLE)::BIGINT, {bins - 1})"


@query(f"SELECT {_bin('length', 0.0, 50.0, 20)} AS bin, count(*) AS n FROM f_scores WHERE length BETWEEN 0 AND 50 GROUP BY 1", "f_scores")
def histogram(v):
    return stats.histogram(v("f_scores"), "length", 0.0, 50.0, 20)


@query(f"SELECT {_bin('z', -25.0, 25.0, 10)} AS bin, count(*) AS n FROM (SELECT least(greatest(round(disz, 6), -25), 25) AS z FROM f_scores) GROUP BY 1", "f_scores")
def clipped_histogram(v):
    return stats.clipped_histogram(rounded(v("f_scores"), ["disz"]), "disz", -25.0, 25.0, 10)


@query(f"SELECT {_bin('length', 0.0, 50.0, 10)} AS bin_x, {_bin('radius', 30.0, 230.0, 8)} AS bin_y, count(*) AS n FROM f_scores WHERE length BETWEEN 0 AND 50 AND radius BETWEEN 30 AND 230 GROUP BY 1, 2", "f_scores")
def histogram2d(v):
    return stats.histogram2d(v("f_scores"), "length", "radius", (0.0, 50.0, 10), (30.0, 230.0, 8))


@query("SELECT least(hits, 150) // 10 AS bin, count(*) AS n, round(quantile_cont(tottime, 0.5), 9) AS median FROM f_timing GROUP BY 1", "f_timing")
def binned_median(v):
    return rounded(stats.binned_median(v("f_timing"), "hits", "tottime", 10.0, 150.0), ["median"], 9)


@query("SELECT least(hits, 150) // 10 AS bin, count(*) AS n, round(quantile_cont(hits / tottime, 0.5), 3) AS median FROM f_timing GROUP BY 1", "f_timing")
def binned_rate(v):
    return rounded(stats.binned_median(v("f_timing").withColumn("rate", C("hits") / C("tottime")), "hits", "rate", 10.0, 150.0), ["median"], 3)


@query("SELECT rank, count(*) AS n, round(avg((abs(z) < 5)::INT), 6) AS within_0, round(avg((abs(z) < 20)::INT), 6) AS within_1 FROM (SELECT rank, round(disz, 6) AS z FROM f_scores) GROUP BY rank", "f_scores")
def fraction_within(v):
    return rounded(stats.fraction_within(rounded(v("f_scores"), ["disz"]), ["rank"], "disz", [5.0, 20.0]), ["within_0", "within_1"])


@query("SELECT run, count(*) AS n, round(avg((f1 = 0)::INT), 6) AS none, round(avg((f1 = 1)::INT), 6) AS perfect, round(avg((f1 >= 0.67)::INT), 6) AS good FROM f_scores GROUP BY run", "f_scores")
def f1_fractions(v):
    return rounded(stats.f1_fractions(v("f_scores"), ["run"]), ["none", "perfect", "good"])


@query("SELECT run, count(*) AS n, count(*) FILTER (rank <= 4) AS found, count(*) FILTER (rank >= 5) AS ghosts_clones, round(avg((rank <= 4)::INT), 6) AS efficiency FROM f_scores GROUP BY run", "f_scores")
def rank_efficiency(v):
    return rounded(stats.rank_efficiency(v("f_scores"), ["run"]), ["efficiency"])


@query("SELECT rank, n, round(n / sum(n) FILTER (rank <= 4) OVER (), 6) AS of_found, round(n / 50124, 6) AS of_truth FROM (SELECT rank, count(*) AS n FROM f_scores GROUP BY rank)", "f_scores")
def rank_normalised(v):
    return rounded(stats.rank_normalised(v("f_scores"), 50124), ["of_found", "of_truth"])


@query("SELECT round(sum(f * m) / sum(f * f), 12) AS a, count(*) AS n FROM (SELECT hits * ln(hits) AS f, m FROM (SELECT hits, quantile_cont(tottime, 0.5) AS m, row_number() OVER (ORDER BY hits DESC) AS e FROM f_timing GROUP BY hits) WHERE e > 30)", "f_timing")
def nlogn_fit(v):
    medians = v("f_timing").groupBy("hits").agg(F.median("tottime").alias("m"))
    return rounded(stats.nlogn_fit(medians, "hits", "m", leave=30), ["a"], 12)


@query("""SELECT b AS bin, round(value, 9) AS value, value IS NULL AS empty, round(coalesce(value, pv + (nv - pv) * (b - pb) / (nb - pb), pv, nv), 9) AS filled FROM (
  SELECT *, last_value(value IGNORE NULLS) OVER (ORDER BY b) AS pv, last_value(hb IGNORE NULLS) OVER (ORDER BY b) AS pb, first_value(value IGNORE NULLS) OVER (ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv, first_value(hb IGNORE NULLS) OVER (ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nb FROM (
  SELECT range AS b, m AS value, h AS hb FROM range(0, 301) LEFT JOIN (SELECT hits AS h, quantile_cont(tottime, 0.5) AS m FROM f_timing GROUP BY hits HAVING count(*) % 3 <> 0) ON range = h))""", "f_timing")  # fmt: skip
def bin_gaps(v):
    medians = v("f_timing").groupBy(C("hits").alias("bin")).agg(F.median("tottime").alias("median"), F.count("*").alias("n")).filter("n % 3 <> 0")
    return rounded(stats.bin_gaps(medians, 0, 300), ["value", "filled"], 9)


@query("SELECT evt, line, length, f1 FROM f_scores WHERE radius > 0 AND length > 15 AND f1 >= 0.95", "f_scores")
def quality_mask(v):
    return stats.quality_mask(v("f_scores"), "radius").select("evt", "line", "length", "f1")


@query("SELECT evt, line, round(sqrt(px * px + py * py + pz * pz), 6) AS p, round(sqrt(px * px + py * py), 6) AS pt FROM f_scores", "f_scores")
def momentum(v):
    p, pt = stats.momentum(C("px"), C("py"), C("pz"))
    return v("f_scores").select("evt", "line", F.round(p, 6).alias("p"), F.round(pt, 6).alias("pt"))


@query("SELECT evt, line, round((0.006 * radius - pt) / pt, 6) AS residual FROM (SELECT *, sqrt(px * px + py * py) AS pt FROM f_scores)", "f_scores")
def relative_residual(v):
    return v("f_scores").select("evt", "line", F.round(stats.relative_residual(0.006 * C("radius"), F.hypot("px", "py")), 6).alias("residual"))


@query("SELECT r.event_id, r.track_id, det_id, dx, dy FROM res r JOIN given g ON r.event_id = g.event_id AND r.track_id = g.track_id JOIN sz s ON s.event_id = g.event_id AND s.track_id = g.track_id JOIN rsz q ON q.event_id = g.event_id AND q.reco_id = g.reco_id WHERE overlap = l AND overlap = rl", "f_hits f_reco f_nodes", MORE | {"given": GIVEN, "res": RESIDUALS})
def residuals_of_perfect(v):
    perfect = stats.perfect_matches(score.f1_scores(given(v), v("f_reco"), v("f_hits")))
    found = score.residuals(perfect, v("f_reco"), v("f_hits"), v("f_nodes"), event_tasks(v("lineitem")))
    return rounded(found, ["dx", "dy"], 5).select("event_id", "track_id", "det_id", "dx", "dy")


@query("SELECT n_tracks, count(*) AS n_events FROM (SELECT event_id, count(DISTINCT track_id) AS n_tracks FROM f_hits GROUP BY event_id) GROUP BY n_tracks", "f_hits")
def multiplicity(v):
    return stats.multiplicity(v("f_hits"))


@query("SELECT run, round(avg(tottime), 9) AS mean_time, round(avg(tottime) FILTER (hits > 200), 9) AS plateau_time, round(quantile_cont(hits / trks, 0.5), 6) AS hits_per_track, round(avg((hits < 50)::INT), 6) AS share_below FROM f_timing GROUP BY run", "f_timing")
def run_means(v):
    return rounded(rounded(stats.run_means(v("f_timing")), ["mean_time", "plateau_time"], 9), ["hits_per_track", "share_below"])


@query("SELECT rank, count(*) FILTER (run = 0) AS n_a, count(*) FILTER (run = 1) AS n_b, round(avg(f1) FILTER (run = 0), 6) AS mean_a, round(avg(f1) FILTER (run = 1), 6) AS mean_b, round(avg(f1) FILTER (run = 1) - avg(f1) FILTER (run = 0), 6) AS difference FROM f_scores WHERE run IN (0, 1) GROUP BY rank", "f_scores")
def compare_runs(v):
    return rounded(stats.compare_runs(v("f_scores"), 0, 1, "f1"), ["mean_a", "mean_b", "difference"])


@query("SELECT evt, line, round(disz, 6) AS disz FROM f_scores WHERE disz < 180", "f_scores")
def drop_z_sentinel(v):
    return rounded(stats.drop_z_sentinel(v("f_scores")).select("evt", "line", "disz"), ["disz"])
