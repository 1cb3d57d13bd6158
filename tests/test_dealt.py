"""What queries deal out over tasks and write, by the figures of their stages."""

import math
import uuid

from pyspark.sql import functions as F

from trackframe.operators import fits, graph, score
from trackframe.sources import io


def dealt(spark, f, what="shuffleWriteRecords"):
    """Rows that the stages of f write for shuffles (or another figure of theirs), the most first."""
    sc = spark.sparkContext
    group = uuid.uuid4().hex
    sc.setJobGroup(group, "")
    f()
    sc.setLocalProperty("spark.jobGroup.id", None)
    store = sc._jsc.sc().statusStore()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    rows = []
    for s in stages:
        try:
            rows.append(getattr(store.lastStageAttempt(s), what)())
        except Exception:  # skipped stages have no attempt
            pass
    return sorted(rows, reverse=True)


def fired_chain(spark, n=30, events=20):
    """A chain of n nodes, all of them fired in each event."""
    step = spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    edges = graph.symmetrise(step)
    active = spark.range(events).select(F.col("id").alias("event_id"), F.explode(F.sequence(F.lit(1), F.lit(n)).cast("array<bigint>")).alias("det_id"))
    return edges, active


def test_hops_deal_fired_nodes_not_what_they_lead_to(spark):
    edges, active = fired_chain(spark)
    assert dealt(spark, lambda: graph.active_k_hop(edges, active, 2).collect())[0] <= 600


def test_searches_over_gaps_and_on_from_them(spark):
    edges = graph.symmetrise(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 13)], "src long, dst long"))
    active = spark.createDataFrame([(0, 1), (0, 3), (0, 4), (1, 10), (1, 13), (2, 10)], "event_id long, det_id long")
    found = lambda depth: sorted(tuple(r) for r in graph.active_k_hop(edges, active, depth).collect())
    assert found(1) == [(0, 3, 4), (0, 4, 3)]
    # 1 finds itself and 3 beyond the gap; 10 only itself, as 12 did not fire.
    assert found(2) == [(0, 1, 1), (0, 1, 3), (0, 3, 3), (0, 3, 4), (0, 4, 3), (0, 4, 4), (1, 10, 10), (1, 13, 13), (2, 10, 10)]
    # From 1 the search goes on through itself and 3, from 10 and 13 through themselves alone.
    assert found(3) == [(0, 1, 1), (0, 1, 3), (0, 1, 4), (0, 3, 3), (0, 3, 4), (0, 4, 3), (0, 4, 4), (1, 10, 10), (1, 13, 13), (2, 10, 10)]


def test_two_hops_deal_fired_nodes_not_what_they_lead_to(spark):
    edges, active = fired_chain(spark)
    assert dealt(spark, lambda: graph.active_two_hop(edges, active).collect())[0] <= 600


def test_refits_write_no_draws(spark):
    at = [(0, t, k, 10 * math.cos(k), 10 * math.sin(k), 0.2) for t in range(20) for k in range(6)] + [(1, 0, k, float(k), 2.0 * k, 0.0) for k in range(4)]
    points = spark.createDataFrame(at, "event_id long, track_id long, k long, x double, y double, isochrone double")
    found = []
    run = lambda: found.extend(fits.isochrone_refit(points, ["event_id", "track_id"], 20).collect())
    assert dealt(spark, run, "outputRecords")[0] == 0
    # Points on a line that are not moved have no circle.
    assert sorted(r.track_id for r in found) == list(range(20)) and all(r.n == 6 and 9.4 < r.r16 <= r.r50 <= r.r84 < 10.6 for r in found)


def test_buckets_of_result_tables_are_one_file_each(spark, tmp_path):
    rows = spark.range(0, 400, 1, 8).select((F.col("id") % 20).alias("event_id"), F.col("id").alias("v"))
    io.write_tables({"t": rows}, str(tmp_path), bucket=5)
    assert [len(list(d.glob("part-*"))) for d in sorted((tmp_path / "t").glob("event_bucket=*"))] == [1] * 4
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.count("*"), F.sum("v")).first()[:] == (400, 79800)


def test_complex_tracks_deal_hits_not_what_is_beside_them(spark):
    edges, active = fired_chain(spark)
    hits = active.select("event_id", (F.col("det_id") % 10).alias("track_id"), F.col("det_id").alias("seq"), "det_id")
    for parity in (False, True):
        assert dealt(spark, lambda: score.complex_tracks(hits, edges, parity).collect())[0] <= 600
