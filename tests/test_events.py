"""Streamed events against the same hits as a table, and tables in folders of events."""

import datetime as dt

from pyspark.sql import functions as F

from trackframe.operators import reconstruct
from trackframe.sources import fixtures, io
from trackframe.streaming import events, windows


def tracks_of(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.event_id, r.track_id), []).append((r.pos, r.det_id))
    return {k: sorted(v) for k, v in out.items()}


def detector_and_hits(spark, n_events):
    sf = "/root/testdata/sf0.01"
    nodes = io.as_nodes(fixtures.f_nodes(spark, sf)).withColumn("slope", F.round("slope", 8))
    d = reconstruct.detector(nodes, fixtures.f_edges(spark, sf))
    return d, [(r.event_id, r.det_id) for r in fixtures.f_curved(spark, sf).filter(F.col("event_id") < n_events).select("event_id", "det_id").collect()]


def test_streamed_events_give_the_tracks_of_the_table(spark, tmp_path):
    """Hits of twelve events ten minutes apart, shuffled within files; one more hit of the first event comes hours late."""
    d, hits = detector_and_hits(spark, 12)
    start = dt.datetime(2024, 1, 1)
    rows = [(e, det, start + dt.timedelta(minutes=10 * e, seconds=(7 * k) % 50)) for k, (e, det) in enumerate(hits)]
    ddl = "event_id long, det_id long, ts timestamp"
    source = str(tmp_path / "hits")
    late = [(0, 5, start), (0, 6, start + dt.timedelta(seconds=1))]
    odd = [(None, 7, start), (3, None, start), (4, 8, None)]
    end = [(99, 1, start + dt.timedelta(days=1)), (99, 1, start + dt.timedelta(days=2))]
    for part in (rows[::2] + odd, rows[1::2], end[:1], late, end[1:]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(source)
    query = events.find_tracks(windows.signals(spark, source, ddl), d, str(tmp_path / "out"), str(tmp_path / "state"), late="3 hours")
    query.awaitTermination()
    found = tracks_of(spark.read.parquet(str(tmp_path / "out" / "tracks")).filter("event_id < 99"))
    active = spark.createDataFrame(sorted(set(hits)), "event_id long, det_id long")
    assert found == tracks_of(reconstruct.found_tracks(active, d)) and len({e for e, _ in found}) == 12
    assert [(r.event_id, r.late) for r in spark.read.parquet(str(tmp_path / "out" / "late")).collect()] == [(0, 2)]


def test_folders_of_events_are_pruned(spark, tmp_path):
    df = spark.range(0, 5000).select(F.col("id").alias("event_id"), (F.col("id") * 3).alias("v"))
    io.write_by_event(df, str(tmp_path / "t"), 100)
    found = io.read_by_event(spark, str(tmp_path / "t"), 250, 420, 100)
    assert [r.event_id for r in found.sort("event_id").collect()] == list(range(250, 420)) and found.columns == ["event_id", "v"]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_bucket" in plan
    assert len(found.inputFiles()) <= 50 and io.read_by_event(spark, str(tmp_path / "t"), events=100).count() == 5000
