"""Shaping of events and hits: coordinates, grouping, numbering, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value of a truth field where there is no truth.
EXCLUDED = -10000


def to_polar(x: Column, y: Column, signed: bool = True) -> tuple[Column, Column, Column]:
    """r, angle and angle in degrees; without sign the angle is folded to [0, pi), a right angle where x is zero."""
    angle = F.atan2(y, x)
    if not signed:
        bent = F.atan2(F.abs(y), F.abs(x))
        folded = F.when((x > 0) == (y > 0), bent).otherwise(F.pi() - bent)
        angle = F.when(x == 0, F.pi() / 2).when(y == 0, F.lit(0.0)).otherwise(folded)
    return F.hypot(x, y), angle, F.degrees(angle)


def drop_excluded(hits: DataFrame, column: str = "raw_track_id") -> DataFrame:
    """Hits with truth."""
    return hits.filter(F.col(column) != EXCLUDED)


def by_event(hits: DataFrame) -> DataFrame:
    """(event_id, n_hits, n_tubes, n_tracks), for events with hits."""
    return hits.groupBy("event_id").agg(
        F.count("*").alias("n_hits"), F.countDistinct("det_id").alias("n_tubes"), F.countDistinct("track_id").alias("n_tracks")
    )


def batch_events(hits: DataFrame, n: int, span: int = 4096) -> DataFrame:
    """Hits with batch_id: every ``n`` events in the order of their ids are one.

    Events are ranked by their distinct ids, so the rank is over events, not
    hits: within spans of ids, and by the events of the spans before.  Those
    are one row a span.
    """
    events = hits.select("event_id", F.floor(F.col("event_id") / span).alias("span")).distinct()
    before = F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    earlier = events.groupBy("span").agg(F.count("*").alias("n")).select("span", F.coalesce(before, F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("span").orderBy("event_id")) - 1
    ranked = events.withColumn("inside", inside).join(earlier, "span")
    return hits.join(ranked.select("event_id", F.floor((F.col("earlier") + F.col("inside")) / n).alias("batch_id")), "event_id")


def run_ids(hits: DataFrame, by: list[str]) -> DataFrame:
    """Hits with run_id: a new one wherever the track differs from that of the hit before; counted on over ``by``."""
    in_event = Window.partitionBy("event_id").orderBy("seq")
    before = F.lag("track_id").over(in_event)
    new = F.when(before.isNull() | (before != F.col("track_id")), 1).otherwise(0)
    along = Window.partitionBy(*by).orderBy("event_id", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("new", new).withColumn("run_id", F.sum("new").over(along) - 1).drop("new")


def first_seen_ids(hits: DataFrame) -> DataFrame:
    """(event_id, track_id, new_id): tracks numbered from 0 by their first hit in the event."""
    first = hits.groupBy("event_id", "track_id").agg(F.min("seq").alias("first"))
    return first.select("event_id", "track_id", (F.row_number().over(Window.partitionBy("event_id").orderBy("first")) - 1).cast("long").alias("new_id"))


def truth_tracks(hits: DataFrame) -> DataFrame:
    """(event_id, track_id, n, det_ids, points, momenta, isochrones), the arrays in the order of the hits."""
    row = F.struct("seq", "det_id", F.struct("tx", "ty", "tz").alias("p"), F.struct("px", "py", "pz").alias("m"), "isochrone")
    rows = hits.groupBy("event_id", "track_id").agg(F.array_sort(F.collect_list(row)).alias("h"))
    return rows.select(
        "event_id", "track_id", F.size("h").cast("long").alias("n"),
        F.col("h.det_id").alias("det_ids"), F.col("h.p").alias("points"), F.col("h.m").alias("momenta"), F.col("h.isochrone").alias("isochrones"),
    )


def event_gate(hits: DataFrame, least: int = 5) -> DataFrame:
    """Events that fire at least so many distinct tubes."""
    return hits.groupBy("event_id").agg(F.countDistinct("det_id").alias("n_tubes")).filter(F.col("n_tubes") >= least)


def gate_summary(hits: DataFrame, least: int = 5, long: int = 5) -> DataFrame:
    """One row: events, tracks, tracks with more than ``long`` hits, and hits, after the gate."""
    kept = hits.join(event_gate(hits, least).select("event_id"), "event_id", "left_semi")
    tracks = kept.groupBy("event_id", "track_id").agg(F.count("*").alias("n"))
    return tracks.agg(
        F.countDistinct("event_id").alias("n_events"), F.count("*").alias("n_tracks"),
        F.count(F.when(F.col("n") > long, 1)).alias("n_long"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits"),
    )


def limit_events(hits: DataFrame, n: int) -> DataFrame:
    """Hits of the first ``n`` events; the ids are ranked once each."""
    first = hits.select("event_id").distinct().sort("event_id").limit(n)
    return hits.join(first, "event_id", "left_semi")


def event_range(hits: DataFrame, first: int, last: int) -> DataFrame:
    """Hits of events from ``first`` up to, but without, ``last``; all if both are negative."""
    return hits if first < 0 and last < 0 else hits.filter((F.col("event_id") >= first) & (F.col("event_id") < last))


def active_nodes(hits: DataFrame, kind: int | None = None) -> DataFrame:
    """(event_id, det_id): each fired node once, of one hit type if it is given."""
    return (hits if kind is None else hits.filter(F.col("hit_type") == kind)).select("event_id", "det_id").distinct()


def tracks_by_length(members: DataFrame, track: str = "track_id") -> DataFrame:
    """(event_id, track, n, place): the tracks of an event from the longest on, ids break ties."""
    n = members.groupBy("event_id", track).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("n"), track)).cast("long"))


def components_per_event(members: DataFrame, track: str) -> DataFrame:
    """(event_id, n_components)."""
    return members.groupBy("event_id").agg(F.countDistinct(track).alias("n_components"))


def run_summary(timing: DataFrame) -> DataFrame:
    """(run, n_events, n_tracks, n_hits, hits_per_s, s_per_event)."""
    return timing.groupBy("run").agg(
        F.count("*").alias("n_events"), F.sum("trks").alias("n_tracks"), F.sum("hits").alias("n_hits"),
        (F.sum("hits") / F.sum("tottime")).alias("hits_per_s"), (F.sum("tottime") / F.count("*")).alias("s_per_event"),
    )


def time_windows(signals: DataFrame, width: str = "1 day", start: str = "0 seconds") -> DataFrame:
    """(window_start, window_end, n, total) of tumbling windows of time."""
    w = F.window("ts", width, startTime=start)
    found = signals.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")
