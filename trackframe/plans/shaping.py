"""Queries on sources, sinks, events and hits."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackframe.functions.shared import shared_path, stored
from trackframe.operators import hits as H
from trackframe.operators import results
from trackframe.plans.finding import ANCHORS, MEM
from trackframe.plans.registry import query
from trackframe.plans.scoring import GREEDY, MORE, PREFS, TURNS
from trackframe.sources import io


def _file(df, name, write=lambda df, path: df.write.parquet(path)):
    """The session and the path of a file that ``df`` was written to."""
    path = shared_path(df.sparkSession, name)
    write(df, path)
    return df.sparkSession, path


@query("SELECT det_id, sector, layer, CASE node_type WHEN 1 THEN 'PARA' WHEN 2 THEN 'SKEW' ELSE 'UNKNOWN' END AS kind, 1 AS weight, round(CASE WHEN dx = 0 AND dy = 0 THEN 1.0::DOUBLE WHEN atan2(dy, dx) > 0 THEN tan(pi() / 60) WHEN atan2(dy, dx) < 0 THEN -tan(pi() / 60) ELSE 1.0::DOUBLE END, 8) AS slope, coalesce(n, 0) AS n_near, coalesce(s, 0)::BIGINT AS sum_near FROM f_nodes LEFT JOIN (SELECT src, count(*) AS n, sum(dst) AS s FROM f_edges GROUP BY src) ON src = det_id", "f_nodes f_edges")
def load_nodes(v):
    """A node file with lists of neighbours is written and loaded."""
    near = v("f_edges").groupBy("src").agg(F.collect_list("dst").alias("neighbours"))
    raw = v("f_nodes").join(near, F.col("det_id") == F.col("src"), "left").drop("src")
    nodes, edges = io.load_nodes(*_file(raw, "nodes"))
    near = edges.groupBy(F.col("src").alias("det_id")).agg(F.count("*").alias("n"), F.sum("dst").alias("s"))
    return nodes.join(near, "det_id", "left").select("det_id", "sector", "layer", "kind", "weight", F.round("slope", 8).alias("slope"), F.coalesce("n", F.lit(0)).alias("n_near"), F.coalesce("s", F.lit(0)).alias("sum_near"))


@query("SELECT event_id, seq, det_id, CASE seq % 3 WHEN 0 THEN 'STT' WHEN 1 THEN 'MVD' ELSE 'UNKNOWN' END AS kind, round(isochrone, 6) AS isochrone FROM f_hits", "f_hits")
def load_hits(v):
    """A hit file with types 1, 2 and 3 is written and loaded."""
    raw = v("f_hits").withColumn("hit_type", 1 + F.col("seq") % 3)
    return io.load_hits(*_file(raw, "hits")).select("event_id", "seq", "det_id", "kind", F.round("isochrone", 6).alias("isochrone"))


@query("SELECT event_id, seq, det_id FROM f_hits WHERE event_id >= 10 AND event_id < 40", "f_hits")
def event_range(v):
    return H.event_range(v("f_hits"), 10, 40).select("event_id", "seq", "det_id")


@query("SELECT event_id, seq, det_id FROM f_hits WHERE event_id >= 10 AND event_id < 40", "f_hits")
def event_range_pruned(v):
    """As event_range, from a table in folders of ten events, of which three are read."""
    hits = v("f_hits").select("event_id", "seq", "det_id")
    path = shared_path(hits.sparkSession, "by-event")
    io.write_by_event(hits, path, 10)
    return io.read_by_event(hits.sparkSession, path, 10, 40, 10)


@query("SELECT src, dst FROM f_edges", "f_edges")
def neighbour_lines(v):
    near = v("f_edges").groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("ds"))
    lines = near.select(F.concat_ws(",", F.col("src").cast("string"), F.lit("0"), F.array_join(F.transform("ds", lambda d: d.cast("string")), ","), F.lit("0")).alias("value"))
    return io.load_neighbour_csv(*_file(lines, "lines", lambda df, path: df.write.text(path)))


@query("SELECT det_id, sector, layer, node_type, round(x, 6) AS x, round(y, 6) AS y, round(sqrt(x * x + y * y), 6) AS r, round(degrees(atan2(y, x)), 6) AS theta_deg, CASE WHEN node_type = 1 THEN 0.0::DOUBLE ELSE z END AS z_det, sector_limit FROM f_nodes", "f_nodes")
def derive_nodes(v):
    raw = v("f_nodes").withColumn("parallel", F.col("node_type") == 1)
    return io.derive_nodes(raw).select("det_id", "sector", "layer", "node_type", *(F.round(c, 6).alias(c) for c in ("x", "y", "r", "theta_deg")), "z_det", "sector_limit")


#: Hits name their truth point by its index, which counts an event's points from its last hit on.
JOINED = """SELECT h.event_id, h.seq, h.det_id, h.track_id, h.isochrone, h.hit_type, t.tx, t.ty, t.tz, n.x AS tube_x, n.y AS tube_y, n.z AS tube_z FROM (SELECT *, count(*) OVER (PARTITION BY event_id) - seq AS ref FROM f_hits) h
  JOIN (SELECT event_id, count(*) OVER (PARTITION BY event_id) - seq AS ref, tx, ty, tz FROM f_hits) t ON h.event_id = t.event_id AND h.ref = t.ref JOIN f_nodes n ON h.det_id = n.det_id"""


def _enriched(v):
    own = v("f_hits").withColumn("ref", F.count("*").over(Window.partitionBy("event_id")) - F.col("seq"))
    points = own.select("event_id", "ref", "tx", "ty", "tz", "px", "py", "pz")
    return io.enrich_hits(own.drop("tx", "ty", "tz", "px", "py", "pz"), points, v("f_nodes"))


ENRICHED = ("tube_x", "tube_y", "tube_r", "tube_theta_deg", "truth_x", "truth_y", "truth_r", "truth_theta_deg")


@query("SELECT event_id, seq, det_id, round(tube_x, 6) AS tube_x, round(tube_y, 6) AS tube_y, round(sqrt(tube_x ** 2 + tube_y ** 2), 6) AS tube_r, round(degrees(atan2(tube_y, tube_x)), 6) AS tube_theta_deg, round(tx, 6) AS truth_x, round(ty, 6) AS truth_y, round(sqrt(tx ** 2 + ty ** 2), 6) AS truth_r, round(degrees(atan2(ty, tx)), 6) AS truth_theta_deg FROM j", "f_hits f_nodes", {"j": JOINED})
def enrich_hits(v):
    found = _enriched(v).withColumnsRenamed({"tx": "truth_x", "ty": "truth_y"})
    return found.select("event_id", "seq", "det_id", *(F.round(c, 6).alias(c) for c in ENRICHED))


@query("SELECT event_id AS EvtNum, det_id AS detID, track_id AS trackID, hit_type AS type, round(tx, 6) AS x, round(ty, 6) AS y, round(tz, 6) AS z, round(tube_x, 6) AS mx, round(tube_y, 6) AS my, tube_z AS mz, round(sqrt(tx ** 2 + ty ** 2), 6) AS r, round(atan2(ty, tx), 6) AS theta, round(degrees(atan2(ty, tx)), 6) AS thetaDeg, round(sqrt(tube_x ** 2 + tube_y ** 2), 6) AS mr, round(atan2(tube_y, tube_x), 6) AS mtheta, round(degrees(atan2(tube_y, tube_x)), 6) AS mthetaDeg, round(isochrone, 6) AS isochrone FROM j", "f_hits f_nodes", {"j": JOINED})
def hits_csv(v):
    """The file of hits is written with its header and read back."""
    found = io.read_hits_csv(*_file(_enriched(v), "hits_csv", io.write_hits_csv)).drop("timeStamp")
    return found.select(*(c if kind in ("bigint", "string") else F.round(c, 6).alias(c) for c, kind in found.dtypes))


@query("SELECT event_id, seq, CASE WHEN k % 5 = 0 THEN -10000.0::DOUBLE ELSE round(tx, 6) END AS tx, CASE WHEN k % 5 = 0 THEN -10000.0::DOUBLE ELSE round(ty, 6) END AS ty FROM f_hits", "f_hits")
def noise_left_join(v):
    key = F.col("event_id") * 100000 + F.col("seq")
    points = v("f_hits").filter("k % 5 <> 0").select(key.alias("ref"), "tx", "ty")
    hits = v("f_hits").select("event_id", "seq", F.when(F.col("k") % 5 == 0, -1).otherwise(key).alias("ref"))
    return io.enrich_noise(hits, points).select("event_id", "seq", F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"))


@query("SELECT run, count(*) AS n_events, sum(trks)::BIGINT AS n_tracks, sum(hits)::BIGINT AS n_hits, round(sum(tottime), 6) AS seconds FROM f_timing GROUP BY run", "f_timing")
def load_timing(v):
    """A timing file for each run is written and loaded."""
    session, paths = None, {}
    for run in range(3):
        session, paths[run] = _file(v("f_timing").filter(F.col("run") == run).drop("run"), "timing", io.write_csv)
    found = io.load_timing(session, paths).withColumn("run", F.col("run").cast("long"))
    return found.groupBy("run").agg(F.count("*").alias("n_events"), F.sum("trks").alias("n_tracks"), F.sum("hits").alias("n_hits"), F.round(F.sum("tottime"), 6).alias("seconds"))


@query("SELECT evt, rank, f1 FROM f_scores", "f_scores")
def load_scores(v):
    return io.load_scores(*_file(v("f_scores"), "scores"), ["evt", "rank", "f1"])


MATCHES = """SELECT event_id, reco_id, track_id AS best FROM (SELECT *, row_number() OVER (PARTITION BY event_id, reco_id ORDER BY n DESC, track_id) AS o FROM (
  SELECT r.event_id, reco_id, track_id, count(*) AS n FROM f_reco r JOIN (SELECT DISTINCT event_id, track_id, det_id FROM f_hits) h ON r.event_id = h.event_id AND r.det_id = h.det_id GROUP BY ALL)) WHERE o = 1"""


@query("SELECT r.event_id, r.reco_id, coalesce(best, -1) AS best, r.det_id, round(x, 6) AS x, round(y, 6) AS y, round(sqrt(x * x + y * y), 6) AS r, round(degrees(atan2(y, x)), 6) AS theta_deg FROM f_reco r JOIN f_nodes n ON r.det_id = n.det_id LEFT JOIN best b ON r.event_id = b.event_id AND r.reco_id = b.reco_id", "f_hits f_reco f_nodes", {"best": MATCHES})
def component_table(v):
    from trackframe.operators.score import best_overlaps, overlaps

    best = best_overlaps(overlaps(v("f_reco"), v("f_hits")))
    found = io.component_table(v("f_reco"), best, v("f_nodes"))
    return found.select("event_id", "reco_id", "best", "det_id", *(F.round(c, 6).alias(c) for c in ("x", "y", "r", "theta_deg")))


@query("SELECT event_id, dense_rank() OVER (PARTITION BY event_id ORDER BY track_id) - 1 AS number, det_id FROM (SELECT *, count(*) OVER (PARTITION BY event_id, track_id) AS n FROM (SELECT DISTINCT event_id, track_id, det_id FROM f_hits)) WHERE n > 5", "f_hits")
def track_id_list(v):
    return io.track_id_list(v("f_hits"))


@query("SELECT event_id, reco_id, r.det_id, round(x, 6) AS x, round(y, 6) AS y, z, round(x, 6) AS cx, round(y, 6) AS cy, z AS cz FROM f_reco r JOIN f_nodes n ON r.det_id = n.det_id", "f_reco f_nodes")
def member_coords(v):
    found = io.member_coords(v("f_reco"), v("f_nodes"))
    return found.select("event_id", "reco_id", "det_id", *(F.round(c, 6).alias(c) for c in ("x", "y")), "z", *(F.round(c, 6).alias(c) for c in ("cx", "cy")), "cz")


@query("""SELECT event_id, '{"ID":' || event_id || ',"Trajectories":[' || string_agg(t, ',' ORDER BY track_id) || ']}' AS json FROM (SELECT event_id, track_id, '{"ID":' || track_id || ',"Hits":[' || string_agg(det_id, ',' ORDER BY seq) || ']}' AS t FROM f_hits GROUP BY event_id, track_id) GROUP BY event_id""", "f_hits")
def tracks_json(v):
    return io.tracks_json(v("f_hits"))


@query("""SELECT event_id, '{"ID":' || event_id || ',"Trajectories":[' || string_agg(t, ',' ORDER BY reco_id) || ']}' AS json FROM (SELECT event_id, reco_id, '{"ID":' || reco_id || ',"Hits":[' || string_agg(det_id, ',' ORDER BY pos) || ']}' AS t FROM f_reco GROUP BY event_id, reco_id) GROUP BY event_id""", "f_reco")
def components_json(v):
    return io.components_json(v("f_reco"), v("f_nodes"), "reco_id")


@query("SELECT det_id, sector, layer, round(x, 6) AS x, round(y, 6) AS y, coalesce(s, '') AS neighbours FROM f_nodes LEFT JOIN (SELECT src, string_agg(dst, ' ' ORDER BY dst) AS s FROM (SELECT DISTINCT src, dst FROM f_edges) GROUP BY src) ON det_id = src", "f_nodes f_edges")
def grid_dump(v):
    return io.grid_dump(v("f_nodes"), v("f_edges")).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("SELECT det_id, round(x, 6) AS x, round(y, 6) AS y, z, round(x, 6) AS x_det, round(y, 6) AS y_det, CASE WHEN node_type = 1 THEN 0.0::DOUBLE ELSE z END AS z_det FROM f_nodes WHERE det_id IN (SELECT det_id FROM f_hits)", "f_nodes f_hits")
def fired_nodes(v):
    found = io.fired_nodes(H.active_nodes(v("f_hits")), v("f_nodes"))
    return found.withColumns({c: F.round(c, 6) for c in ("x", "y", "x_det", "y_det")})


@query("SELECT event_id, seq, det_id, round(tx, 6) AS tx, round(ty, 6) AS ty, (sum(new) OVER (PARTITION BY event_id ORDER BY seq) - 1)::BIGINT AS run_id FROM (SELECT *, CASE WHEN lag(track_id) OVER (PARTITION BY event_id ORDER BY seq) IS DISTINCT FROM track_id THEN 1 ELSE 0 END AS new FROM f_hits)", "f_hits")
def event_points(v):
    return H.run_ids(v("f_hits"), ["event_id"]).select("event_id", "seq", "det_id", F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"), "run_id")


@query("SELECT det_id, round(sqrt(x * x + y * y), 6) AS r, round(atan2(y, x), 6) AS theta, round(degrees(atan2(y, x)), 6) AS theta_deg, round(CASE WHEN x = 0 THEN pi() / 2 WHEN y / x >= 0 THEN atan(y / x) ELSE pi() + atan(y / x) END, 6) AS folded FROM f_nodes", "f_nodes")
def polar(v):
    r, theta, degrees = H.to_polar(F.col("x"), F.col("y"))
    folded = H.to_polar(F.col("x"), F.col("y"), signed=False)[1]
    return v("f_nodes").select("det_id", F.round(r, 6).alias("r"), F.round(theta, 6).alias("theta"), F.round(degrees, 6).alias("theta_deg"), F.round(folded, 6).alias("folded"))


@query("SELECT event_id, seq, track_id AS raw_track_id FROM f_hits WHERE k % 7 <> 0", "f_hits")
def drop_excluded(v):
    raw = F.when(F.col("k") % 7 == 0, H.EXCLUDED).otherwise(F.col("track_id"))
    return H.drop_excluded(v("f_hits").select("event_id", "seq", raw.alias("raw_track_id")))


@query("SELECT event_id, count(*) AS n_hits, count(DISTINCT det_id) AS n_tubes, count(DISTINCT track_id) AS n_tracks FROM f_hits GROUP BY event_id", "f_hits")
def by_event(v):
    return H.by_event(v("f_hits"))


@query("SELECT event_id, seq, (dense_rank() OVER (ORDER BY event_id) - 1) // 4 AS batch_id FROM f_hits", "f_hits")
def event_mixing(v):
    return H.batch_events(v("f_hits").select("event_id", "seq"), 4)


@query("SELECT event_id, seq, batch_id, (sum(new) OVER (PARTITION BY batch_id ORDER BY event_id, seq) - 1)::BIGINT AS run_id FROM (SELECT *, (dense_rank() OVER (ORDER BY event_id) - 1) // 4 AS batch_id, CASE WHEN lag(track_id) OVER (PARTITION BY event_id ORDER BY seq) IS DISTINCT FROM track_id THEN 1 ELSE 0 END AS new FROM f_hits)", "f_hits")
def run_ids(v):
    mixed = H.batch_events(v("f_hits").select("event_id", "seq", "track_id"), 4)
    return H.run_ids(mixed, ["batch_id"]).select("event_id", "seq", "batch_id", "run_id")


@query("SELECT event_id, track_id, row_number() OVER (PARTITION BY event_id ORDER BY f) - 1 AS new_id FROM (SELECT event_id, track_id, min(seq) AS f FROM f_hits GROUP BY ALL)", "f_hits")
def first_seen_ids(v):
    return H.first_seen_ids(v("f_hits"))


@query("SELECT event_id, track_id, count(*) AS n, string_agg(det_id, ',' ORDER BY seq) AS det_ids, round(sum(isochrone), 6) AS isochrones, round(arg_min(tx, seq), 6) AS first_x, round(arg_min(px, seq), 6) AS first_px FROM f_hits GROUP BY event_id, track_id", "f_hits")
def truth_tracks(v):
    found = H.truth_tracks(v("f_hits"))
    return found.select(
        "event_id", "track_id", "n", F.array_join(F.transform("det_ids", lambda d: d.cast("string")), ",").alias("det_ids"),
        F.round(F.aggregate("isochrones", F.lit(0.0), lambda a, i: a + i), 6).alias("isochrones"),
        F.round(F.col("points")[0].tx, 6).alias("first_x"), F.round(F.col("momenta")[0].px, 6).alias("first_px"),
    )


@query("SELECT count(DISTINCT event_id) AS n_events, count(*) AS n_tracks, count(*) FILTER (n > 5) AS n_long, sum(n)::BIGINT AS n_hits FROM (SELECT event_id, track_id, count(*) AS n FROM f_hits WHERE event_id IN (SELECT event_id FROM f_hits GROUP BY event_id HAVING count(DISTINCT det_id) >= 5) GROUP BY ALL)", "f_hits")
def event_gate(v):
    return H.gate_summary(v("f_hits"))


@query("SELECT event_id, seq FROM f_hits WHERE event_id IN (SELECT DISTINCT event_id FROM f_hits ORDER BY event_id LIMIT 15000)", "f_hits")
def limit_events(v):
    return H.limit_events(v("f_hits"), 15000).select("event_id", "seq")


@query("SELECT DISTINCT event_id, det_id FROM f_hits WHERE hit_type = 1", "f_hits")
def active_nodes(v):
    return H.active_nodes(v("f_hits"), 1)


@query("SELECT event_id, track_id, n, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, track_id) AS place FROM (SELECT event_id, track_id, count(*) AS n FROM f_hits GROUP BY ALL)", "f_hits")
def tracks_by_length(v):
    return H.tracks_by_length(v("f_hits"))


@query("SELECT event_id, count(DISTINCT reco_id) AS n_components FROM f_reco GROUP BY event_id", "f_reco")
def components_per_event(v):
    return H.components_per_event(v("f_reco"), "reco_id")


@query("SELECT run, count(*) AS n_events, sum(trks)::BIGINT AS n_tracks, sum(hits)::BIGINT AS n_hits, round(sum(hits) / sum(tottime), 3) AS hits_per_s, round(sum(tottime) / count(*), 9) AS s_per_event FROM f_timing GROUP BY run", "f_timing")
def run_summary(v):
    return H.run_summary(v("f_timing")).withColumns({"hits_per_s": F.round("hits_per_s", 3), "s_per_event": F.round("s_per_event", 9)})


@query("SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM f_stream GROUP BY date_trunc('day', ts)", "f_stream")
def time_windows(v):
    return H.time_windows(v("f_stream")).withColumn("total", F.round("total", 4))


@query("SELECT 'MCDetID' AS name, count(*) AS n_rows FROM (SELECT *, count(*) OVER (PARTITION BY event_id, track_id) AS n FROM (SELECT DISTINCT event_id, track_id, det_id FROM f_hits)) WHERE n > 5 UNION ALL SELECT 'RecoDetID', count(*) FROM (SELECT *, count(*) OVER (PARTITION BY event_id, reco_id) AS n FROM f_reco) WHERE n > 5 UNION ALL SELECT 'ComponentPerEvt', count(DISTINCT event_id) FROM f_reco UNION ALL SELECT unnest(['ConnectedComponents', 'CoordCollected']), count(*) FROM f_reco UNION ALL SELECT unnest(['PerMCTrackError', 'PerTrackCurv']), count(DISTINCT event_id * 100 + track_id) FROM f_hits UNION ALL SELECT 'PerRecoTrackError', count(*) FROM (SELECT event_id, reco_id FROM f_reco GROUP BY ALL HAVING count(*) >= 5) SEMI JOIN (SELECT DISTINCT event_id, reco_id FROM f_reco NATURAL JOIN (SELECT DISTINCT event_id, det_id FROM f_hits)) USING (event_id, reco_id) UNION ALL SELECT 'GlobalEvtError', count(DISTINCT event_id) FROM (SELECT event_id FROM f_hits GROUP BY event_id, track_id HAVING count(DISTINCT det_id) > 5) UNION ALL SELECT 'CoordDiff', sum(overlap)::BIGINT FROM best UNION ALL SELECT 'Anchors', count(*) FROM anc", "f_hits f_reco f_nodes", MORE | {"turns": TURNS, "prefs": PREFS, "best": GREEDY, "mem": MEM, "anc": ANCHORS})
def write_tables(v):
    """All result tables are written by buckets of events and read back."""
    reco, hits, nodes = (stored(v(name), name) for name in ("f_reco", "f_hits", "f_nodes"))
    path = shared_path(reco.sparkSession, "results")
    tables = results.result_tables(reco, hits, nodes)
    io.write_tables(tables, path, bucket=100)
    counts = [reco.sparkSession.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name in tables]
    return functools.reduce(lambda a, b: a.unionByName(b), counts)
