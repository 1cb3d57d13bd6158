"""Queries on track finding and on shapes of tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.functions.shared import stored
from trackframe.operators import finder, fits, graph, growing, hits, reconstruct, results, score, shape
from trackframe.plans.fitting import KM, MOMENTS, circle_sql
from trackframe.plans.graphs import PAIRS, closest_sql
from trackframe.plans.registry import query
from trackframe.sources.fixtures import event_tasks

C = F.col
SYM = "SELECT src, dst FROM f_edges UNION SELECT dst, src FROM f_edges"
ACT = "SELECT DISTINCT event_id, det_id FROM f_hits"
AE = "SELECT a.event_id, s.src, s.dst, n.layer AS src_layer, m.layer AS dst_layer FROM act a JOIN sym s ON a.det_id = s.src JOIN act b ON a.event_id = b.event_id AND b.det_id = s.dst JOIN f_nodes n ON n.det_id = s.src JOIN f_nodes m ON m.det_id = s.dst"
GRAPH = {"sym": SYM, "act": ACT, "ae": AE}
#: Members with their nodes; the found tracks of the fixture are the tracks.
MEM = "SELECT event_id, reco_id AS track_id, pos, r.det_id, layer, sector, node_type, layer_limit, x, y, z FROM f_reco r JOIN f_nodes n ON r.det_id = n.det_id"
ANCHORS = """SELECT event_id, track_id, row_number() OVER (PARTITION BY event_id, track_id ORDER BY run, pair) AS pos, layer, n, x, y, z FROM (
  SELECT event_id, track_id, run, pair, count(*) AS n, min(layer) AS layer, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM (
  SELECT *, (row_number() OVER (PARTITION BY event_id, track_id, run ORDER BY pos) - 1) // 2 AS pair FROM (
  SELECT *, sum(opens) OVER (PARTITION BY event_id, track_id ORDER BY pos) AS run FROM (
  SELECT *, CASE WHEN row_number() OVER w <= 2 OR lag(layer) OVER w <> layer THEN 1 ELSE 0 END AS opens FROM mem WINDOW w AS (PARTITION BY event_id, track_id ORDER BY pos)))) GROUP BY ALL)"""
VIEWS = "f_hits f_edges f_nodes f_reco"


def tracks(v):
    return v("f_reco").withColumnRenamed("reco_id", "track_id")


def active(v):
    return hits.active_nodes(v("f_hits"))


def tasks(v):
    return event_tasks(v("lineitem"))


def sym(v):
    return graph.symmetrise(v("f_edges"))


def active_edges(v):
    return graph.active_edges(sym(v), active(v), v("f_nodes"), tasks(v))


def rounded(df, names, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("SELECT event_id, src, 0 AS n_virtual, count(*) FILTER (dst_layer > src_layer) AS n_next, count(*) FILTER (dst_layer < src_layer) AS n_prev, count(*) FILTER (dst_layer = src_layer) AS n_same, bit_or(CASE WHEN dst_layer > src_layer THEN 4 WHEN dst_layer < src_layer THEN 1 ELSE 2 END) AS mask, bit_or(CASE WHEN dst_layer > src_layer THEN 4 WHEN dst_layer < src_layer THEN 1 ELSE 2 END) > 6 AS complex FROM ae GROUP BY event_id, src", VIEWS, GRAPH)
def classify_neighbours(v):
    return finder.classify_neighbours(active_edges(v), v("f_nodes"))


NEAR = "SELECT event_id, src AS of, dst AS det_id FROM ae"


@query("SELECT s.event_id, s.of, s.n, coalesce(p, 0) AS pairs, coalesce(p, 0) >= n - 1 AS adjacent FROM (SELECT event_id, of, count(*) AS n FROM near GROUP BY ALL) s LEFT JOIN (SELECT a.event_id, a.of, count(*) AS p FROM near a JOIN sym ON a.det_id = src JOIN near b ON b.event_id = a.event_id AND b.of = a.of AND b.det_id = dst WHERE a.det_id < b.det_id GROUP BY ALL) q ON s.event_id = q.event_id AND s.of = q.of", VIEWS, GRAPH | {"near": NEAR})
def all_adjacent(v):
    return finder.all_adjacent(active_edges(v).select("event_id", C("src").alias("of"), C("dst").alias("det_id")), sym(v), ["event_id", "of"])


@query("""SELECT event_id, of, det_id FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (fo) OVER w AS bad FROM (SELECT event_id, of, det_id, EXISTS (SELECT 1 FROM ae e WHERE e.event_id = m.event_id AND e.src = m.det_id AND e.src_layer = e.dst_layer AND NOT EXISTS (SELECT 1 FROM near o WHERE o.event_id = m.event_id AND o.of = m.of AND o.det_id = e.dst)) AS fo FROM near m)
  WINDOW w AS (PARTITION BY event_id, of)) WHERE NOT fo OR bad = n""", VIEWS, GRAPH | {"near": NEAR})  # fmt: skip
def prune_frontier(v):
    found = active_edges(v)
    sets = found.select("event_id", C("src").alias("of"), C("dst").alias("det_id"))
    return finder.prune_frontier(sets, found, v("f_nodes"), ["event_id", "of"])


#: Virtual nodes by their pairs, whose slopes are those of ``slope_class``.
VPAIRS = f"SELECT row_number() OVER (ORDER BY a, b) + (SELECT max(det_id) FROM f_nodes) AS virtual, a, b FROM ({PAIRS})"


@query("SELECT event_id, prev, virtual FROM (SELECT p.event_id, v.a AS prev, v.virtual, row_number() OVER (PARTITION BY p.event_id, v.a ORDER BY round(sqrt((m.x - n.x) ** 2 + (m.y - n.y) ** 2), 6), v.virtual) AS o FROM vp v JOIN act p ON p.det_id = v.a JOIN act q ON q.event_id = p.event_id AND q.det_id = v.b JOIN f_nodes m ON m.det_id = v.a JOIN f_nodes n ON n.det_id = v.b) WHERE o = 1", VIEWS, GRAPH | {"vp": VPAIRS})
def nearest_virtual(v):
    return finder.nearest_virtual(virtual_of(v), v("f_nodes"), active(v))


@query("SELECT event_id, reco_id AS track_id, det_id FROM (SELECT *, count(*) OVER (PARTITION BY event_id, reco_id) AS n FROM f_reco) WHERE n >= 9", "f_reco")
def drop_short(v):
    return finder.drop_short(tracks(v), v("f_nodes"), 9).select("event_id", "track_id", "det_id")


@query("SELECT event_id, track_id, CASE WHEN arg_min(layer_limit, pos) AND arg_max(layer_limit, pos) THEN 'FINISHED' ELSE 'ONGOING' END AS status FROM mem GROUP BY ALL", VIEWS, {"mem": MEM})
def track_status(v):
    return finder.track_summary(tracks(v), v("f_nodes")).select("event_id", "track_id", "status")


@query("SELECT event_id, track_id, count(*) AS length, arg_min(det_id, pos) AS tail, arg_max(det_id, pos) AS head, min(layer) AS min_layer, max(layer) AS max_layer FROM mem GROUP BY ALL", VIEWS, {"mem": MEM})
def track_summary(v):
    return finder.track_summary(tracks(v), v("f_nodes")).drop("status")


@query("SELECT event_id, track_id, pos, layer, n, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM anc", VIEWS, {"mem": MEM, "anc": ANCHORS})
def anchors(v):
    return rounded(finder.anchors(tracks(v), v("f_nodes"), tasks(v)), "xyz")


#: The members of a track in turn, with their tubes' ends.
TURN = "SELECT m.*, row_number() OVER (PARTITION BY event_id, track_id ORDER BY pos) AS i, n.x - n.half_length * n.dx AS x3, n.y - n.half_length * n.dy AS y3, n.z - n.half_length * n.dz AS z3, n.x + n.half_length * n.dx AS x4, n.y + n.half_length * n.dy AS y4, n.dy, n.dz FROM mem m JOIN f_nodes n USING (det_id)"
#: A fold over the members: the state holds the anchors so far, the last layer and the place in it.
FOLDED = """SELECT event_id, track_id, i, a FROM (WITH RECURSIVE f(event_id, track_id, i, layer, run, a) AS (
  SELECT DISTINCT event_id, track_id, 0::BIGINT, NULL::BIGINT, 0::BIGINT, []::STRUCT(layer BIGINT, n BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[] FROM turn
  UNION ALL SELECT event_id, track_id, i, layer, run, CASE WHEN opens OR run % 2 = 0 THEN list_append(a, {'layer': layer, 'n': 1::BIGINT, 'x': CASE WHEN on_ THEN ix ELSE x END, 'y': CASE WHEN on_ THEN iy ELSE y END, 'z': CASE WHEN on_ THEN coalesce(z3 + dz * (iy - y3) / nullif(dy, 0), z) ELSE z END})
      ELSE list_append(a[1:len(a) - 1], {'layer': layer, 'n': a[-1].n + 1, 'x': (a[-1].x + x) / 2, 'y': (a[-1].y + y) / 2, 'z': (a[-1].z + z) / 2}) END
    FROM (SELECT *, coalesce(movable AND sqrt((ix - x3) ** 2 + (iy - y3) ** 2) + sqrt((ix - x4) ** 2 + (iy - y4) ** 2) <= sqrt((x4 - x3) ** 2 + (y4 - y3) ** 2) + 1, false) AS on_ FROM (
    SELECT *, (c1 * (x3 - x4) - ux * c2) / nullif(k, 0) AS ix, (c1 * (y3 - y4) - uy * c2) / nullif(k, 0) AS iy FROM (
    SELECT *, ux * (y3 - y4) - uy * (x3 - x4) AS k, px * qy - py * qx AS c1, x3 * y4 - y3 * x4 AS c2 FROM (
    SELECT f.event_id, f.track_id, t.i, t.layer, f.a, t.x, t.y, t.z, t.x3, t.y3, t.z3, t.x4, t.y4, t.dy, t.dz, f.i < 2 OR f.layer <> t.layer AS opens, CASE WHEN f.i < 2 OR f.layer <> t.layer THEN 0 ELSE f.run + 1 END AS run,
      (f.i >= 2 AND f.layer <> t.layer AND t.node_type = 2 AND len(f.a) > 3) AS movable, a[-4].x AS px, a[-4].y AS py, a[-1].x AS qx, a[-1].y AS qy, a[-4].x - a[-1].x AS ux, a[-4].y - a[-1].y AS uy
    FROM f JOIN turn t ON t.event_id = f.event_id AND t.track_id = f.track_id AND t.i = f.i + 1))))) SELECT * FROM f) QUALIFY i = max(i) OVER (PARTITION BY event_id, track_id)"""


@query("SELECT event_id, track_id, k AS pos, p.layer AS layer, p.n AS n, round(p.x, 4) AS x, round(p.y, 4) AS y, round(p.z, 3) AS z FROM (SELECT event_id, track_id, unnest(a) AS p, generate_subscripts(a, 1) AS k FROM fold)", VIEWS, {"mem": MEM, "turn": TURN, "fold": FOLDED})
def anchors_in_turn(v):
    return rounded(rounded(finder.anchors_in_turn(tracks(v), v("f_nodes")), "xy"), "z", 3)


@query("""SELECT event_id, track_id, pos, det_id, round(theta, 4) AS theta FROM (WITH RECURSIVE f(event_id, track_id, i, pos, det_id, theta) AS (
  SELECT event_id, track_id, i, pos, det_id, degrees(atan2(y, x)) FROM turn WHERE i = 1 UNION ALL
  SELECT event_id, track_id, i, pos, det_id, CASE WHEN i > 2 AND before > 150 AND now_ < -150 THEN now_ + 360 WHEN i > 2 AND before < -150 AND now_ > 150 THEN now_ - 360 ELSE now_ END FROM (
    SELECT t.event_id, t.track_id, t.i, t.pos, t.det_id, degrees(atan2(t.y, t.x)) AS now_, f.theta AS before FROM f JOIN turn t ON t.event_id = f.event_id AND t.track_id = f.track_id AND t.i = f.i + 1)) SELECT * FROM f)""", VIEWS, {"mem": MEM, "turn": TURN})  # fmt: skip
def unwrap_in_turn(v):
    return rounded(finder.unwrapped_in_turn(tracks(v), v("f_nodes")), ["theta"])


#: Members between the means of the straight layers before and after, and where the line through these meets the tube.
LEVEL = "CASE WHEN s.at_ IS NOT NULL THEN {'l': s.layer, 'x': lx, 'y': ly} END"
ALONG = "OVER (PARTITION BY m.event_id, m.track_id ORDER BY pos ROWS BETWEEN"
BETWEEN = f"""SELECT m.*, n.x - n.half_length * n.dx AS x3, n.y - n.half_length * n.dy AS y3, n.z - n.half_length * n.dz AS z3, n.x + n.half_length * n.dx AS x4, n.y + n.half_length * n.dy AS y4, n.dy, n.dz,
  last_value({LEVEL} IGNORE NULLS) {ALONG} UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value({LEVEL} IGNORE NULLS) {ALONG} 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a
  FROM mem m JOIN f_nodes n ON n.det_id = m.det_id LEFT JOIN (SELECT event_id, track_id, layer, avg(x) AS lx, avg(y) AS ly, min(pos) AS at_ FROM mem WHERE node_type = 1 GROUP BY ALL) s ON s.event_id = m.event_id AND s.track_id = m.track_id AND s.at_ = m.pos"""
MET = """SELECT *, CASE WHEN k <> 0 THEN (c1 * vx - ux * c2) / k END AS ix, CASE WHEN k <> 0 THEN (c1 * vy - uy * c2) / k END AS iy FROM (SELECT *, ux * vy - uy * vx AS k, b.x * a.y - b.y * a.x AS c1, x3 * y4 - y3 * x4 AS c2 FROM (
  SELECT *, b.x - a.x AS ux, b.y - a.y AS uy, x3 - x4 AS vx, y3 - y4 AS vy, coalesce(node_type = 2 AND abs(b.l - a.l) >= 2, false) AS usable FROM btw))"""
MOVED = """SELECT event_id, track_id, pos, det_id, layer, CASE WHEN usable THEN px ELSE x END AS cx, CASE WHEN usable THEN py ELSE y END AS cy, CASE WHEN usable AND k <> 0 THEN z3 + dz * (py - y3) / nullif(dy, 0) ELSE 0 END AS cz FROM (
  SELECT *, CASE WHEN ix IS NULL THEN x WHEN on_ THEN ix WHEN first_ THEN x3 ELSE x4 END AS px, CASE WHEN ix IS NULL THEN y WHEN on_ THEN iy WHEN first_ THEN y3 ELSE y4 END AS py FROM (
  SELECT *, sqrt((ix - x3) ** 2 + (iy - y3) ** 2) + sqrt((ix - x4) ** 2 + (iy - y4) ** 2) <= sqrt((x4 - x3) ** 2 + (y4 - y3) ** 2) + 1 AS on_, sqrt((ix - x3) ** 2 + (iy - y3) ** 2) < sqrt((ix - x4) ** 2 + (iy - y4) ** 2) AS first_ FROM met))"""
SKEW = {"mem": MEM, "btw": BETWEEN, "met": MET, "moved": MOVED}


@query("SELECT event_id, track_id, pos, det_id, round(cx, 4) AS cx, round(cy, 4) AS cy, round(cz, 3) AS cz FROM moved", VIEWS, SKEW)
def correct_skew(v):
    return rounded(rounded(finder.correct_skew(tracks(v), v("f_nodes"), tasks(v)), ["cx", "cy"]), ["cz"], 3)


#: Members with the virtual nodes that neighbours in a track share, places of virtual nodes, and the fold over them.
WITH_SHARED = """SELECT event_id, track_id, row_number() OVER (PARTITION BY event_id, track_id ORDER BY place, det_id) AS pos, det_id FROM (SELECT event_id, track_id, 2 * pos AS place, det_id FROM mem
  UNION ALL SELECT m.event_id, m.track_id, 2 * m.pos - 1, v.virtual FROM (SELECT *, lag(det_id) OVER (PARTITION BY event_id, track_id ORDER BY pos) AS before FROM mem) m JOIN vp v ON v.a = least(before, det_id) AND v.b = greatest(before, det_id))"""
IN_TURN = """SELECT m.event_id, m.track_id, m.pos, m.det_id, g.* EXCLUDE (det_id), x - half_length * dx AS x3, y - half_length * dy AS y3, z - half_length * dz AS z3, x + half_length * dx AS x4, y + half_length * dy AS y4,
  row_number() OVER (PARTITION BY event_id, track_id ORDER BY pos) AS i FROM shared m JOIN grid g USING (det_id)"""
ISLANDS = """SELECT event_id, track_id, a FROM (WITH RECURSIVE f(event_id, track_id, i, p, a) AS (
  SELECT DISTINCT event_id, track_id, 0::BIGINT, 0::BIGINT, []::STRUCT(pos BIGINT, d BIGINT, l BIGINT, t BIGINT, w BIGINT, cx DOUBLE, cy DOUBLE, cz DOUBLE, x DOUBLE, y DOUBLE, x3 DOUBLE, y3 DOUBLE, z3 DOUBLE, x4 DOUBLE, y4 DOUBLE, dy DOUBLE, dz DOUBLE)[] FROM steps
  UNION ALL SELECT event_id, track_id, i, CASE WHEN t = 4 THEN p + 1 ELSE 0 END, list_append(list_transform(b, lambda e: {'pos': e.pos, 'd': e.d, 'l': e.l, 't': e.t, 'w': CASE WHEN e.how IN (1, 3) THEN 1 WHEN e.how = 2 THEN 0 ELSE e.w END,
      'cx': CASE e.how WHEN 3 THEN e.px WHEN 2 THEN e.x WHEN 4 THEN e.cx ELSE e.cx END, 'cy': CASE e.how WHEN 3 THEN e.py WHEN 2 THEN e.y ELSE e.cy END, 'cz': CASE e.how WHEN 3 THEN e.pz WHEN 2 THEN 0 ELSE e.cz END,
      'x': e.x, 'y': e.y, 'x3': e.x3, 'y3': e.y3, 'z3': e.z3, 'x4': e.x4, 'y4': e.y4, 'dy': e.dy, 'dz': e.dz}), own) FROM (
    -- How each node changes: 1 fixed, 2 back to its centre, 3 moved to (px, py, pz).
    SELECT *, list_transform(c, lambda e: {'pos': e.pos, 'd': e.d, 'l': e.l, 't': e.t, 'w': e.w, 'cx': e.cx, 'cy': e.cy, 'cz': e.cz, 'x': e.x, 'y': e.y, 'x3': e.x3, 'y3': e.y3, 'z3': e.z3, 'x4': e.x4, 'y4': e.y4, 'dy': e.dy, 'dz': e.dz, 'how': e.how,
      'px': CASE WHEN e.k = base + 1 THEN vx ELSE e.qx END, 'py': CASE WHEN e.k = base + 1 THEN vy ELSE e.qy END, 'pz': CASE WHEN e.k = base + 1 THEN vz WHEN e.ix IS NULL THEN 0 ELSE e.z3 + e.dz * (e.qy - e.y3) / nullif(e.dy, 0) END}) AS b FROM (
    SELECT *, list_transform(m, lambda e: {'pos': e.pos, 'd': e.d, 'l': e.l, 't': e.t, 'w': e.w, 'cx': e.cx, 'cy': e.cy, 'cz': e.cz, 'x': e.x, 'y': e.y, 'x3': e.x3, 'y3': e.y3, 'z3': e.z3, 'x4': e.x4, 'y4': e.y4, 'dy': e.dy, 'dz': e.dz, 'how': e.how, 'k': e.k, 'ix': e.ix,
      'qx': CASE WHEN e.ix IS NULL THEN e.x WHEN {on_} THEN e.ix WHEN {first_} THEN e.x3 ELSE e.x4 END, 'qy': CASE WHEN e.ix IS NULL THEN e.y WHEN {on_} THEN e.iy WHEN {first_} THEN e.y3 ELSE e.y4 END}) AS c FROM (
    SELECT *, list_transform(a, lambda e, k: {'pos': e.pos, 'd': e.d, 'l': e.l, 't': e.t, 'w': e.w, 'cx': e.cx, 'cy': e.cy, 'cz': e.cz, 'x': e.x, 'y': e.y, 'x3': e.x3, 'y3': e.y3, 'z3': e.z3, 'x4': e.x4, 'y4': e.y4, 'dy': e.dy, 'dz': e.dz, 'k': k,
      'how': CASE WHEN mode = 1 AND k > base THEN 1 WHEN mode = 2 AND k > j AND k <= base AND e.t <> 4 THEN 2 WHEN mode = 2 AND k = base + 1 THEN 3
        WHEN mode = 3 AND k > j AND k <= base AND e.t <> 4 AND len(list_filter(range(j + 1, k), lambda q: a[q].t <> 4 AND a[q].l = e.l)) < 3 THEN 3 ELSE 0 END,
      'ix': ((lx * vy - ly * vx) * (e.x3 - e.x4) - (lx - vx) * (e.x3 * e.y4 - e.y3 * e.x4)) / nullif((lx - vx) * (e.y3 - e.y4) - (ly - vy) * (e.x3 - e.x4), 0),
      'iy': ((lx * vy - ly * vx) * (e.y3 - e.y4) - (ly - vy) * (e.x3 * e.y4 - e.y3 * e.x4)) / nullif((lx - vx) * (e.y3 - e.y4) - (ly - vy) * (e.x3 - e.x4), 0)}) AS m FROM (
    SELECT *, CASE WHEN t = 4 OR p = 0 THEN 0 WHEN base = 0 OR a[base].t = 1 THEN 1 WHEN j IS NULL THEN 0 WHEN abs(a[j].l - a[base + 1].l) < 2 OR waiting > 6 THEN 2 ELSE 3 END AS mode FROM (
    SELECT *, list_avg(list_transform(fx, lambda q: a[q].cx)) AS lx, list_avg(list_transform(fx, lambda q: a[q].cy)) AS ly, len(list_filter(range(f0, base + 1), lambda q: a[q].t <> 4 AND a[q].w = 0)) AS waiting FROM (
    SELECT *, list_filter(range(f0, j + 1), lambda q: a[q].w = 1) AS fx FROM (
    SELECT *, coalesce(list_max(list_filter(range(1, j), lambda q: a[q].l <> a[j].l)), 0) + 1 AS f0 FROM (
    SELECT *, list_max(list_filter(range(1, base + 1), lambda q: a[q].w = 1)) AS j, list_avg(list_transform(vs, lambda e: e.cx)) AS vx, list_avg(list_transform(vs, lambda e: e.cy)) AS vy, list_avg(list_transform(vs, lambda e: e.cz)) AS vz FROM (
    SELECT *, a[base + 1 : base + least(p, 3)] AS vs FROM (
    SELECT f.event_id, f.track_id, s.i, f.p, f.a, len(f.a) - f.p AS base, s.node_type AS t, {'pos': s.pos, 'd': s.det_id, 'l': s.layer, 't': s.node_type, 'w': CASE WHEN s.node_type = 1 THEN 1 ELSE 0 END, 'cx': s.x, 'cy': s.y, 'cz': CASE WHEN s.node_type = 4 THEN s.z ELSE 0 END,
      'x': s.x, 'y': s.y, 'x3': s.x3, 'y3': s.y3, 'z3': s.z3, 'x4': s.x4, 'y4': s.y4, 'dy': s.dy, 'dz': s.dz} AS own
    FROM f JOIN steps s ON s.event_id = f.event_id AND s.track_id = f.track_id AND s.i = f.i + 1))))))))))) SELECT * FROM f) QUALIFY i = max(i) OVER (PARTITION BY event_id, track_id)"""
ISLANDS = ISLANDS.replace("{on_}", "sqrt((e.ix - e.x3) ** 2 + (e.iy - e.y3) ** 2) + sqrt((e.ix - e.x4) ** 2 + (e.iy - e.y4) ** 2) <= sqrt((e.x4 - e.x3) ** 2 + (e.y4 - e.y3) ** 2) + 1").replace("{first_}", "sqrt((e.ix - e.x3) ** 2 + (e.iy - e.y3) ** 2) < sqrt((e.ix - e.x4) ** 2 + (e.iy - e.y4) ** 2)")


CAND = "SELECT h.event_id, h.track_id, e.dst AS det_id FROM (SELECT event_id, track_id, arg_max(det_id, pos) AS head FROM mem GROUP BY ALL) h JOIN ae e ON e.event_id = h.event_id AND e.src = h.head WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.event_id = h.event_id AND m.track_id = h.track_id AND m.det_id = e.dst)"
LAST3 = """SELECT event_id, track_id, regr_slope(x, p) AS mx, regr_intercept(x, p) AS ix, regr_slope(y, p) AS my, regr_intercept(y, p) AS iy, max(p) AS pl, arg_max(x, pos) AS lx, arg_max(y, pos) AS ly, arg_max(layer, pos) AS l1, max(layer) FILTER (back = 3) AS l3 FROM (
  SELECT *, sum(step) OVER (PARTITION BY event_id, track_id ORDER BY pos) AS p FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM (SELECT *, row_number() OVER (PARTITION BY event_id, track_id ORDER BY pos DESC) AS back FROM anc) WHERE back <= 3 WINDOW w AS (PARTITION BY event_id, track_id ORDER BY pos))) GROUP BY ALL"""
NEXT = """SELECT event_id, track_id, det_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY event_id, track_id ORDER BY class, distance, det_id) AS o FROM (
  SELECT event_id, track_id, det_id, round(sqrt((nx - (ix + mx * pa)) ** 2 + (ny - (iy + my * pa)) ** 2), 5) AS distance, CASE WHEN l3 IS NULL OR abs(l1 - l3) <> 2 OR layer = l1 + (l1 - l3) / 2 THEN 0 WHEN layer = l1 THEN 1 END AS class FROM (
  SELECT c.*, f.* EXCLUDE (event_id, track_id), n.layer, n.x AS nx, n.y AS ny, pl + sqrt((n.x - lx) ** 2 + (n.y - ly) ** 2) AS pa FROM cand c JOIN last3 f ON c.event_id = f.event_id AND c.track_id = f.track_id JOIN f_nodes n ON n.det_id = c.det_id))
  WHERE class IS NOT NULL AND distance IS NOT NULL) WHERE o = 1 AND distance < 6"""
FIT = GRAPH | {"mem": MEM, "anc": ANCHORS, "cand": CAND, "last3": LAST3}


GRID = """SELECT det_id, layer, node_type, x, y, z, half_length, dx, dy, dz FROM f_nodes
  UNION ALL SELECT virtual, m_layer, 4, (px + qx) / 2, (py + qy) / 2, (pz + qz) / 2, NULL, NULL, NULL, NULL FROM met_pairs JOIN vp USING (a, b)"""


@query("SELECT event_id, track_id, n.pos AS pos, n.d AS det_id, round(n.cx, 4) AS cx, round(n.cy, 4) AS cy, round(n.cz, 3) AS cz, n.w = 1 AS fixed FROM (SELECT event_id, track_id, unnest(a) AS n FROM folds)", VIEWS, {
    "mem": MEM, "vp": VPAIRS, "met_pairs": closest_sql(PAIRS, 0.10), "grid": GRID, "shared": WITH_SHARED, "steps": IN_TURN, "folds": ISLANDS,
})
def correct_islands(v):
    """Skewed members between islands of virtual nodes, on the found tracks with the virtual nodes that their neighbours share."""
    virtual = virtual_of(v)
    found = finder.correct_islands(finder.with_shared_virtuals(tracks(v), virtual), graph.extend(v("f_nodes"), virtual))
    return rounded(rounded(found, ["cx", "cy"]), ["cz"], 3)


def chosen(v):
    return finder.fit_next(finder.anchors(tracks(v), v("f_nodes")), finder.head_candidates(tracks(v), active_edges(v)), v("f_nodes"))


@query(NEXT, VIEWS, FIT)
def fit_next(v):
    return chosen(v)


PROPOSED = """SELECT event_id, track_a, track_b, det_id, angle FROM (SELECT c.event_id, c.track_id AS track_a, e.track_id AS track_b, c.det_id, abs(round(atan2((l.x - e.x) * (e.ty - e.y) - (l.y - e.y) * (e.tx - e.x), (l.x - e.x) * (e.tx - e.x) + (l.y - e.y) * (e.ty - e.y)) * 180 / 3.14159265::DOUBLE, 3)) AS angle
  FROM nxt c JOIN (SELECT event_id, track_id, det_id, x, y, lead(x) OVER w AS tx, lead(y) OVER w AS ty, row_number() OVER w AS k, count(*) OVER (PARTITION BY event_id, track_id) AS n FROM mem WINDOW w AS (PARTITION BY event_id, track_id ORDER BY pos)
    UNION ALL SELECT event_id, track_id, det_id, x, y, lead(x) OVER w, lead(y) OVER w, row_number() OVER w, count(*) OVER (PARTITION BY event_id, track_id) FROM mem WINDOW w AS (PARTITION BY event_id, track_id ORDER BY pos DESC)) e
  ON e.event_id = c.event_id AND e.det_id = c.det_id AND e.k = 1 AND e.n > 1 AND e.track_id <> c.track_id JOIN (SELECT event_id, track_id, arg_max(x, pos) AS x, arg_max(y, pos) AS y FROM mem GROUP BY ALL) l ON l.event_id = c.event_id AND l.track_id = c.track_id) WHERE angle > 105"""


@query(PROPOSED, VIEWS, FIT | {"nxt": NEXT})
def propose_from_fit(v):
    return finder.propose_from_fit(chosen(v), tracks(v), v("f_nodes"))


OWNED = "SELECT event_id, det_id, min(track_id) AS track_id FROM mem GROUP BY ALL"
FREE = "SELECT * FROM act ANTI JOIN owned ON act.event_id = owned.event_id AND act.det_id = owned.det_id"


#: Rounds of absorbing: a free node has the track of its first neighbour among those that the last round reached.
ABSORBED = """SELECT r.event_id, r.det_id, r.track_id FROM (WITH RECURSIVE r(event_id, det_id, track_id) USING KEY (event_id, det_id) AS (SELECT event_id, det_id, track_id FROM owned UNION
  SELECT e.event_id, e.src, arg_min(r.track_id, e.dst) FROM r JOIN ae e ON e.event_id = r.event_id AND e.dst = r.det_id AND e.src_layer = e.dst_layer
  ANTI JOIN recurring.r k ON k.event_id = e.event_id AND k.det_id = e.src GROUP BY e.event_id, e.src) SELECT * FROM r) r SEMI JOIN free ON free.event_id = r.event_id AND free.det_id = r.det_id"""


def absorbed(v):
    """Members and fired nodes are laid out once; only free nodes ask for neighbours, and only for those of their layer."""
    members, fired = stored(tracks(v), "members"), stored(active(v), "fired")
    found = graph.active_edges(graph.same_layer(sym(v), v("f_nodes")), fired, v("f_nodes"), tasks(v), finder.free_nodes(members, fired))
    return finder.absorb_same_layer(members, fired, found, v("f_nodes"))


@query(ABSORBED, VIEWS, GRAPH | {"mem": MEM, "owned": OWNED, "free": FREE})
def absorb_same_layer(v):
    """Until no node is absorbed any more, as ``absorb_all``."""
    return absorbed(v)


@query(ABSORBED, VIEWS, GRAPH | {"mem": MEM, "owned": OWNED, "free": FREE})
def absorb_all(v):
    return absorbed(v)


def _reach(nodes: str, links: str) -> str:
    return f"SELECT event_id, det_id, min(r) AS component FROM (WITH RECURSIVE reach(event_id, det_id, r) AS (SELECT event_id, det_id, det_id FROM {nodes} UNION SELECT l.event_id, l.dst, reach.r FROM reach JOIN {links} l ON l.event_id = reach.event_id AND l.src = reach.det_id) SELECT * FROM reach) GROUP BY ALL"


@query("SELECT event_id, component, det_id FROM (SELECT *, count(*) OVER (PARTITION BY event_id, component) AS n FROM comp) WHERE n > 5", VIEWS, GRAPH | {
    "mem": MEM, "owned": OWNED, "free": FREE, "fl": "SELECT ae.event_id, src, dst FROM ae SEMI JOIN free a ON a.event_id = ae.event_id AND a.det_id = ae.src SEMI JOIN free b ON b.event_id = ae.event_id AND b.det_id = ae.dst", "comp": _reach("free", "fl"),
})
def leftover_components(v):
    return finder.leftover_components(tracks(v), active(v), active_edges(v))


POINTING = """SELECT event_id, track_id, e, det_id, other_id, sector, layer_limit, x, y, x - ox AS ux, y - oy AS uy FROM (
  SELECT *, 'tail' AS e, lead(x) OVER w AS ox, lead(y) OVER w AS oy, row_number() OVER w AS k, count(*) OVER t AS n, arg_max(det_id, pos) OVER t AS other_id, (arg_min(layer_limit, pos) OVER t AND arg_max(layer_limit, pos) OVER t) OR (min(layer) OVER t = 0 AND max(layer) OVER t > 21) AS closed FROM mem WINDOW w AS (PARTITION BY event_id, track_id ORDER BY pos), t AS (PARTITION BY event_id, track_id)
  UNION ALL SELECT *, 'head', lead(x) OVER w, lead(y) OVER w, row_number() OVER w, count(*) OVER t, arg_min(det_id, pos) OVER t, (arg_min(layer_limit, pos) OVER t AND arg_max(layer_limit, pos) OVER t) OR (min(layer) OVER t = 0 AND max(layer) OVER t > 21) FROM mem WINDOW w AS (PARTITION BY event_id, track_id ORDER BY pos DESC), t AS (PARTITION BY event_id, track_id)) WHERE k = 1 AND n > 1 AND NOT closed"""
#: Ends with fired neighbours outside their track, and ends that links of the fit have taken.
REMAIN = "SELECT DISTINCT h.event_id, h.track_id, h.e FROM (SELECT event_id, track_id, 'head' AS e, arg_max(det_id, pos) AS d FROM mem GROUP BY ALL UNION ALL SELECT event_id, track_id, 'tail', arg_min(det_id, pos) FROM mem GROUP BY ALL) h JOIN ae ON ae.event_id = h.event_id AND ae.src = h.d WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.event_id = h.event_id AND m.track_id = h.track_id AND m.det_id = ae.dst)"


def _ended(asks: str, free: str) -> str:
    return f"""SELECT event_id, track_a, end_a, track_b, end_b, angle FROM (SELECT *, row_number() OVER (PARTITION BY event_id, track_a, end_a ORDER BY place) AS choice FROM (
  SELECT *, abs(round(atan2(ax * -by_ - ay * -bx, ax * -bx + ay * -by_) * 180 / 3.14::DOUBLE, 3)) AS angle FROM (SELECT *, row_number() OVER (PARTITION BY event_id, track_a, end_a ORDER BY away, track_b) AS place FROM (
  SELECT a.event_id, a.track_id AS track_a, a.e AS end_a, b.track_id AS track_b, b.e AS end_b, a.ux AS ax, a.uy AS ay, b.ux AS bx, b.uy AS by_, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 5) AS away, {free} AS free
  FROM po a JOIN po b ON a.event_id = b.event_id AND a.track_id <> b.track_id AND CASE WHEN b.e = 'tail' THEN abs(a.det_id - b.det_id) < abs(a.det_id - b.other_id) ELSE abs(a.det_id - b.det_id) <= abs(a.det_id - b.other_id) END
    AND (abs(a.sector - b.sector) <= 1 OR (abs(a.sector - b.sector) = 5 AND a.e = 'head')) WHERE NOT a.layer_limit{asks}) WHERE away < 6) WHERE place <= 5 AND free) WHERE angle < 70) WHERE choice = 1"""


@query(_ended("", "true"), VIEWS, {"mem": MEM, "po": POINTING})
def propose_from_ends(v):
    return finder.propose_from_ends(tracks(v), v("f_nodes"))


#: Links of the fit, of which each track's head and the end that it meets are taken.
TAKEN = """SELECT f.event_id, f.track_a AS track_id, 'head' AS e FROM pf f UNION SELECT f.event_id, f.track_b, CASE WHEN t.d = f.det_id THEN 'tail' ELSE 'head' END FROM pf f JOIN (SELECT event_id, track_id, arg_min(det_id, pos) AS d FROM mem GROUP BY ALL) t ON t.event_id = f.event_id AND t.track_id = f.track_b"""
IN = "(SELECT 1 FROM {} x WHERE x.event_id = {}.event_id AND x.track_id = {}.track_id AND x.e = {}.e)"


@query(_ended(f" AND NOT EXISTS {IN.format('rem', 'a', 'a', 'a')} AND NOT EXISTS {IN.format('tk', 'a', 'a', 'a')}", f"NOT EXISTS {IN.format('tk', 'b', 'b', 'b')}"), VIEWS, FIT | {"mem": MEM, "po": POINTING, "rem": REMAIN, "nxt": NEXT, "pf": PROPOSED, "tk": TAKEN})
def propose_from_open_ends(v):
    """As the chain has it: ends that the fit's links have taken, or at which fired neighbours remain, do not ask."""
    members, fired, nodes = stored(tracks(v), "members"), stored(active(v), "fired"), v("f_nodes")
    found = stored(graph.active_edges(sym(v), fired, nodes, tasks(v), finder.end_nodes(members)), "from-ends")
    chosen = stored(finder.fit_next(finder.anchors(members, nodes, tasks(v)), finder.head_candidates(members, found), nodes), "chosen")
    linked = finder.propose_from_fit(chosen, members, nodes)
    tails = members.groupBy("event_id", C("track_id").alias("track_b")).agg(F.min_by("det_id", "pos").alias("tail"))
    linked = linked.join(tails, ["event_id", "track_b"]).select("event_id", "track_a", F.lit("head").alias("end_a"), "track_b", F.when(C("tail") == C("det_id"), "tail").otherwise("head").alias("end_b"))
    return finder.propose_from_ends(members, nodes, linked, finder.remaining_ends(members, found))


MERGED = "SELECT event_id, track_id, min(r) AS merged_id FROM (WITH RECURSIVE reach(event_id, track_id, r) AS (SELECT DISTINCT event_id, track_id, track_id FROM mem UNION SELECT l.event_id, l.b, reach.r FROM reach JOIN lk l ON l.event_id = reach.event_id AND l.a = reach.track_id) SELECT * FROM reach) GROUP BY ALL"
LINKED = {
    "mem": MEM, "sym": SYM, "en": "SELECT event_id, track_id, arg_max(det_id, pos) AS head, arg_min(det_id, pos) AS tail FROM mem GROUP BY ALL",
    "ab": "SELECT a.event_id, a.track_id AS a, b.track_id AS b FROM en a JOIN sym ON src = a.head JOIN en b ON b.event_id = a.event_id AND b.tail = dst AND b.track_id <> a.track_id",
    "one": "SELECT event_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY event_id, a ORDER BY b) AS p, row_number() OVER (PARTITION BY event_id, b ORDER BY a) AS q FROM ab) WHERE p = 1 AND q = 1",
    "lk": "SELECT event_id, a, b FROM one UNION SELECT event_id, b, a FROM one",
}


@query(MERGED, VIEWS, LINKED)
def merged_ids(v):
    return finder.merged_ids(tracks(v).select("event_id", "track_id").distinct(), head_tail_links(v))


def head_tail_links(v):
    """Heads next to tails of other tracks, each end's first partner, if both have each other."""
    ends = tracks(v).groupBy("event_id", "track_id").agg(F.max_by("det_id", "pos").alias("head"), F.min_by("det_id", "pos").alias("tail"))
    # Ends grow with the events; the planner would send them all through the driver where they take few bytes.
    a = ends.select("event_id", C("track_id").alias("track_a"), C("head").alias("src")).hint("merge")
    b = ends.select("event_id", C("track_id").alias("track_b"), C("tail").alias("dst")).hint("merge")
    met = a.join(sym(v), "src").join(b, ["event_id", "dst"]).filter("track_a <> track_b").select("event_id", "track_a", F.lit("head").alias("end_a"), "track_b", F.lit("tail").alias("end_b"))
    both = met.unionByName(met.select("event_id", C("track_b").alias("track_a"), C("end_b").alias("end_a"), C("track_a").alias("track_b"), C("end_a").alias("end_b")))
    return finder.mutual(both)


#: Chains walked from their first free end (a loop from its smallest track's tail), then their members in order, each node where it comes first.
WALK = """SELECT * FROM (WITH RECURSIVE w(event_id, merged_id, track_id, entered, step, first_) AS (
  SELECT event_id, merged_id, s.t, CASE WHEN s.h THEN 'head' ELSE 'tail' END, 0, s.t FROM (SELECT i.event_id, i.merged_id, min({'none': f.e IS NULL, 't': i.track_id, 'h': coalesce(f.e = 'head', false)}) AS s FROM mid i LEFT JOIN free_ends f ON f.event_id = i.event_id AND f.track_id = i.track_id GROUP BY ALL)
  UNION ALL SELECT w.event_id, merged_id, b, eb, step + 1, first_ FROM w JOIN ends_linked l ON l.event_id = w.event_id AND l.a = w.track_id AND l.ea <> w.entered WHERE b <> first_) SELECT * FROM w)"""
LAID = """SELECT event_id, merged_id AS track_id, row_number() OVER (PARTITION BY event_id, merged_id ORDER BY step, key) AS pos, det_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id, merged_id, det_id ORDER BY step, key) AS copy FROM (
  SELECT m.event_id, w.merged_id, m.det_id, step, CASE WHEN entered = 'head' THEN -pos ELSE pos END AS key FROM mem m JOIN walk w ON w.event_id = m.event_id AND w.track_id = m.track_id)) WHERE copy = 1"""


CHAINS = LINKED | {
    "mid": MERGED, "ends_linked": "SELECT event_id, a, 'head' AS ea, b, 'tail' AS eb FROM one UNION ALL SELECT event_id, b, 'tail', a, 'head' FROM one",
    "free_ends": "SELECT * FROM (SELECT event_id, track_id, 'head' AS e FROM en UNION ALL SELECT event_id, track_id, 'tail' FROM en) x ANTI JOIN ends_linked l ON l.event_id = x.event_id AND l.a = x.track_id AND l.ea = x.e", "walk": WALK,
}


@query(LAID, VIEWS, CHAINS)
def merge_tracks(v):
    return finder.merge_tracks(tracks(v), head_tail_links(v))


DOM = "SELECT a.event_id, a.track_id AS a, b.track_id AS b, sa.n AS na, sb.n AS nb, count(*) AS m FROM (SELECT DISTINCT event_id, track_id, det_id FROM mem) a JOIN (SELECT DISTINCT event_id, track_id, det_id FROM mem) b ON a.event_id = b.event_id AND a.det_id = b.det_id AND a.track_id <> b.track_id JOIN size sa ON sa.event_id = a.event_id AND sa.track_id = a.track_id JOIN size sb ON sb.event_id = b.event_id AND sb.track_id = b.track_id GROUP BY ALL"


@query("SELECT event_id, track_id, n FROM size s WHERE n >= 5 AND NOT EXISTS (SELECT 1 FROM dom d WHERE d.event_id = s.event_id AND d.a = s.track_id AND m > 0.66 * least(na, nb) AND nb >= 5 AND (nb > na OR (nb = na AND b < a)))", VIEWS, {"mem": MEM, "size": "SELECT event_id, track_id, count(DISTINCT det_id) AS n FROM mem GROUP BY ALL", "dom": DOM})
def dedupe_overlap(v):
    return score.without_overlapped(tracks(v))


#: Tracks in turn, the longest first; an event's state is the list of those that stay.
STAYING = """SELECT event_id, track_id FROM (WITH RECURSIVE g(event_id, i, kept, track_id, stays) AS (SELECT DISTINCT event_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT, false FROM turns UNION ALL
  SELECT event_id, i, CASE WHEN stays THEN list_append(kept, track_id) ELSE kept END, track_id, stays FROM (SELECT g.event_id, t.i, g.kept, t.track_id, NOT coalesce(list_has_any(g.kept, bs), false) AS stays
    FROM g JOIN turns t ON t.event_id = g.event_id AND t.i = g.i + 1 LEFT JOIN over_ o ON o.event_id = t.event_id AND o.a = t.track_id)) SELECT * FROM g) WHERE stays"""


STAY = {
    "mem": MEM, "size": "SELECT event_id, track_id, count(DISTINCT det_id) AS n FROM mem GROUP BY ALL", "dom": DOM, "turns": "SELECT event_id, track_id::BIGINT AS track_id, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, track_id) AS i FROM size",
    "over_": "SELECT event_id, a, list(b::BIGINT) AS bs FROM dom WHERE m > 0.66 * least(na, nb) AND (nb > na OR (nb = na AND b < a)) GROUP BY ALL",
}


@query(STAYING, VIEWS, STAY)
def dedupe_overlap_all(v):
    return finder.dedupe_overlap(tracks(v))


@query("SELECT event_id, track_id, length, row_number() OVER (PARTITION BY event_id ORDER BY track_id) - 1 AS number FROM (SELECT event_id, track_id, count(*) AS length FROM mem GROUP BY ALL) WHERE length >= 6", VIEWS, {"mem": MEM})
def valid_tracks(v):
    return finder.valid_tracks(finder.track_summary(tracks(v), v("f_nodes")), 6).select("event_id", "track_id", "length", "number")


#: Corrected members, their anchors and directions, the points with a height, and heights along the tracks.
COR = "SELECT event_id, track_id, pos, det_id, layer, cx AS x, cy AS y, cz AS z FROM moved"
WAY = "SELECT event_id, track_id, arg_min(layer, pos) <= arg_max(layer, pos) AS up FROM anc GROUP BY ALL"
PTS = """SELECT * FROM (SELECT event_id, track_id, pos, y, z, 0 AS kind FROM anc WHERE z <> 0 AND z BETWEEN -35 AND 105 UNION ALL SELECT event_id, track_id, pos, y, z, 1 FROM cor WHERE z <> 0 AND z <> 35 AND z BETWEEN -35 AND 105)
  QUALIFY (kind = 0) = (count(*) FILTER (kind = 0) OVER (PARTITION BY event_id, track_id) > 1)"""
ZP = """SELECT event_id, track_id, z, y, sum(step) OVER (PARTITION BY event_id, track_id ORDER BY o) AS p FROM (SELECT *, sqrt((z - coalesce(lag(z) OVER w, 0)) ** 2 + (y - coalesce(lag(y) OVER w, 0)) ** 2) AS step FROM (
  SELECT a.*, CASE WHEN up THEN pos ELSE -pos END AS o FROM pz a JOIN way ON way.event_id = a.event_id AND way.track_id = a.track_id) WINDOW w AS (PARTITION BY event_id, track_id ORDER BY o))"""
ZED = """SELECT o.event_id, o.track_id, det_id, round(CASE WHEN zf IS NOT NULL AND total > 0 THEN least(greatest(zf * d / total, -40), 110) ELSE z END, 3) AS z, round(scatter, 4) AS scatter FROM (
  SELECT *, max(d) OVER (PARTITION BY event_id, track_id) AS total FROM (SELECT *, sum(step) OVER (PARTITION BY event_id, track_id ORDER BY o) AS d FROM (SELECT *, sqrt((x - coalesce(lag(x) OVER w, 0)) ** 2 + (y - coalesce(lag(y) OVER w, 0)) ** 2) AS step FROM (SELECT m.*, CASE WHEN up THEN pos ELSE -pos END AS o FROM cor m JOIN way ON way.event_id = m.event_id AND way.track_id = m.track_id) WINDOW w AS (PARTITION BY event_id, track_id ORDER BY o)))) o
  LEFT JOIN (SELECT event_id, track_id, CASE WHEN iz + mz * pe > 110 THEN 105 ELSE iz + mz * pe END AS zf, atan(my / nullif(mz, 0)) AS scatter FROM (SELECT event_id, track_id, regr_slope(z, p) AS mz, regr_intercept(z, p) AS iz, regr_slope(y, p) AS my, max(p) AS pe FROM (
    SELECT event_id, track_id, p, z, y FROM zp UNION ALL SELECT DISTINCT event_id, track_id, 0, 0, 0 FROM zp) GROUP BY ALL)) f ON f.event_id = o.event_id AND f.track_id = o.track_id"""
HEIGHTS = SKEW | {"cor": COR, "anc": ANCHORS.replace("FROM mem", "FROM cor"), "way": WAY, "pz": PTS, "zp": ZP}


@query(ZED, VIEWS, HEIGHTS)
def reconstruct_z(v):
    return rounded(rounded(finder.reconstruct_z(tracks(v), v("f_nodes"), tasks(v)), ["z"], 3), ["scatter"])


#: The rules of ``growing``, each on the fixture's members, against SQL of their own or that of the joins and windows above.
@query(NEXT, VIEWS, FIT)
def grown_next(v):
    return growing.next_nodes(tracks(v), active(v), v("f_nodes"), sym(v))


#: The neighbours ahead of a node: all if they hang together, else those without a foreign node of the node's layer, if some are.
STEPS = """SELECT event_id, of, det_id FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (fo) OVER w AS bad, coalesce(pairs, 0) AS p FROM (
  SELECT m.event_id, m.src AS of, m.dst AS det_id, EXISTS (SELECT 1 FROM ae e WHERE e.event_id = m.event_id AND e.src = m.dst AND e.dst_layer = m.src_layer AND e.dst <> m.src) AS fo FROM ae m) x
  LEFT JOIN (SELECT a.event_id, a.src AS of, count(*) AS pairs FROM ae a JOIN sym s ON s.src = a.dst JOIN ae b ON b.event_id = a.event_id AND b.src = a.src AND b.dst = s.dst WHERE a.dst < b.dst GROUP BY ALL) q USING (event_id, of) WINDOW w AS (PARTITION BY event_id, of))
  WHERE n < 5 AND (p >= n - 1 OR (NOT fo AND bad BETWEEN 1 AND n - 1))"""


@query(STEPS, VIEWS, GRAPH)
def grown_step(v):
    return growing.frontier_steps(active(v), v("f_nodes"), sym(v))


#: By ascending id: free nodes that a chain of free same-layer neighbours of rising ids ties to an owned one; each has its first neighbour's track.
DRAWN = """SELECT event_id, det_id FROM (WITH RECURSIVE r(event_id, det_id) AS (SELECT f.event_id, f.det_id FROM free f JOIN same s ON s.event_id = f.event_id AND s.src = f.det_id SEMI JOIN owned o ON o.event_id = s.event_id AND o.det_id = s.dst
  UNION SELECT s.event_id, s.dst FROM r JOIN same s ON s.event_id = r.event_id AND s.src = r.det_id AND s.dst > s.src SEMI JOIN free f ON f.event_id = s.event_id AND f.det_id = s.dst) SELECT * FROM r)"""
FROM_WHOM = """SELECT d.event_id, d.det_id, min(s.dst) AS near FROM drawn d JOIN same s ON s.event_id = d.event_id AND s.src = d.det_id
  WHERE EXISTS (SELECT 1 FROM owned o WHERE o.event_id = s.event_id AND o.det_id = s.dst) OR (s.dst < s.src AND EXISTS (SELECT 1 FROM drawn x WHERE x.event_id = s.event_id AND x.det_id = s.dst)) GROUP BY ALL"""
GIVEN = """SELECT event_id, det_id, track_id FROM (WITH RECURSIVE g(event_id, det_id, track_id) AS (SELECT f.event_id, f.det_id, o.track_id FROM fw f JOIN owned o ON o.event_id = f.event_id AND o.det_id = f.near
  UNION ALL SELECT f.event_id, f.det_id, g.track_id FROM g JOIN fw f ON f.event_id = g.event_id AND f.near = g.det_id) SELECT * FROM g)"""
GATHER = GRAPH | {
    "mem": MEM, "owned": OWNED, "free": FREE, "same": "SELECT * FROM ae WHERE src_layer = dst_layer", "drawn": DRAWN, "fw": FROM_WHOM, "given": GIVEN, "rest": "SELECT * FROM free ANTI JOIN drawn USING (event_id, det_id)",
    "rl": "SELECT ae.event_id, src, dst FROM ae SEMI JOIN rest a ON a.event_id = ae.event_id AND a.det_id = ae.src SEMI JOIN rest b ON b.event_id = ae.event_id AND b.det_id = ae.dst", "comp": _reach("rest", "rl"),
    "large": "SELECT event_id, component, det_id FROM (SELECT *, count(*) OVER (PARTITION BY event_id, component) AS n FROM comp) WHERE n > 5",
}


def half(v):
    """Half of the tracks, so that much is left over, by ids that are no node's."""
    return tracks(v).filter("track_id % 2 = 0").withColumn("track_id", -1 - C("track_id"))


HALF = {"mem": f"SELECT * REPLACE (-1 - track_id AS track_id) FROM ({MEM}) WHERE track_id % 2 = 0"}


@query("SELECT event_id, track_id, det_id FROM given UNION ALL SELECT event_id, component, det_id FROM large UNION ALL SELECT event_id, track_id, det_id FROM mem", VIEWS, GATHER | HALF)
def grown_gather(v):
    return growing.gather(half(v), active(v), v("f_nodes"), sym(v)).select("event_id", "track_id", "det_id")


def virtual_of(v):
    from trackframe.plans.graphs import _nodes

    nodes = _nodes(v)
    return graph.virtual_nodes(nodes, graph.layer_pairs(nodes, v("f_edges")))


#: Components in the order of their ids; the virtual nodes that a run of one layer shares with fired nodes stand after it, each where it comes first, none after the last run.
WITH_VIRTUAL = """SELECT event_id, component AS track_id, row_number() OVER (PARTITION BY event_id, component ORDER BY run, kind, i, det_id) AS pos, det_id FROM (
  SELECT event_id, component, det_id, i, run, 0 AS kind FROM runs UNION ALL
  SELECT event_id, component, virtual, i, run, 1 FROM (SELECT r.event_id, r.component, w.virtual, r.i, r.run, r.runs, row_number() OVER (PARTITION BY r.event_id, r.component, w.virtual ORDER BY r.i) AS o
    FROM runs r JOIN (SELECT a AS det_id, b AS other, virtual FROM vp UNION ALL SELECT b, a, virtual FROM vp) w ON w.det_id = r.det_id SEMI JOIN act f ON f.event_id = r.event_id AND f.det_id = w.other) WHERE o = 1 AND run < runs)"""
RUNS = """SELECT *, max(run) OVER (PARTITION BY event_id, component) AS runs FROM (SELECT *, sum(turn) OVER (PARTITION BY event_id, component ORDER BY i) AS run FROM (
  SELECT *, CASE WHEN layer = lag(layer) OVER w THEN 0 ELSE 1 END AS turn, row_number() OVER w AS i FROM large JOIN (SELECT det_id, layer FROM f_nodes) USING (det_id) WINDOW w AS (PARTITION BY event_id, component ORDER BY det_id)))"""


@query("""SELECT event_id, src, coalesce(nv, 0) AS n_virtual, n_next, n_prev, n_same, mask, mask > 6 AS complex FROM (SELECT event_id, src, count(*) FILTER (dst_layer > src_layer) AS n_next, count(*) FILTER (dst_layer < src_layer) AS n_prev, count(*) FILTER (dst_layer = src_layer) AS n_same,
  bit_or(CASE WHEN dst_layer > src_layer THEN 4 WHEN dst_layer < src_layer THEN 1 ELSE 2 END) AS mask FROM ae GROUP BY ALL)
  LEFT JOIN (SELECT a.event_id, w.a AS src, count(*) AS nv FROM (SELECT a, b FROM vp UNION ALL SELECT b, a FROM vp) w JOIN act a ON a.det_id = w.a SEMI JOIN act o ON o.event_id = a.event_id AND o.det_id = w.b GROUP BY ALL) USING (event_id, src)""", VIEWS, GRAPH | {"vp": VPAIRS})  # fmt: skip
def classify_with_virtual(v):
    """As classify_neighbours, in the graph with virtual nodes."""
    virtual = virtual_of(v)
    edges = sym(v).unionByName(graph.virtual_edges(virtual))
    return finder.classify_neighbours(graph.active_edges(edges, active(v), graph.extend(v("f_nodes"), virtual)), v("f_nodes"))


@query(WITH_VIRTUAL, VIEWS, GATHER | HALF | {"vp": VPAIRS, "runs": RUNS})
def grown_leftovers(v):
    found = growing.gather(half(v), active(v), v("f_nodes"), sym(v), virtual_of(v))
    return found.filter("track_id >= 0")


@query(LAID, VIEWS, CHAINS)
def grown_chain(v):
    return growing.join_ends(tracks(v), head_tail_links(v).withColumn("place", F.lit(0)), share=None)


@query(STAYING, VIEWS, STAY)
def grown_clean(v):
    none = head_tail_links(v).limit(0).withColumn("place", F.lit(0))
    return growing.join_ends(tracks(v), none).select("event_id", "track_id").distinct()


@query()
def connect(v):
    return growing.connect(active(v), v("f_nodes"), sym(v))


@query()
def fit_phase(v):
    return growing.fit_phase(tracks(v), active(v), v("f_nodes"), sym(v))


@query()
def reconstruct_qa(v):
    from trackframe.plans.graphs import _nodes

    return reconstruct.reconstruct(v("f_hits"), _nodes(v), v("f_edges"))


@query("SELECT event_id, track_id, k, det_id, seq, round(tx, 5) AS tx, round(ty, 5) AS ty, round(tz, 5) AS tz FROM f_curved", "f_curved")
def curved_hits(v):
    return rounded(v("f_curved"), ["tx", "ty", "tz"], 5)


@query()
def reconstruct_curved(v):
    """The whole way on curved tracks, where the truth is a line through the detector."""
    from trackframe.plans.graphs import _nodes

    return reconstruct.reconstruct(v("f_curved"), _nodes(v), v("f_edges"))


@query("SELECT event_id, component, det_id FROM (SELECT *, count(*) OVER (PARTITION BY event_id, component) AS n FROM comp) WHERE n >= 8", VIEWS, GRAPH | {
    "cut": "SELECT DISTINCT event_id, det_id FROM f_hits WHERE hit_type = 1 AND isochrone >= 0.3", "cl": "SELECT ae.event_id, src, dst FROM ae SEMI JOIN cut a ON a.event_id = ae.event_id AND a.det_id = ae.src SEMI JOIN cut b ON b.event_id = ae.event_id AND b.det_id = ae.dst", "comp": _reach("cut", "cl"),
})
def area_open(v):
    strong = hits.active_nodes(v("f_hits").filter("isochrone >= 0.3"))
    return shape.area_open(strong, graph.active_edges(sym(v), strong, v("f_nodes")), 8)


COV = "SELECT event_id, track_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS sxx, var_samp(y) AS syy, covar_samp(x, y) AS sxy FROM mem GROUP BY ALL HAVING count(*) > 1"


@query("SELECT event_id, track_id, n, round(mx, 4) AS mx, round(my, 4) AS my, round(sxx, 4) AS sxx, round(syy, 4) AS syy, round(sxy, 4) AS sxy, round((sxx + syy) / 2 + sqrt(((sxx - syy) / 2) ** 2 + sxy ** 2), 4) AS e1, round((sxx + syy) / 2 - sqrt(((sxx - syy) / 2) ** 2 + sxy ** 2), 4) AS e2 FROM cov", VIEWS, {"mem": MEM, "cov": COV})
def covariance(v):
    return rounded(shape.covariance(tracks(v), v("f_nodes"), tasks(v)).drop("axis"), ["mx", "my", "sxx", "syy", "sxy", "e1", "e2"])


@query("SELECT m.event_id, m.track_id, pos, det_id, CASE WHEN sxx * syy - sxy * sxy > 1e-6 THEN round(((x - mx) ** 2 * syy - 2 * (x - mx) * (y - my) * sxy + (y - my) ** 2 * sxx) / (sxx * syy - sxy * sxy), 3) END AS d2 FROM mem m JOIN cov c ON m.event_id = c.event_id AND m.track_id = c.track_id", VIEWS, {"mem": MEM, "cov": COV})
def mahalanobis(v):
    return rounded(shape.mahalanobis(tracks(v), v("f_nodes"), shape.covariance(tracks(v), v("f_nodes"))), ["d2"], 3)


ENDS = "SELECT event_id, track_id, x, y FROM (SELECT *, min(pos) OVER w AS lo, max(pos) OVER w AS hi FROM mem WINDOW w AS (PARTITION BY event_id, track_id)) WHERE pos IN (lo, hi)"


@query("SELECT * FROM (SELECT a.event_id, a.track_id AS a, b.track_id AS b, min(round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 5)) AS distance FROM ends a JOIN ends b ON a.event_id = b.event_id AND a.track_id < b.track_id GROUP BY ALL) WHERE distance < 4", VIEWS, {"mem": MEM, "ends": ENDS})
def shortest_pairs(v):
    return shape.shortest_pairs(tracks(v), v("f_nodes"), 4.0)


@query("""SELECT event_id, a, b, distance, CASE WHEN det > 1e-6 THEN round((u * u * syy - 2 * u * v * sxy + v * v * sxx) / det, 3) END AS d2 FROM (SELECT *, sxx * syy - sxy * sxy AS det FROM (
  SELECT p.*, x.mx - y.mx AS u, x.my - y.my AS v, ((x.n - 1) * x.sxx + (y.n - 1) * y.sxx) / (x.n + y.n - 2) AS sxx, ((x.n - 1) * x.syy + (y.n - 1) * y.syy) / (x.n + y.n - 2) AS syy, ((x.n - 1) * x.sxy + (y.n - 1) * y.sxy) / (x.n + y.n - 2) AS sxy
  FROM pairs p LEFT JOIN cov x ON x.event_id = p.event_id AND x.track_id = p.a LEFT JOIN cov y ON y.event_id = p.event_id AND y.track_id = p.b))""", VIEWS, {
    "mem": MEM, "cov": COV, "ends": ENDS, "pairs": "SELECT * FROM (SELECT a.event_id, a.track_id AS a, b.track_id AS b, min(round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 5)) AS distance FROM ends a JOIN ends b ON a.event_id = b.event_id AND a.track_id < b.track_id GROUP BY ALL) WHERE distance < 6"})
def mahalanobis_pairs(v):
    return rounded(shape.mahalanobis_pairs(tracks(v), v("f_nodes")), ["d2"], 3)


@query("SELECT a.event_id, a.track_id AS a, b.track_id AS b FROM ks a JOIN ks b ON a.event_id = b.event_id AND a.track_id < b.track_id WHERE abs(a.k - b.k) < 0.002", "f_points", {
    "ks": "SELECT event_id, track_id, round(1 / (30 + 40 * regr_r2(y, x)), 9) AS k FROM f_points GROUP BY ALL HAVING regr_r2(y, x) IS NOT NULL"})
def curvature_pairs(v):
    radii = v("f_points").groupBy("event_id", "track_id").agg((30 + 40 * F.regr_r2("y", "x")).alias("r"))
    return shape.curvature_pairs(radii, 0.002)


@query("SELECT a.event_id, a.track_id AS a, b.track_id AS b FROM ks a JOIN ks b ON a.event_id = b.event_id AND a.track_id < b.track_id WHERE abs(a.k - b.k) < 0.002", "f_points", KM | {
    "ks": "SELECT event_id, track_id, round(1 / r, 9) AS k FROM kasa WHERE r > 0"})
def curvature_pairs_fitted(v):
    return shape.curvature_pairs(fits.kasa(v("f_points"), ["event_id", "track_id"]), 0.002)


@query("SELECT m.event_id, m.track_id, count(*) FILTER (coalesce(d, 0) <= 1) AS stops FROM (SELECT DISTINCT event_id, track_id, det_id FROM mem) m LEFT JOIN (SELECT a.event_id, a.track_id, a.det_id, count(*) AS d FROM mem a JOIN sym ON src = a.det_id JOIN mem b ON b.event_id = a.event_id AND b.track_id = a.track_id AND b.det_id = dst GROUP BY ALL) g ON g.event_id = m.event_id AND g.track_id = m.track_id AND g.det_id = m.det_id GROUP BY ALL", VIEWS, {"mem": MEM, "sym": SYM})
def end_stops(v):
    return shape.end_stops(tracks(v), sym(v))


@query("SELECT event_id, track_id, into_ AS into, distance FROM (SELECT a.event_id, a.track_id, b.track_id AS into_, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 5) AS distance, row_number() OVER (PARTITION BY a.event_id, a.track_id ORDER BY round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 5), b.track_id) AS o FROM sized a JOIN sized b ON a.event_id = b.event_id AND a.n = 1 AND b.n > 1 WHERE round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 5) <= 3) WHERE o = 1", VIEWS, {"mem": MEM, "sized": "SELECT *, count(*) OVER (PARTITION BY event_id, track_id) AS n FROM mem"})
def merge_singletons(v):
    return shape.merge_singletons(tracks(v), v("f_nodes"))


SETS = {"truth": "SELECT event_id, track_id, tx AS x, ty AS y FROM f_hits", "tube": "SELECT event_id, track_id, x, y FROM mem", "anchor": "SELECT event_id, track_id, x, y FROM tube_anc", "reco": "SELECT event_id, track_id, cx AS x, cy AS y FROM moved"}


def _compare() -> str:
    fit = lambda n: circle_sql("hyper", f"({MOMENTS.replace('FROM f_points', f'FROM ({SETS[n]})')})")
    joins = " ".join(f"LEFT JOIN (SELECT event_id, track_id, round(1 / nullif(r, 0), 5) AS {n}_curvature FROM ({fit(n)})) {n}_fit USING (event_id, track_id)" for n in SETS)
    first = "SELECT event_id, track_id, round(arg_min(px, seq), 6) AS px, round(arg_min(py, seq), 6) AS py, round(arg_min(pz, seq), 6) AS pz FROM f_hits GROUP BY ALL"
    return f"SELECT * FROM ({first}) {joins} LEFT JOIN (SELECT event_id, track_id, min(scatter) AS scatter FROM ({ZED}) GROUP BY ALL) USING (event_id, track_id)"


@query(_compare(), VIEWS, HEIGHTS | {"tube_anc": ANCHORS})
def curvature_compare(v):
    """Curvatures of circles through the true points, the tubes, the anchors and the corrected points of each track, with its first momentum and its scatter angle."""
    found = results.curvatures(tracks(v), v("f_hits"), v("f_nodes"))
    bent = [F.round(1 / F.when(C(f"{n}_r") > 0, C(f"{n}_r")), 5).alias(f"{n}_curvature") for n in SETS]
    return found.select("event_id", "track_id", *(F.round(c, 6).alias(c) for c in ("px", "py", "pz")), *bent, F.round("scatter", 4).alias("scatter"))
