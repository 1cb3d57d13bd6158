"""Queries on the detector graph and on geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.operators import graph, hits
from trackframe.plans.registry import query
from trackframe.sources.fixtures import event_tasks
from trackframe.sources.io import as_nodes

SLOPE = "round(CASE WHEN dx = 0 AND dy = 0 THEN 1.0::DOUBLE WHEN atan2(dy, dx) > 0 THEN tan(pi() / 60) WHEN atan2(dy, dx) < 0 THEN -tan(pi() / 60) ELSE 1.0::DOUBLE END, 8)"
SYM = "SELECT src, dst FROM f_edges UNION SELECT dst, src FROM f_edges"
ACTIVE = "SELECT DISTINCT event_id, det_id FROM f_hits"
PAIRS = f"""SELECT DISTINCT least(a.det_id, b.det_id) AS a, greatest(a.det_id, b.det_id) AS b FROM f_edges e JOIN (SELECT *, {SLOPE} AS slope FROM f_nodes) a ON e.src = a.det_id
  JOIN (SELECT *, {SLOPE} AS slope FROM f_nodes) b ON e.dst = b.det_id WHERE abs(a.layer - b.layer) = 1 AND a.slope <> b.slope"""


def closest_sql(pairs: str, wide: float) -> str:
    """SQL of (pairs' columns a and b, points p and q) for tubes a and b of f_nodes: the closest points of their segments."""
    ends = ", ".join(
        f"{t}.{c} {s} {t}.half_length * {t}.d{c} {s} {0.0 if c == 'z' else wide}::DOUBLE AS {t}{k}{c}" for t in "mn" for c in "xyz" for s, k in (("-", 0), ("+", 1))
    )
    diff = lambda a, b, n: ", ".join(f"{a}{c} - {b}{c} AS {n}{c}" for c in "xyz")
    dot = lambda a, b: " + ".join(f"{a}{c} * {b}{c}" for c in "xyz")
    return f"""SELECT a, b, m0x + s * ux AS px, m0y + s * uy AS py, m0z + s * uz AS pz, n0x + t * vx AS qx, n0y + t * vy AS qy, n0z + t * vz AS qz, m_sector, m_layer FROM (
      SELECT *, CASE WHEN tt < 0 THEN least(1, greatest(0, -uw / uu)) WHEN tt > 1 THEN least(1, greatest(0, (uv - uw) / uu)) ELSE ss END AS s, least(1, greatest(0, tt)) AS t FROM (
      SELECT *, (uv * ss + vw) / vv AS tt FROM (
      SELECT *, CASE WHEN uu * vv - uv * uv < 2.220446049250313e-16::DOUBLE THEN 0.0::DOUBLE ELSE least(1, greatest(0, (uv * vw - vv * uw) / (uu * vv - uv * uv))) END AS ss FROM (
      SELECT *, {dot('u', 'u')} AS uu, {dot('u', 'v')} AS uv, {dot('v', 'v')} AS vv, {dot('u', 'w')} AS uw, {dot('v', 'w')} AS vw FROM (
      SELECT *, {diff('m1', 'm0', 'u')}, {diff('n1', 'n0', 'v')}, {diff('m0', 'n0', 'w')} FROM (
      SELECT p.a, p.b, m.sector AS m_sector, m.layer AS m_layer, {ends} FROM ({pairs}) p JOIN f_nodes m ON p.a = m.det_id JOIN f_nodes n ON p.b = n.det_id))))))"""


def _nodes(v):
    return as_nodes(v("f_nodes")).withColumn("slope", F.round("slope", 8))


def _active(v):
    return hits.active_nodes(v("f_hits"))


def _rounded(df, names, digits=5):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query(f"SELECT det_id, {SLOPE} AS slope FROM f_nodes", "f_nodes")
def slope_class(v):
    return _nodes(v).select("det_id", "slope")


@query("SELECT det_id, CASE node_type WHEN 1 THEN 'PARA' WHEN 2 THEN 'SKEW' ELSE 'UNKNOWN' END AS kind, (SELECT max(det_id) + 1 FROM f_nodes) AS first_virtual FROM f_nodes", "f_nodes")
def split_nodes(v):
    nodes = _nodes(v).select("det_id", "kind")
    return nodes.withColumn("first_virtual", F.lit(nodes.agg(F.max("det_id") + 1).first()[0]))


@query("SELECT det_id, layer_limit OR NOT EXISTS (SELECT 1 FROM f_edges e JOIN f_nodes d ON e.dst = d.det_id WHERE e.src = n.det_id AND d.layer > n.layer) AS layer_limit FROM f_nodes n", "f_nodes f_edges")
def layer_limit(v):
    return graph.repaired_layer_limit(v("f_nodes"), v("f_edges")).select("det_id", "layer_limit")


@query("SELECT det_id, 'layer' AS boundary FROM f_nodes WHERE layer_limit UNION ALL SELECT det_id, 'sector' FROM f_nodes WHERE sector_limit <> 0", "f_nodes")
def boundaries(v):
    return graph.boundaries(v("f_nodes"))


@query(SYM, "f_edges")
def symmetrise(v):
    return graph.symmetrise(v("f_edges"))


@query(PAIRS, "f_nodes f_edges")
def layer_pairs(v):
    return graph.layer_pairs(_nodes(v), v("f_edges"))


@query(f"SELECT row_number() OVER (ORDER BY a, b) + (SELECT max(det_id) FROM f_nodes) AS det_id, m_sector AS sector, m_layer AS layer, a AS parent_a, b AS parent_b, round((px + qx) / 2, 5) AS x, round((py + qy) / 2, 5) AS y, round((pz + qz) / 2, 5) AS z FROM ({closest_sql(PAIRS, 0.1)})", "f_nodes f_edges")
def virtual_nodes(v):
    found = graph.virtual_nodes(_nodes(v), graph.layer_pairs(_nodes(v), v("f_edges")))
    return _rounded(found.select("det_id", "sector", "layer", "parent_a", "parent_b", "x", "y", "z"), "xyz")


SEAM = "SELECT a.det_id AS a, b.det_id AS b FROM f_nodes a JOIN f_nodes b ON b.sector = (a.sector + 5) % 6 AND abs(a.layer - b.layer) <= 1 WHERE a.node_type = 2 AND b.node_type = 2 AND a.sector_limit = -1 AND b.sector_limit = 1"


@query(f"SELECT a AS src, b AS dst FROM ({closest_sql(SEAM, 0.0)}) WHERE sqrt((px - qx) ** 2 + (py - qy) ** 2 + (pz - qz) ** 2) < 3.5", "f_nodes")
def seam_edges(v):
    return graph.seam_edges(v("f_nodes"))


@query(f"SELECT node_type, count(*) AS n, count(parent_a) AS with_parents FROM (SELECT node_type, NULL AS parent_a FROM f_nodes UNION ALL SELECT 6, a FROM ({PAIRS})) GROUP BY node_type", "f_nodes f_edges")
def extend_grid(v):
    nodes = _nodes(v)
    every = graph.extend(nodes, graph.virtual_nodes(nodes, graph.layer_pairs(nodes, v("f_edges"))))
    return every.groupBy("node_type").agg(F.count("*").alias("n"), F.count("parent_a").alias("with_parents"))


@query("SELECT p_partkey * 3 AS det_id, coalesce(n.det_id, -1) AS found FROM part LEFT JOIN f_nodes n ON n.det_id = p_partkey * 3", "f_nodes")
def lookup(v):
    return graph.lookup(v("f_nodes"), v("part").select((F.col("p_partkey") * 3).alias("det_id")))


@query("SELECT p_partkey + 1 AS a, (p_partkey * 7) % 1000 + 1 AS b, EXISTS (SELECT 1 FROM f_edges WHERE src = p_partkey + 1 AND dst = (p_partkey * 7) % 1000 + 1) AS adjacent FROM part", "f_edges")
def is_neighbour(v):
    return graph.is_neighbour(v("part").select((F.col("p_partkey") + 1).alias("a"), ((F.col("p_partkey") * 7) % 1000 + 1).alias("b")), v("f_edges"))


@query("SELECT DISTINCT o.event_id, o.det_id, o.reached FROM (SELECT event_id, det_id, dst AS reached FROM act JOIN sym ON det_id = src UNION SELECT event_id, det_id, b.dst FROM act JOIN sym a ON det_id = a.src JOIN sym b ON a.dst = b.src) o JOIN act t ON o.event_id = t.event_id AND o.reached = t.det_id WHERE o.det_id <> o.reached", "f_hits f_edges", {"act": ACTIVE, "sym": SYM})
def active_two_hop(v):
    return graph.active_two_hop(graph.symmetrise(v("f_edges")), _active(v), event_tasks(v("lineitem")))


@query("""SELECT event_id, det_id, reached FROM l1 WHERE on1 UNION
  SELECT f.event_id, f.det_id, s.dst FROM (SELECT * FROM (SELECT *, bool_or(on1) OVER (PARTITION BY event_id, det_id) AS hit FROM l1) WHERE on1 OR NOT hit) f JOIN sym s ON f.reached = s.src JOIN act t ON f.event_id = t.event_id AND s.dst = t.det_id""", "f_hits f_edges",
  {"act": ACTIVE, "sym": SYM, "l1": "SELECT a.event_id, a.det_id, dst AS reached, t.det_id IS NOT NULL AS on1 FROM act a JOIN sym ON a.det_id = src LEFT JOIN act t ON a.event_id = t.event_id AND t.det_id = dst"})
def active_k_hop(v):
    return graph.active_k_hop(graph.symmetrise(v("f_edges")), _active(v), 2, event_tasks(v("lineitem")))


@query("SELECT a.event_id, s.src, s.dst, n.node_type AS dst_type, n.layer AS dst_layer FROM act a JOIN sym s ON a.det_id = s.src JOIN act b ON a.event_id = b.event_id AND b.det_id = s.dst JOIN f_nodes n ON n.det_id = s.dst", "f_hits f_edges f_nodes", {"act": ACTIVE, "sym": SYM})
def active_edges(v):
    return graph.active_edges(graph.symmetrise(v("f_edges")), _active(v), v("f_nodes"), event_tasks(v("lineitem")))


@query(f"SELECT act.event_id, v.det_id AS virtual FROM act JOIN (SELECT row_number() OVER (ORDER BY a, b) + (SELECT max(det_id) FROM f_nodes) AS det_id, a, b FROM ({PAIRS})) v ON act.det_id = v.a JOIN act o ON o.event_id = act.event_id AND o.det_id = v.b", "f_hits f_edges f_nodes", {"act": ACTIVE})
def active_virtuals(v):
    nodes = _nodes(v)
    virtual = graph.virtual_nodes(nodes, graph.layer_pairs(nodes, v("f_edges")))
    every = graph.extend(nodes, virtual)
    edges = graph.symmetrise(v("f_edges")).unionByName(graph.virtual_edges(virtual))
    return graph.active_edges(edges, _active(v), every).filter(f"dst_type = {graph.VIRTUAL}").select("event_id", F.col("dst").alias("virtual")).distinct()


@query("""SELECT act.event_id, act.det_id, coalesce(d, 0) AS degree, row_number() OVER (PARTITION BY act.event_id ORDER BY CASE WHEN layer_limit THEN 0 WHEN d = 1 THEN 1 ELSE 2 END, coalesce(d, 0), act.det_id) AS place
  FROM act JOIN f_nodes n ON act.det_id = n.det_id LEFT JOIN (SELECT a.event_id, src, count(*) AS d FROM act a JOIN sym ON a.det_id = src JOIN act b ON a.event_id = b.event_id AND b.det_id = dst GROUP BY ALL) g ON g.event_id = act.event_id AND g.src = act.det_id""", "f_hits f_edges f_nodes", {"act": ACTIVE, "sym": SYM})  # fmt: skip
def seed_order(v):
    found = graph.active_edges(graph.symmetrise(v("f_edges")), _active(v), v("f_nodes"))
    return graph.seed_order(_active(v), found, v("f_nodes"))


@query("SELECT event_id, act.det_id, round(x, 5) AS x_det, round(y, 5) AS y_det, CASE WHEN node_type = 1 THEN 0.0::DOUBLE ELSE z END AS z_det FROM act JOIN f_nodes n ON act.det_id = n.det_id", "f_hits f_nodes", {"act": ACTIVE})
def initial_coords(v):
    return _rounded(graph.initial_coords(_active(v), v("f_nodes")), ["x_det", "y_det"])


@query("SELECT a.layer, count(*) AS n, round(avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 5) AS mean_length, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 5) AS max_length FROM f_edges e JOIN f_nodes a ON e.src = a.det_id JOIN f_nodes b ON e.dst = b.det_id GROUP BY a.layer", "f_edges f_nodes")
def edge_length(v):
    a = v("f_nodes").select(F.col("det_id").alias("src"), "layer", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = v("f_nodes").select(F.col("det_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    length = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    found = v("f_edges").join(a, "src").join(b, "dst").groupBy("layer").agg(F.count("*").alias("n"), F.avg(length).alias("mean_length"), F.max(length).alias("max_length"))
    return _rounded(found, ["mean_length", "max_length"])


POINTS = "SELECT event_id, reco_id, pos, x, y, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS cx, lead(y) OVER w AS cy, degrees(atan2(y, x)) AS theta, lag(degrees(atan2(y, x))) OVER w AS before FROM f_reco r JOIN f_nodes n ON r.det_id = n.det_id WINDOW w AS (PARTITION BY event_id, reco_id ORDER BY pos)"


def _points(v):
    w = Window.partitionBy("event_id", "reco_id").orderBy("pos")
    own, tasks = v("f_reco").join(v("f_nodes").drop("ring"), "det_id"), event_tasks(v("lineitem"))
    own = own.repartition(tasks, "event_id") if tasks else own
    return own.withColumns({"ax": F.lag("x").over(w), "ay": F.lag("y").over(w), "cx": F.lead("x").over(w), "cy": F.lead("y").over(w), "theta": F.degrees(F.atan2("y", "x"))}).withColumn("before", F.lag("theta").over(w))


C = F.col
#: A signed angle; half a turn has no sign of its own, nor has 0.
WHOLE = "CASE WHEN a <= -180 THEN -a ELSE a + 0 END"


def _whole(a):
    return F.when(a <= -180, -a).otherwise(a + 0.0)


@query(f"SELECT event_id, reco_id, pos, {WHOLE} AS angle FROM (SELECT *, round(atan2((ax - x) * (cy - y) - (ay - y) * (cx - x), (ax - x) * (cx - x) + (ay - y) * (cy - y)) * 180 / 3.14159265::DOUBLE, 4) AS a FROM pts) WHERE ax IS NOT NULL AND cx IS NOT NULL AND (ax <> x OR ay <> y) AND (cx <> x OR cy <> y)", "f_reco f_nodes", {"pts": POINTS})
def bend_angle(v):
    pts = _points(v).filter("ax IS NOT NULL AND cx IS NOT NULL AND (ax <> x OR ay <> y) AND (cx <> x OR cy <> y)")
    return pts.select("event_id", "reco_id", "pos", _whole(F.round(G.bend_angle(C("ax"), C("ay"), C("x"), C("y"), C("cx"), C("cy")), 4)).alias("angle"))


@query(f"SELECT event_id, reco_id, pos, {WHOLE} AS turn FROM (SELECT *, round(atan2((x - ax) * (cy - y) - (y - ay) * (cx - x), (x - ax) * (cx - x) + (y - ay) * (cy - y)) * 180 / 3.14::DOUBLE, 4) AS a FROM pts) WHERE ax IS NOT NULL AND cx IS NOT NULL", "f_reco f_nodes", {"pts": POINTS})
def turn_angle(v):
    pts = _points(v).filter("ax IS NOT NULL AND cx IS NOT NULL")
    return pts.select("event_id", "reco_id", "pos", _whole(F.round(G.turn_angle(C("x") - C("ax"), C("y") - C("ay"), C("cx") - C("x"), C("cy") - C("y")), 4)).alias("turn"))


def _curve(third: str) -> str:
    return f"CASE WHEN l1 * l2 * l3 <> 0 THEN round(abs(ax * (y - cy) + x * (cy - ay) + {third} * (ay - y)) / 2 / (l1 * l2 * l3), 5) END"


@query(f"SELECT event_id, reco_id, pos, {_curve('cx')} AS curvature, {_curve('x')} AS as_written FROM (SELECT *, sqrt((ax - x) ** 2 + (ay - y) ** 2) AS l1, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS l2, sqrt((cx - ax) ** 2 + (cy - ay) ** 2) AS l3 FROM pts WHERE ax IS NOT NULL AND cx IS NOT NULL)", "f_reco f_nodes", {"pts": POINTS})
def curvature3(v):
    args = [C(c) for c in ("ax", "ay", "x", "y", "cx", "cy")]
    pts = _points(v).filter("ax IS NOT NULL AND cx IS NOT NULL")
    return pts.select("event_id", "reco_id", "pos", F.round(G.curvature3(*args), 5).alias("curvature"), F.round(G.curvature3(*args, parity=True), 5).alias("as_written"))


TUBE_PAIRS = "SELECT src AS a, dst AS b FROM f_edges"


def _tube_pairs(v):
    tube = ("det_id", "x", "y", "z", "half_length", "dx", "dy", "dz")
    a = v("f_nodes").select(*(C(c).alias("src" if c == "det_id" else f"a_{c}") for c in tube))
    b = v("f_nodes").select(*(C(c).alias("dst" if c == "det_id" else f"b_{c}") for c in tube))
    return v("f_edges").join(a, "src").join(b, "dst")


@query(f"SELECT a, b, round(sqrt((px - qx) ** 2 + (py - qy) ** 2 + (pz - qz) ** 2), 5) AS distance FROM ({closest_sql(TUBE_PAIRS, 0.0)})", "f_edges f_nodes")
def segment_distance(v):
    return G.with_segment_distance(_tube_pairs(v), "a_", "b_").select(C("src").alias("a"), C("dst").alias("b"), F.round("distance", 5).alias("distance"))


SKEWED_PAIRS = "SELECT src AS a, dst AS b FROM f_edges e JOIN f_nodes m ON e.src = m.det_id JOIN f_nodes n ON e.dst = n.det_id WHERE m.layer <> n.layer AND (m.node_type = 2 OR n.node_type = 2)"


@query(f"SELECT a, b, round(px, 4) AS px, round(py, 4) AS py, round(pz, 3) AS pz, round(qx, 4) AS qx, round(qy, 4) AS qy, round(qz, 3) AS qz FROM ({closest_sql(SKEWED_PAIRS, 0.1)})", "f_edges f_nodes")
def closest_points(v):
    layers = v("f_nodes").select("det_id", "layer", "node_type")
    pairs = _tube_pairs(v).join(layers.toDF("src", "la", "ta"), "src").join(layers.toDF("dst", "lb", "tb"), "dst").filter("la <> lb AND (ta = 2 OR tb = 2)")
    found = G.with_closest_points(pairs, "a_", "b_", 0.10)
    return found.select(C("src").alias("a"), C("dst").alias("b"), *(F.round(n, 3 if n[1] == "z" else 4).alias(n) for n in ("px", "py", "pz", "qx", "qy", "qz")))


#: Lines at skewed members: from the point before to the one after, from the track's first point to the one before, and along the tube.
TUBES = "SELECT p.*, n.x AS tx, n.y AS ty, n.dy, n.dz, n.x - n.half_length * n.dx AS x3, n.y - n.half_length * n.dy AS y3, n.z - n.half_length * n.dz AS z3, n.x + n.half_length * n.dx AS x4, n.y + n.half_length * n.dy AS y4, first_value(p.x) OVER w AS ox, first_value(p.y) OVER w AS oy FROM pts p JOIN f_reco r ON p.event_id = r.event_id AND p.reco_id = r.reco_id AND p.pos = r.pos JOIN f_nodes n ON r.det_id = n.det_id WINDOW w AS (PARTITION BY p.event_id, p.reco_id ORDER BY p.pos)"
DRAWN = """SELECT * EXCLUDE (ax, ay, cx, cy), 'around' AS line, ax, ay, cx, cy FROM tubes WHERE abs(dz) < 1 AND cx IS NOT NULL UNION ALL SELECT * EXCLUDE (ax, ay, cx, cy), 'from first', ox, oy, ax, ay FROM tubes WHERE abs(dz) < 1 AND pos > 2 UNION ALL SELECT * EXCLUDE (ax, ay, cx, cy), 'along', x3, y3, x4, y4 FROM tubes WHERE abs(dz) < 1"""
LINES = """SELECT *, sqrt((ix - x3) ** 2 + (iy - y3) ** 2) AS w3, sqrt((ix - x4) ** 2 + (iy - y4) ** 2) AS w4, sqrt((x4 - x3) ** 2 + (y4 - y3) ** 2) + 1 AS most FROM (SELECT *, CASE WHEN cross_uv <> 0 THEN (a * vx - ux * b) / cross_uv END AS ix, CASE WHEN cross_uv <> 0 THEN (a * vy - uy * b) / cross_uv END AS iy FROM (
  SELECT *, ux * vy - uy * vx AS cross_uv, ax * cy - ay * cx AS a, x3 * y4 - y3 * x4 AS b FROM (SELECT *, ax - cx AS ux, ay - cy AS uy, x3 - x4 AS vx, y3 - y4 AS vy FROM drawn WHERE ax IS NOT NULL)))"""
LINED = {"pts": POINTS, "tubes": TUBES, "drawn": DRAWN, "lines": LINES}


def _lines(v):
    """Skewed members with the lines of DRAWN."""
    near, far = G.tube_ends("")
    first = Window.partitionBy("event_id", "reco_id").orderBy("pos")
    own = _points(v).withColumns({"ox": F.first("x").over(first), "oy": F.first("y").over(first)}).filter("node_type = 2")
    drawn = {"around": (C("ax"), C("ay"), C("cx"), C("cy")), "from first": (C("ox"), C("oy"), C("ax"), C("ay")), "along": (*near[:2], *far[:2])}
    lines = F.array(*(F.struct(F.lit(k).alias("line"), *(c.alias(f"l{i}") for i, c in enumerate(cs))) for k, cs in drawn.items()))
    own = own.withColumn("l", F.explode(lines)).filter("(l.line <> 'around' OR (ax IS NOT NULL AND cx IS NOT NULL)) AND (l.line <> 'from first' OR pos > 2)")
    return own.drop("ax", "ay", "cx", "cy").select("*", "l.line", C("l.l0").alias("ax"), C("l.l1").alias("ay"), C("l.l2").alias("bx"), C("l.l3").alias("by"))


LINE = ["event_id", "reco_id", "pos", "line"]


@query("SELECT event_id, reco_id, pos, line, round(ix, 3) AS ix, round(iy, 3) AS iy, CASE WHEN abs(dy) > 0.001 THEN round(z3 + dz * (iy - y3) / dy, 2) END AS iz FROM lines", "f_reco f_nodes", LINED)
def line_intersect(v):
    x, y, z = G.line_meets_tube(C("ax"), C("ay"), C("bx"), C("by"), "")
    return _lines(v).select(*LINE, F.round(x, 3).alias("ix"), F.round(y, 3).alias("iy"), F.when(F.abs("dy") > 0.001, F.round(z, 2)).alias("iz"))


@query("SELECT event_id, reco_id, pos, line, coalesce(w3 + w4 <= most, false) AS met, CASE WHEN w3 + w4 <= most THEN round(ix, 3) END AS ix, CASE WHEN w3 + w4 <= most THEN round(iy, 3) END AS iy FROM lines", "f_reco f_nodes", LINED)
def line_tube_strict(v):
    x, y, _ = G.line_meets_tube(C("ax"), C("ay"), C("bx"), C("by"), "")
    met = F.coalesce(G.on_tube(x, y, ""), F.lit(False))
    return _lines(v).select(*LINE, met.alias("met"), F.when(met, F.round(x, 3)).alias("ix"), F.when(met, F.round(y, 3)).alias("iy"))


@query("SELECT event_id, reco_id, pos, line, round(px, 3) AS cx, round(py, 3) AS cy, CASE WHEN ix IS NULL THEN 0 WHEN abs(dy) > 0.001 THEN round(z3 + dz * (py - y3) / dy, 2) END AS cz FROM (SELECT *, CASE WHEN ix IS NULL THEN tx WHEN w3 + w4 <= most THEN ix WHEN w3 < w4 THEN x3 ELSE x4 END AS px, CASE WHEN ix IS NULL THEN ty WHEN w3 + w4 <= most THEN iy WHEN w3 < w4 THEN y3 ELSE y4 END AS py FROM lines)", "f_reco f_nodes", LINED)
def line_tube_clamp(v):
    found = G.with_clamped(_lines(v), C("ax"), C("ay"), C("bx"), C("by"), "")
    height = F.when((C("cz") == 0) | (F.abs("dy") > 0.001), F.round("cz", 2))
    return found.select(*LINE, F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"), height.alias("cz"))


@query("SELECT event_id, reco_id, pos, CASE WHEN x - ax > 1 THEN 1 WHEN x - ax < -1 THEN -1 ELSE 0 END AS dir_x, CASE WHEN y - ay > 1 THEN 1 WHEN y - ay < -1 THEN -1 ELSE 0 END AS dir_y FROM (SELECT event_id, reco_id, pos, round(x, 6) AS x, round(y, 6) AS y, round(ax, 6) AS ax, round(ay, 6) AS ay FROM pts) WHERE ax IS NOT NULL", "f_reco f_nodes", {"pts": POINTS})
def step_direction(v):
    pts = _rounded(_points(v).filter("ax IS NOT NULL"), ["x", "y", "ax", "ay"], 6)
    return pts.select("event_id", "reco_id", "pos", G.step_direction(C("x"), C("ax")).alias("dir_x"), G.step_direction(C("y"), C("ay")).alias("dir_y"))


@query("SELECT event_id, reco_id, pos, round(CASE WHEN theta > 150 AND before < -150 THEN theta - 360 WHEN theta < -150 AND before > 150 THEN theta + 360 ELSE theta END, 4) AS theta FROM pts", "f_reco f_nodes", {"pts": POINTS})
def unwrap(v):
    return _points(v).select("event_id", "reco_id", "pos", F.round(G.unwrapped(C("theta"), C("before")), 4).alias("theta"))


@query("SELECT det_id, row_number() OVER (PARTITION BY sector ORDER BY round(x, 6), round(y, 6), det_id) AS by_place, row_number() OVER (PARTITION BY sector ORDER BY layer, det_id) AS by_layer FROM f_nodes", "f_nodes")
def order_nodes(v):
    nodes = _rounded(v("f_nodes"), "xy", 6)
    place = lambda *cols: F.row_number().over(Window.partitionBy("sector").orderBy(*cols)).cast("long")
    return nodes.select("det_id", place("x", "y", "det_id").alias("by_place"), place("layer", "det_id").alias("by_layer"))


@query("SELECT det_id, round(CASE WHEN t < 0 THEN t + pi() WHEN t >= pi() THEN 0 ELSE t END, 5) AS angle FROM (SELECT det_id, atan2(y, x) AS t FROM f_nodes)", "f_nodes")
def line_angle(v):
    return v("f_nodes").select("det_id", F.round(G.line_angle(C("x"), C("y")), 5).alias("angle"))
