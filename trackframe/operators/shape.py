"""Shapes and neighbourhoods of whole tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.operators.finder import TRACK, placed
from trackframe.operators.graph import components

C = F.col


def area_open(active: DataFrame, edges: DataFrame, area: int) -> DataFrame:
    """(event_id, component, det_id): components of fired nodes with at least so many."""
    found = components(active, edges)
    large = found.groupBy("event_id", "component").agg(F.count("*").alias("n")).filter(C("n") >= area).select("event_id", "component")
    return found.join(large, ["event_id", "component"], "left_semi").select("event_id", "component", "det_id")


def covariance(members: DataFrame, nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """(event_id, track_id, n, mx, my, sxx, syy, sxy, e1, e2, axis): mean, covariance, its eigenvalues and the angle of the larger one's axis."""
    own = placed(members, nodes, tasks)
    m = own.groupBy(*TRACK).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_samp("x", "x").alias("sxx"), F.covar_samp("y", "y").alias("syy"), F.covar_samp("x", "y").alias("sxy")
    ).filter("n > 1")
    half, root = (C("sxx") + C("syy")) / 2, F.sqrt(((C("sxx") - C("syy")) / 2) ** 2 + C("sxy") ** 2)
    return m.withColumns({"e1": half + root, "e2": half - root, "axis": F.atan2(2 * C("sxy"), C("sxx") - C("syy")) / 2})


def mahalanobis(members: DataFrame, nodes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Members with the squared distance to their track's mean in units of its covariance; null for a flat one."""
    det = C("sxx") * C("syy") - C("sxy") * C("sxy")
    own = placed(members, nodes).join(shapes, TRACK).withColumns({"u": C("x") - C("mx"), "v": C("y") - C("my")})
    d2 = (C("u") * C("u") * C("syy") - 2 * C("u") * C("v") * C("sxy") + C("v") * C("v") * C("sxx")) / F.when(det > 1e-9, det)
    return own.select(*TRACK, "pos", "det_id", d2.alias("d2"))


def track_ends(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event_id, track_id, x, y) of both ends of each track (one row for a single node)."""
    own = placed(members, nodes)
    w = Window.partitionBy(*TRACK)
    return own.withColumns({"first": F.min("pos").over(w), "last": F.max("pos").over(w)}).filter("pos = first OR pos = last").select(*TRACK, "x", "y")


def shortest_pairs(members: DataFrame, nodes: DataFrame, below: float) -> DataFrame:
    """(event_id, a, b, distance), a < b: pairs of tracks of an event with ends nearer than ``below``.

    Ends are put into square cells of that size, and only those of neighbouring
    cells meet.
    """
    ends = track_ends(members, nodes).withColumns({"cx": F.floor(C("x") / below), "cy": F.floor(C("y") / below)})
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = ends.select("event_id", C("track_id").alias("a"), C("x").alias("ax"), C("y").alias("ay"), "cx", "cy").withColumn("s", F.explode(steps))
    a = a.withColumns({"cx": C("cx") + C("s.i"), "cy": C("cy") + C("s.j")}).drop("s")
    b = ends.select("event_id", C("track_id").alias("b"), C("x").alias("bx"), C("y").alias("by"), "cx", "cy")
    away = F.round(F.hypot(C("ax") - C("bx"), C("ay") - C("by")), 5)
    near = a.join(b, ["event_id", "cx", "cy"]).filter("a < b").withColumn("distance", away).filter(C("distance") < below)
    return near.groupBy("event_id", "a", "b").agg(F.min("distance").alias("distance"))


def mahalanobis_pairs(members: DataFrame, nodes: DataFrame, below: float = 6.0) -> DataFrame:
    """(event_id, a, b, distance, d2), a < b: tracks with ends nearer than ``below``, and the squared distance of their means in units of their pooled covariance.

    Candidates come from cells of ends (``shortest_pairs``); d2 is null for
    tracks of one node and where the pooled covariance is flat.
    """
    shapes = covariance(members, nodes).select(*TRACK, "n", "mx", "my", "sxx", "syy", "sxy")
    near = shortest_pairs(members, nodes, below)
    for t in "ab":
        near = near.join(shapes.select("event_id", C("track_id").alias(t), *(C(c).alias(f"{t}_{c}") for c in shapes.columns[2:])), ["event_id", t], "left")
    pooled = lambda c: ((C("a_n") - 1) * C(f"a_{c}") + (C("b_n") - 1) * C(f"b_{c}")) / (C("a_n") + C("b_n") - 2)
    near = near.withColumns({c: pooled(c) for c in ("sxx", "syy", "sxy")}).withColumns({"u": C("a_mx") - C("b_mx"), "v": C("a_my") - C("b_my"), "det": C("sxx") * C("syy") - C("sxy") * C("sxy")})
    d2 = (C("u") * C("u") * C("syy") - 2 * C("u") * C("v") * C("sxy") + C("v") * C("v") * C("sxx")) / F.when(C("det") > 1e-6, C("det"))
    return near.select("event_id", "a", "b", "distance", d2.alias("d2"))


def curvature_pairs(circles: DataFrame, below: float) -> DataFrame:
    """(event_id, a, b), a < b: tracks of an event whose curvatures differ by less than ``below``; met by cells of that size."""
    own = circles.filter("r IS NOT NULL AND r > 0").withColumn("k", F.round(1 / C("r"), 9)).withColumn("cell", F.floor(C("k") / below))
    a = own.select("event_id", C("track_id").alias("a"), C("k").alias("ka"), F.explode(F.array(C("cell") - 1, C("cell"), C("cell") + 1)).alias("cell"))
    b = own.select("event_id", C("track_id").alias("b"), C("k").alias("kb"), "cell")
    return a.join(b, ["event_id", "cell"]).filter("a < b").filter(F.abs(C("ka") - C("kb")) < below).select("event_id", "a", "b")


def end_stops(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(event_id, track_id, stops): nodes of a track with at most one neighbour in it."""
    own = members.select(*TRACK, "det_id").distinct()
    near = own.join(edges.select(C("src").alias("det_id"), "dst"), "det_id").join(own.withColumnRenamed("det_id", "dst"), [*TRACK, "dst"])
    degree = near.groupBy(*TRACK, "det_id").agg(F.count("*").alias("degree"))
    return own.join(degree, [*TRACK, "det_id"], "left").groupBy(*TRACK).agg(F.count(F.when(F.coalesce("degree", F.lit(0)) <= 1, 1)).alias("stops"))


def merge_singletons(members: DataFrame, nodes: DataFrame, farthest: float = 3.0) -> DataFrame:
    """(event_id, track_id, into, distance): tracks of one node and the nearest node's track within a distance; cells as in shortest_pairs."""
    own = placed(members, nodes)
    size = F.count("*").over(Window.partitionBy(*TRACK))
    own = own.withColumn("n", size).withColumns({"cx": F.floor(C("x") / farthest), "cy": F.floor(C("y") / farthest)})
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    one = own.filter("n = 1").select(*TRACK, C("x").alias("ax"), C("y").alias("ay"), "cx", "cy", F.explode(steps).alias("s"))
    one = one.withColumns({"cx": C("cx") + C("s.i"), "cy": C("cy") + C("s.j")})
    other = own.filter("n > 1").select("event_id", C("track_id").alias("into"), "x", "y", "cx", "cy")
    away = F.round(F.hypot(C("ax") - C("x"), C("ay") - C("y")), 5)
    near = one.join(other, ["event_id", "cx", "cy"]).withColumn("distance", away).filter(C("distance") <= farthest)
    return near.groupBy(*TRACK).agg(F.min(F.struct("distance", "into")).alias("m")).select(*TRACK, C("m.into").alias("into"), C("m.distance").alias("distance"))
