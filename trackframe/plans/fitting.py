"""Queries on fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.operators import fits
from trackframe.plans.registry import query

BY = ["event_id", "track_id"]
C = F.col


def rounded(df, names, digits=5):
    return df.withColumns({c: F.round(c, digits) for c in names})


def points(v):
    return v("f_points")


def shifted(v):
    """Points with the drift radius of their hit."""
    return v("f_points").join(v("f_hits").select(*BY, "k", "isochrone"), [*BY, "k"])


@query("SELECT event_id, track_id, count(*) AS n, round(regr_intercept(x, k), 5) AS intercept, round(regr_slope(x, k), 5) AS slope FROM f_points GROUP BY ALL", "f_points")
def linear_fit(v):
    return rounded(fits.linear_fit(points(v), BY, "k", "x"), ["intercept", "slope"])


SUMS = "SELECT event_id, track_id, mx, count(*)::DOUBLE AS s0, sum(u) AS s1, sum(u ** 2) AS s2, sum(u ** 3) AS s3, sum(u ** 4) AS s4, sum(x) AS t0, sum(u * x) AS t1, sum(u * u * x) AS t2 FROM (SELECT *, k - mx AS u FROM (SELECT *, avg(k) OVER (PARTITION BY event_id, track_id) AS mx FROM f_points)) GROUP BY ALL"
SOLVED = """SELECT *, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / d AS a0, (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / d AS a1, (s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / d AS a2
  FROM (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS d FROM sums)"""


@query("SELECT event_id, track_id, s0::BIGINT AS n, round(a0 - a1 * mx + a2 * mx * mx, 4) AS c0, round(a1 - 2 * a2 * mx, 4) AS c1, round(a2, 4) AS c2 FROM solved", "f_points", {"sums": SUMS, "solved": SOLVED})
def quadratic_fit(v):
    return rounded(fits.quadratic_fit(points(v), BY, "k", "x"), ["c0", "c1", "c2"], 4)


MOMENTS = """SELECT event_id, track_id, mx, my, count(*) AS n, avg(u * u) AS mxx, avg(v * v) AS myy, avg(u * v) AS mxy, avg(u * w) AS mxz, avg(v * w) AS myz, avg(w * w) AS mzz FROM (SELECT *, u * u + v * v AS w FROM (SELECT *, x - mx AS u, y - my AS v
  FROM (SELECT *, avg(x) OVER (PARTITION BY event_id, track_id) AS mx, avg(y) OVER (PARTITION BY event_id, track_id) AS my FROM f_points))) GROUP BY ALL"""
KASA = """SELECT event_id, track_id, n, u + mx AS a, v + my AS b, sqrt(u * u + v * v + mxx + myy) AS r FROM (SELECT *, CASE WHEN mxx * myy - mxy * mxy > 1e-9 THEN (mxz * myy - myz * mxy) / 2 / (mxx * myy - mxy * mxy) END AS u,
  CASE WHEN mxx * myy - mxy * mxy > 1e-9 THEN (myz * mxx - mxz * mxy) / 2 / (mxx * myy - mxy * mxy) END AS v FROM moments)"""
KM = {"moments": MOMENTS, "kasa": KASA}


@query("SELECT event_id, track_id, n, round(a, 3) AS a, round(b, 3) AS b, round(r, 3) AS r FROM kasa", "f_points", KM)
def circle_kasa(v):
    return rounded(fits.kasa(points(v), BY), "abr", 3)


@query("SELECT p.event_id, p.track_id, round(sqrt(avg((sqrt((x - a) ** 2 + (y - b) ** 2) - r) ** 2)), 4) AS sigma FROM f_points p JOIN kasa k ON p.event_id = k.event_id AND p.track_id = k.track_id GROUP BY ALL", "f_points", KM)
def circle_sigma(v):
    return rounded(fits.circle_sigma(points(v), fits.kasa(points(v), BY), BY), ["sigma"], 4)


def circle_sql(kind: str, moments: str = "moments") -> str:
    """SQL of a Hyper, Pratt or Taubin fit: the root next to zero by plain Newton steps, many more than the fit needs; none for points on a line."""
    second, third, fourth, share = {
        "hyper": ("4 * cov - 3 * mz * mz - mzz", "0", "4", -2), "pratt": ("4 * cov - 3 * mz * mz - mzz", "0", "4", 2), "taubin": ("-3 * mz * mz - mzz", "4 * mz", "0", 0),
    }[kind]
    value, slope = "(p0 + t * (p1 + t * (p2 + t * (p3 + t * p4))))", "(p1 + t * (2 * p2 + t * (3 * p3 + t * 4 * p4)))"
    return f"""SELECT event_id, track_id, n, u + mx AS a, v + my AS b, sqrt(u * u + v * v + mz + {share} * root) AS r FROM (
      SELECT *, CASE WHEN abs(det) > 1e-12 AND cov > 1e-12 * mz * mz THEN (mxz * (myy - root) - myz * mxy) / 2 / det END AS u, CASE WHEN abs(det) > 1e-12 AND cov > 1e-12 * mz * mz THEN (myz * (mxx - root) - mxz * mxy) / 2 / det END AS v FROM (SELECT *, root * root - root * mz + cov AS det FROM (
      SELECT *, list_reduce(list_transform(range(60), lambda i: 0::DOUBLE), lambda t, i: CASE WHEN {slope} = 0 THEN t ELSE t - {value} / {slope} END) AS root FROM (
      SELECT *, mxz * (mxz * myy - myz * mxy) + myz * (myz * mxx - mxz * mxy) - (mzz - mz * mz) * cov AS p0, (mzz - mz * mz) * mz + 4 * cov * mz - mxz * mxz - myz * myz AS p1, ({second})::DOUBLE AS p2, ({third})::DOUBLE AS p3, ({fourth})::DOUBLE AS p4 FROM (
      SELECT *, mxx + myy AS mz, mxx * myy - mxy * mxy AS cov FROM {moments})))))"""


#: A circle as its curvature, and its centre and radius where these are told by the points: under 10 m.
CURVED = "round(1 / nullif(r, 0), 6) AS curvature, CASE WHEN r < 1000 THEN round(a, 2) END AS a, CASE WHEN r < 1000 THEN round(b, 2) END AS b, CASE WHEN r < 1000 THEN round(r, 2) END AS r"


def curved(fit):
    near = lambda c: F.when(C("r") < 1000, F.round(c, 2)).alias(c)
    return fit.select(*BY, "n", F.round(1 / F.when(C("r") > 0, C("r")), 6).alias("curvature"), near("a"), near("b"), near("r"))


@query(f"SELECT event_id, track_id, n, {CURVED} FROM ({circle_sql('hyper')})", "f_points", {"moments": MOMENTS})
def circle_hyper(v):
    return curved(fits.circle(points(v), BY, "hyper"))


@query(f"SELECT event_id, track_id, n, {CURVED} FROM ({circle_sql('pratt')})", "f_points", {"moments": MOMENTS})
def circle_pratt(v):
    return curved(fits.circle(points(v), BY, "pratt"))


@query(f"SELECT event_id, track_id, n, {CURVED} FROM ({circle_sql('taubin')})", "f_points", {"moments": MOMENTS})
def circle_taubin(v):
    return curved(fits.circle(points(v), BY, "taubin"))


@query()
def circle_lm(v):
    return fits.geometric_circle(points(v), BY)


@query("SELECT event_id, track_id, k, round(u / s, 5) AS u, round(v / s, 5) AS v, round(s, 5) AS scale FROM (SELECT *, sqrt(avg(u * u + v * v) OVER (PARTITION BY event_id, track_id) / 2) AS s FROM (SELECT *, x - avg(x) OVER (PARTITION BY event_id, track_id) AS u, y - avg(y) OVER (PARTITION BY event_id, track_id) AS v FROM f_points))", "f_points")
def centre_scale(v):
    return rounded(fits.centred_scaled(points(v), BY).select(*BY, "k", "u", "v", "scale"), ["u", "v", "scale"])


@query("SELECT evt, line, round(0.3 * 2 * radius * 0.01, 6) AS pt, round(0.3 * radius * 1e-2 * 2, 6) AS pt_from_curvature FROM f_scores", "f_scores")
def pt_from_radius(v):
    r = C("radius")
    return v("f_scores").select("evt", "line", F.round(fits.pt_from_radius(r), 6).alias("pt"), F.round(fits.pt_from_radius(1 / r, curvature=True), 6).alias("pt_from_curvature"))


@query()
def isochrone_refit(v):
    return fits.isochrone_refit(shifted(v), BY, many=v("lineitem").count())


@query("SELECT p.event_id, p.track_id, k, CASE WHEN abs(bx) + abs(by_) > 1e-6 THEN round(abs((x - ax) * by_ - (y - ay) * bx) / sqrt(bx * bx + by_ * by_), 4) END AS distance FROM f_points p JOIN (SELECT event_id, track_id, regr_intercept(x, k) AS ax, regr_slope(x, k) AS bx, regr_intercept(y, k) AS ay, regr_slope(y, k) AS by_ FROM f_points GROUP BY ALL) f ON p.event_id = f.event_id AND p.track_id = f.track_id", "f_points")
def point_line_fit_dist(v):
    x = fits.linear_fit(points(v), BY, "k", "x").select(*BY, C("intercept").alias("ax"), C("slope").alias("bx"))
    y = fits.linear_fit(points(v), BY, "k", "y").select(*BY, C("intercept").alias("ay"), C("slope").alias("by"))
    both = points(v).join(x, BY).join(y, BY)
    away = fits.distance_to_line(C("x"), C("y"), C("ax"), C("bx"), C("ay"), C("by"))
    return both.select(*BY, "k", F.when(F.expr("abs(bx) + abs(by) > 1e-6"), F.round(away, 4)).alias("distance"))


def _solved(axis: str) -> str:
    """Coefficients of axis = c0 + c1 k + c2 k2 by track."""
    sums = SUMS.replace("u * x)", f"u * {axis})").replace("sum(x)", f"sum({axis})")
    return f"SELECT event_id, track_id, a0 - a1 * mx + a2 * mx * mx AS {axis}0, a1 - 2 * a2 * mx AS {axis}1, a2 AS {axis}2 FROM ({SOLVED.replace('FROM sums', f'FROM ({sums})')})"


#: The distance from a point to the curve: the square's least value is between the roots of its slope's slope or beyond them, so halving finds it in each stretch.
HALVED = "list_reduce(list_prepend([lo, hi], list_transform(range(100), lambda i: [lo, hi])), lambda g, i: CASE WHEN c0 + (g[1] + g[2]) / 2 * (c1 + (g[1] + g[2]) / 2 * (c2 + (g[1] + g[2]) / 2 * c3)) < 0 THEN [(g[1] + g[2]) / 2, g[2]] ELSE [g[1], (g[1] + g[2]) / 2] END)[1]"
NEAREST = f"""SELECT event_id, track_id, k, round(min(sqrt((x0 + t * (x1 + t * x2) - px) ** 2 + (y0 + t * (y1 + t * y2) - py) ** 2)), 3) AS distance FROM (SELECT *, CASE WHEN c3 > 1e-12 THEN {HALVED} WHEN c1 > 1e-12 THEN -c0 / c1 END AS t FROM (
  SELECT *, unnest(CASE WHEN c3 > 1e-12 THEN [turn - reach, turn - bend, turn + bend] ELSE [0] END) AS lo, unnest(CASE WHEN c3 > 1e-12 THEN [turn - bend, turn + bend, turn + reach] ELSE [0] END) AS hi FROM (
  SELECT *, -c2 / (3 * c3) AS turn, sqrt(greatest(c2 * c2 - 3 * c3 * c1, 0)) / (3 * c3) AS bend, 2 + 2 * (abs(c2) + abs(c1) + abs(c0)) / c3 AS reach FROM (
  SELECT *, 2 * (x2 * x2 + y2 * y2) AS c3, 3 * (x1 * x2 + y1 * y2) AS c2, x1 * x1 + y1 * y1 + 2 * (x2 * (x0 - px) + y2 * (y0 - py)) AS c1, x1 * (x0 - px) + y1 * (y0 - py) AS c0 FROM (
  SELECT p.event_id, p.track_id, p.k, p.x AS px, p.y AS py, x0, x1, x2, y0, y1, y2 FROM f_points p JOIN xs ON p.event_id = xs.event_id AND p.track_id = xs.track_id JOIN ys ON p.event_id = ys.event_id AND p.track_id = ys.track_id))))) GROUP BY ALL"""


@query(NEAREST, "f_points", {"xs": _solved("x"), "ys": _solved("y")})
def point_quad_fit_dist(v):
    name = lambda a: [C("c0").alias(f"{a}0"), C("c1").alias(f"{a}1"), C("c2").alias(f"{a}2")]
    x = fits.quadratic_fit(points(v), BY, "k", "x").select(*BY, *name("x"))
    y = fits.quadratic_fit(points(v), BY, "k", "y").select(*BY, *name("y"))
    rows = points(v).select(*BY, "k", C("x").alias("px"), C("y").alias("py")).join(x, BY).join(y, BY)
    return rounded(fits.distance_to_curve(rows).select(*BY, "k", "distance"), ["distance"], 3)
