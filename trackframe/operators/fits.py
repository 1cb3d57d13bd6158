"""Fits of lines, parabolas and circles to grouped points, from moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions.shared import stored

C = F.col


def linear_fit(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, intercept, slope) of least squares; null slopes where x does not vary."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))


def quadratic_fit(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, c0, c1, c2) of the least-squares parabola, by Cramer's rule on power sums about the mean of x."""
    centre = points.groupBy(*by).agg(F.avg(x).alias("mx"))
    u = (C(x) - C("mx")).alias("u")
    own = points.join(centre, by).select(*by, "mx", u, C(y).alias("v"))
    sums = own.groupBy(*by, "mx").agg(
        F.count("*").alias("n"), *(F.sum(F.pow("u", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)),
        *(F.sum(F.pow("u", F.lit(k)) * C("v")).alias(f"t{k}") for k in (0, 1, 2)),
    )
    s0, s1, s2, s3, s4, t0, t1, t2 = (C(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det3 = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    whole = det3(s0, s1, s2, s1, s2, s3, s2, s3, s4)
    d = F.when(F.abs(whole) > 1e-9, whole)
    fit = sums.withColumns({
        "a0": det3(t0, s1, s2, t1, s2, s3, t2, s3, s4) / d, "a1": det3(s0, t0, s2, s1, t1, s3, s2, t2, s4) / d, "a2": det3(s0, s1, t0, s1, s2, t1, s2, s3, t2) / d,
    })
    m = C("mx")
    return fit.select(*by, "n", (C("a0") - C("a1") * m + C("a2") * m * m).alias("c0"), (C("a1") - 2 * C("a2") * m).alias("c1"), C("a2").alias("c2"))


def moments(points: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by, n, mean_x, mean_y, mxx, myy, mxy, mxz, myz, mzz): mean products of centred x, y and z = x2 + y2."""
    mean = points.groupBy(*by).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))
    own = points.join(mean, by).select(*by, "mean_x", "mean_y", (C(x) - C("mean_x")).alias("u"), (C(y) - C("mean_y")).alias("v"))
    own = own.withColumn("w", C("u") * C("u") + C("v") * C("v"))
    pairs = {"mxx": "uu", "myy": "vv", "mxy": "uv", "mxz": "uw", "myz": "vw", "mzz": "ww"}
    return own.groupBy(*by, "mean_x", "mean_y").agg(F.count("*").alias("n"), *(F.avg(C(p[0]) * C(p[1])).alias(name) for name, p in pairs.items()))


def kasa(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, a, b, r) of the algebraic circle fit in closed form; null for points on a line."""
    m = moments(points, by)
    det = C("mxx") * C("myy") - C("mxy") * C("mxy")
    d = 2 * F.when(det > 1e-9, det)
    fit = m.withColumns({"u": (C("mxz") * C("myy") - C("myz") * C("mxy")) / d, "v": (C("myz") * C("mxx") - C("mxz") * C("mxy")) / d})
    r = F.sqrt(C("u") * C("u") + C("v") * C("v") + C("mxx") + C("myy"))
    return fit.select(*by, "n", (C("u") + C("mean_x")).alias("a"), (C("v") + C("mean_y")).alias("b"), r.alias("r"))


#: For each kind: coefficients of x2, x3 and x4 in the characteristic polynomial beyond the terms that all share, its steps, and the radius' share of the root.
_KINDS = {
    "hyper": ("4 * cov - 3 * mz * mz - mzz", "0D", "4D", 20, -2),
    "pratt": ("4 * cov - 3 * mz * mz - mzz", "0D", "4D", 20, 2),
    "taubin": ("-3 * mz * mz - mzz", "4 * mz", "0D", 20, 0),
}


def newton_circle(m: DataFrame, by: list[str], kind: str = "hyper") -> DataFrame:
    """moments -> (by, n, a, b, r) of the Hyper, Pratt or Taubin circle fit.

    The root of the characteristic polynomial next to zero is found by
    Newton's steps in one fold, which stand still once they do no better (after
    four to six as a rule; twenty are allowed).  Points on a line, as two are,
    have no circle: there the polynomial is rounding alone.
    """
    second, third, fourth, steps, share = _KINDS[kind]
    m = m.withColumns({"mz": C("mxx") + C("myy"), "cov": C("mxx") * C("myy") - C("mxy") * C("mxy")})
    m = m.withColumn("var", C("mzz") - C("mz") * C("mz"))
    m = m.withColumns({
        "p0": F.expr("mxz * (mxz * myy - myz * mxy) + myz * (myz * mxx - mxz * mxy) - var * cov"),
        "p1": F.expr("var * mz + 4 * cov * mz - mxz * mxz - myz * myz"), "p2": F.expr(second), "p3": F.expr(third), "p4": F.expr(fourth),
    })
    # Stored, as the planner would else write the coefficients out within every step of the fold.
    m = stored(m, "moments")
    value = "p0 + {0} * (p1 + {0} * (p2 + {0} * (p3 + {0} * p4)))"
    slope = "(p1 + s.x * (2 * p2 + s.x * (3 * p3 + s.x * 4 * p4)))"
    # A step is taken if the polynomial is nearer to zero there; else the fold is done.
    fold = f"""aggregate(sequence(1, {steps}), named_struct('x', 0D, 'y', p0, 'next', try_divide(-p0, p1), 'done', p1 = 0),
      (s, i) -> CASE WHEN s.done OR s.next IS NULL OR abs({value.format('s.next')}) >= abs(s.y) THEN named_struct('x', s.x, 'y', s.y, 'next', s.next, 'done', true)
        ELSE named_struct('x', s.next, 'y', {value.format('s.next')}, 'next', s.next - try_divide({value.format('s.next')}, {slope.replace('s.x', 's.next')}), 'done', false) END, s -> s.x)"""
    m = m.withColumn("root", F.expr(fold))
    m = m.withColumn("det", F.expr("root * root - root * mz + cov"))
    d = 2 * F.when((F.abs("det") > 1e-12) & (C("cov") > 1e-12 * C("mz") * C("mz")), C("det"))
    m = m.withColumns({"u": F.expr("mxz * (myy - root) - myz * mxy") / d, "v": F.expr("myz * (mxx - root) - mxz * mxy") / d})
    r = F.sqrt(C("u") * C("u") + C("v") * C("v") + C("mz") + share * C("root"))
    return m.select(*by, "n", (C("u") + C("mean_x")).alias("a"), (C("v") + C("mean_y")).alias("b"), r.alias("r"))


def circle(points: DataFrame, by: list[str], kind: str = "hyper") -> DataFrame:
    """points -> (by, n, a, b, r) of a circle fit."""
    return kasa(points, by) if kind == "kasa" else newton_circle(moments(points, by), by, kind)


def circle_sigma(points: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """(by, sigma): root mean square of the radial residuals."""
    off = F.hypot(C("x") - C("a"), C("y") - C("b")) - C("r")
    return points.join(fits.select(*by, "a", "b", "r"), by).groupBy(*by).agg(F.sqrt(F.avg(off * off)).alias("sigma"))


def _least_distance(g: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int, close: float, farthest: float) -> tuple[np.ndarray, ...]:
    """Circles of least distance to the points of groups 0, 1, ... (g), all at once: n, a, b, r, sigma, code.

    A group whose equations have no solution, as those of a far circle where
    the damping has become too small to count, takes no step but more damping.
    """
    count = int(g[-1]) + 1
    total = lambda v: np.bincount(g, v, count)
    n = total(np.ones(len(g)))
    mx, my = total(x) / n, total(y) / n
    u, v = x - mx[g], y - my[g]
    w = u * u + v * v
    xx, yy, xy, xz, yz = (total(t) / n for t in (u * u, v * v, u * v, u * w, v * w))
    det = xx * yy - xy * xy
    code = np.where(det > 1e-9, 1, 3)
    det = np.where(det > 1e-9, det, 1.0)
    a, b = (xz * yy - yz * xy) / 2 / det, (yz * xx - xz * xy) / 2 / det
    p = np.stack([a, b, np.sqrt(a * a + b * b + xx + yy)], axis=1)
    code = np.where(p[:, 2] > farthest, 3, code)

    def residuals(p: np.ndarray) -> tuple[np.ndarray, ...]:
        du, dv = u - p[g, 0], v - p[g, 1]
        d = np.hypot(du, dv)
        d = np.where(d > 0, d, 1.0)
        return np.stack([-du / d, -dv / d, -np.ones(len(g))], axis=1), np.hypot(du, dv) - p[g, 2]

    slope, e = residuals(p)
    cost = total(e * e)
    damp = np.full(count, 0.01)
    for _ in range(rounds):
        if not (code == 1).any():
            break
        normal = np.empty((count, 3, 3))
        for i in range(3):
            for j in range(3):
                normal[:, i, j] = total(slope[:, i] * slope[:, j])
        right = np.stack([total(slope[:, i] * e) for i in range(3)], axis=1)
        normal[:, range(3), range(3)] = normal[:, range(3), range(3)] * (1 + damp)[:, None] + 1e-15
        regular = np.linalg.det(normal) != 0
        step = np.zeros_like(p)
        step[regular] = -np.linalg.solve(normal[regular], right[regular, :, None])[:, :, 0]
        tried = p + step
        other, f = residuals(tried)
        better = (code == 1) & (total(f * f) < cost) & (tried[:, 2] > 0)
        code = np.where((code == 1) & regular & (np.abs(step).sum(axis=1) < close * (1 + np.abs(p[:, 2]))), 0, code)
        code = np.where((code == 1) & ~better & (damp > 1e8), 2, code)
        p = np.where(better[:, None], tried, p)
        slope, e = np.where(better[g][:, None], other, slope), np.where(better[g], f, e)
        cost = total(e * e)
        damp = np.where(better, damp / 10, damp * 10)
    return n.astype(np.int64), p[:, 0] + mx, p[:, 1] + my, p[:, 2], np.sqrt(cost / n), code


def geometric_circle(points: DataFrame, by: list[str], rounds: int = 50, close: float = 1e-8, farthest: float = 1e6) -> DataFrame:
    """(by, n, a, b, r, sigma, code): circles of least distance, by damped steps from the algebraic fit.

    ``by`` are columns of integers.  The points are dealt by group and sorted,
    and the groups of an Arrow batch take their steps together.  Code 0:
    converged, 1: rounds used up, 2: no step helps any more, 3: no circle
    (points on a line, or a radius beyond ``farthest``).
    """

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray) -> pa.RecordBatch:
            keys = rows[:, : len(by)].astype(np.int64)
            new = np.r_[False, (keys[1:] != keys[:-1]).any(axis=1)]
            n, a, b, r, sigma, code = _least_distance(np.cumsum(new), rows[:, -2], rows[:, -1], rounds, close, farthest)
            first = keys[np.flatnonzero(np.r_[True, new[1:]])]
            columns = [*first.T, n, a, b, r, sigma, code]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*by, "n", "a", "b", "r", "sigma", "code"])

        held = np.empty((0, len(by) + 2))
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)])
            last = (held[:, : len(by)] == held[-1, : len(by)]).all(axis=1)
            cut = int(np.argmax(last))  # the last group may go on in the next batch
            if cut:
                yield out(held[:cut])
                held = held[cut:]
        if len(held):
            yield out(held)

    ddl = ", ".join([*(f"{c} long" for c in by), "n long, a double, b double, r double, sigma double, code long"])
    return points.select(*by, "x", "y").repartition(*by).sortWithinPartitions(*by).mapInArrow(fitted, ddl)


def centred_scaled(points: DataFrame, by: list[str]) -> DataFrame:
    """Points moved to their group's mean and divided by the root of half the mean square."""
    w = Window.partitionBy(*by)
    own = points.withColumns({"u": C("x") - F.avg("x").over(w), "v": C("y") - F.avg("y").over(w)})
    scale = F.sqrt(F.avg(C("u") * C("u") + C("v") * C("v")).over(w) / 2)
    own = own.withColumn("scale", scale)
    s = F.when(C("scale") > 0, C("scale"))
    return own.withColumns({"u": C("u") / s, "v": C("v") / s})


def pt_from_radius(r: Column, curvature: bool = False) -> Column:
    """Transverse momentum from a radius in cm, or from a curvature."""
    return 0.3 * (1 / r) * 1e-2 * 2 if curvature else 0.3 * 2 * r * 0.01


def displaced(points: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """Every point in ``draws`` copies, each moved on its drift circle by an angle from a hash of (seed, draw, point)."""
    drawn = points.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    turn = F.pmod(F.xxhash64(F.lit(seed), "draw", "event_id", "track_id", "k"), F.lit(1 << 20)) / F.lit(float(1 << 20)) * 2 * F.pi()
    return drawn.withColumn("turn", turn).withColumns({"x": C("x") + C("isochrone") * F.cos("turn"), "y": C("y") + C("isochrone") * F.sin("turn")}).drop("turn")


def moments_about(points: DataFrame, by: list[str], cx: str, cy: str) -> DataFrame:
    """The moments of centred points in one grouping: sums about a given point of the group, then moved to the mean."""
    own = points.withColumns({"u": C("x") - C(cx), "v": C("y") - C(cy)}).withColumn("z", C("u") * C("u") + C("v") * C("v"))
    names = {"eu": "u", "ev": "v", "ez": "z", "euu": "u * u", "evv": "v * v", "euv": "u * v", "euz": "u * z", "evz": "v * z", "ezz": "z * z"}
    sums = own.groupBy(*by).agg(F.count("*").alias("n"), F.first(cx).alias("cx"), F.first(cy).alias("cy"), *(F.expr(f"avg({e})").alias(k) for k, e in names.items()))
    sums = sums.withColumns({"a": 2 * C("eu"), "b": 2 * C("ev"), "c": C("eu") * C("eu") + C("ev") * C("ev")})
    sums = sums.withColumn("mz", C("ez") - C("a") * C("eu") - C("b") * C("ev") + C("c"))
    return sums.select(
        *by, "n", (C("cx") + C("eu")).alias("mean_x"), (C("cy") + C("ev")).alias("mean_y"),
        F.expr("euu - eu * eu").alias("mxx"), F.expr("evv - ev * ev").alias("myy"), F.expr("euv - eu * ev").alias("mxy"),
        F.expr("euz - a * euu - b * euv + c * eu - eu * mz").alias("mxz"), F.expr("evz - a * euv - b * evv + c * ev - ev * mz").alias("myz"),
        F.expr("ezz + a * a * euu + b * b * evv + c * c - 2 * a * euz - 2 * b * evz + 2 * c * ez + 2 * a * b * euv - 2 * a * c * eu - 2 * b * c * ev").alias("mzz"),
    )


def _hyper_radii(m: dict[str, np.ndarray], steps: int = 20) -> np.ndarray:
    """Radii of the Hyper fit as ``newton_circle`` tells them, of many moments at once; masked where there is no circle."""
    xx, yy, xy, xz, yz, zz = (m[c] for c in ("mxx", "myy", "mxy", "mxz", "myz", "mzz"))
    mz, cov = xx + yy, xx * yy - xy * xy
    var = zz - mz * mz
    p0 = xz * (xz * yy - yz * xy) + yz * (yz * xx - xz * xy) - var * cov
    p1 = var * mz + 4 * cov * mz - xz * xz - yz * yz
    p2 = 4 * cov - 3 * mz * mz - zz
    x, y, done = np.zeros_like(p0), p0, p1 == 0
    with np.errstate(all="ignore"):
        further = -p0 / p1
        for _ in range(steps):
            value = p0 + further * (p1 + further * (p2 + further * (further * 4)))
            done = done | ~(np.abs(value) < np.abs(y))
            if done.all():
                break
            slope = p1 + further * (2 * p2 + further * (further * 4 * 4))
            x, y = np.where(done, x, further), np.where(done, y, value)
            further = further - value / slope
            done = done | (slope == 0)
        det = x * x - x * mz + cov
        u, v = (xz * (yy - x) - yz * xy) / (2 * det), (yz * (xx - x) - xz * xy) / (2 * det)
        r = np.sqrt(u * u + v * v + mz - 2 * x)
    return np.ma.array(r, mask=~((np.abs(det) > 1e-12) & (cov > 1e-12 * mz * mz)))


#: Drawn points that one task of ``isochrone_refit`` sums up.
ONE_DRAWN = 2_500_000


def isochrone_refit(points: DataFrame, by: list[str], draws: int = 100, many: int | None = None) -> DataFrame:
    """(by, n, r16, r50, r84): sorted elements of the radii of Hyper fits to displaced points.

    The points are dealt by group before they are multiplied, so the draws of
    a group meet without another shuffle; ``many`` points or so go to tasks of
    ``ONE_DRAWN`` drawn ones, whose sums are held in memory.  The fits of a
    group's draws are made side by side, so none of them is written.
    """
    w, tasks = Window.partitionBy(*by), -(-(many or 0) * draws // ONE_DRAWN)
    own = points.repartition(tasks, *by) if tasks else points.repartition(*by)
    sums = moments_about(displaced(own.withColumns({"cx": F.avg("x").over(w), "cy": F.avg("y").over(w)}), draws), [*by, "draw"], "cx", "cy")
    names = ("mxx", "myy", "mxy", "mxz", "myz", "mzz")
    sets = sums.groupBy(*by).agg(F.collect_list(F.struct("n", *names)).alias("m"))
    at = ("r16", 0.16), ("r50", 0.5), ("r84", 0.84)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, m = batch["m"].value_lengths().to_numpy(), batch["m"].flatten()
            m = {f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(m.type, m.flatten())}
            r, g = _hyper_radii(m), np.repeat(np.arange(len(size)), size)
            count = np.bincount(g[~r.mask], minlength=len(size))
            order = np.lexsort((r.data, r.mask, g))
            some = np.flatnonzero(count)
            first, count = (np.cumsum(size) - size)[some], count[some]
            n = np.zeros(len(size), np.int64)
            np.maximum.at(n, g[~r.mask], m["n"][~r.mask])
            found = [r.data[order[first + np.minimum(count - 1, np.floor(count * share).astype(np.int64))]] for _, share in at]
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(some)) for c in by), pa.array(n[some]), *(pa.array(c) for c in found)], names=[*by, "n", *(c for c, _ in at)])

    return sets.mapInArrow(fitted, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in sets.schema if f.name in by), "n long", *(f"{c} double" for c, _ in at)]))


def distance_to_line(px: Column, py: Column, ax: Column, bx: Column, ay: Column, by: Column) -> Column:
    """Distance of a point to the line (ax + bx t, ay + by t)."""
    return F.abs((px - ax) * by - (py - ay) * bx) / F.sqrt(bx * bx + by * by)


def distance_to_curve(rows: DataFrame) -> DataFrame:
    """Rows with the distance of (px, py) to (x0 + x1 t + x2 t2, y0 + y1 t + y2 t2).

    The derivative of the squared distance is a cubic in t; its real roots are
    found in closed form (by cosines where there are three), and the nearest
    counts.  A curve without a square term is a line.
    """
    rows = rows.withColumns({
        "c3": 2 * (C("x2") * C("x2") + C("y2") * C("y2")), "c2": 3 * (C("x1") * C("x2") + C("y1") * C("y2")),
        "c1": C("x1") * C("x1") + C("y1") * C("y1") + 2 * (C("x2") * (C("x0") - C("px")) + C("y2") * (C("y0") - C("py"))),
        "c0": C("x1") * (C("x0") - C("px")) + C("y1") * (C("y0") - C("py")),
    })
    c3 = F.when(C("c3") > 1e-12, C("c3"))
    rows = rows.withColumns({"m": C("c2") / (3 * c3), "q1": C("c1") / c3, "q0": C("c0") / c3})
    rows = rows.withColumns({"p": C("q1") - 3 * C("m") * C("m"), "q": 2 * C("m") * C("m") * C("m") - C("m") * C("q1") + C("q0")})
    rows = rows.withColumn("disc", C("q") * C("q") / 4 + C("p") * C("p") * C("p") / 27)
    one = F.cbrt(-C("q") / 2 + F.sqrt("disc")) + F.cbrt(-C("q") / 2 - F.sqrt("disc"))
    size = 2 * F.sqrt(-C("p") / 3)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 3 * C("q") / (C("p") * size)))) / 3
    three = F.array(*(size * F.cos(angle - 2 * F.pi() * k / 3) - C("m") for k in range(3)))
    slope = F.when(C("c1") > 1e-12, C("c1"))
    roots = F.when(C("m").isNull(), F.array(-C("c0") / slope)).when(C("disc") >= 0, F.array(one - C("m"))).otherwise(three)
    rows = rows.withColumn("roots", roots)
    away = F.transform("roots", lambda t: F.hypot(C("x0") + t * (C("x1") + t * C("x2")) - C("px"), C("y0") + t * (C("y1") + t * C("y2")) - C("py")))
    return rows.withColumn("distance", F.array_min(away)).drop("c3", "c2", "c1", "c0", "m", "q1", "q0", "p", "q", "disc", "roots")
