"""Geometry of tubes, lines and track points as column expressions.

A tube is named by a prefix: columns <p>x, <p>y, <p>z, <p>half_length, <p>dx,
<p>dy and <p>dz.  Nothing here leaves whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.functions.shared import stored

#: Half a right angle of half a turn, as the turning angle is told in: degrees with 3.14 for pi (a fixed value).
ROUGH_PI = 3.14
TINY = 2.220446049250313e-16


def tube_ends(p: str, wide: float = 0.0) -> tuple[list[Column], list[Column]]:
    """Both ends of a tube; x and y are moved out by ``wide``."""
    near, far = [], []
    for axis in "xyz":
        reach = F.col(f"{p}half_length") * F.col(f"{p}d{axis}")
        out = 0.0 if axis == "z" else wide
        near.append(F.col(f"{p}{axis}") - reach - out)
        far.append(F.col(f"{p}{axis}") + reach + out)
    return near, far


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def with_closest_points(pairs: DataFrame, p: str, q: str, wide: float = 0.0) -> DataFrame:
    """Pairs of tubes with the closest points of their segments, as px, py, pz, qx, qy and qz.

    The unbounded optimum is clamped on the first segment, the second follows
    from it and is clamped, and the first follows from that.  Each step is a
    projection of its own, so no expression is written out twice.
    """
    kept = pairs.columns
    (p0, p1), (q0, q1) = tube_ends(p, wide), tube_ends(q, wide)
    ends = {f"_{k}{i}": c for k, own in (("p", p0), ("q", q0), ("u", p1), ("v", q1)) for i, c in enumerate(own)}
    steps = pairs.withColumns(ends)
    at = lambda k: [F.col(f"_{k}{i}") for i in range(3)]
    steps = steps.withColumns({f"_{k}{i}": a - b for k, x, y in (("u", "u", "p"), ("v", "v", "q"), ("w", "p", "q")) for i, (a, b) in enumerate(zip(at(x), at(y)))})
    steps = steps.withColumns({f"_{k}{n}": _dot(at(k), at(n)) for k, n in ("uu", "uv", "vv", "uw", "vw")})
    uu, uv, vv, uw, vw = (F.col(f"_{n}") for n in ("uu", "uv", "vv", "uw", "vw"))
    steps = steps.withColumn("_det", uu * vv - uv * uv)
    flat = F.col("_det") < TINY
    steps = steps.withColumn("_s", F.when(flat, 0.0).otherwise(_clamp((uv * vw - vv * uw) / F.when(flat, 1.0).otherwise(F.col("_det")))))
    steps = steps.withColumn("_t", (uv * F.col("_s") + vw) / vv)
    t = F.col("_t")
    steps = steps.withColumns({"_s": F.when(t < 0, _clamp(-uw / uu)).when(t > 1, _clamp((uv - uw) / uu)).otherwise(F.col("_s")), "_t": _clamp(t)})
    points = [F.col(f"_p{i}") + F.col("_s") * F.col(f"_u{i}") for i in range(3)] + [F.col(f"_q{i}") + F.col("_t") * F.col(f"_v{i}") for i in range(3)]
    return steps.select(*kept, *(c.alias(n) for c, n in zip(points, ("px", "py", "pz", "qx", "qy", "qz"))))


def with_segment_distance(pairs: DataFrame, p: str, q: str) -> DataFrame:
    """Pairs of tubes with the distance of their segments."""
    d = [F.col(f"p{c}") - F.col(f"q{c}") for c in "xyz"]
    return with_closest_points(pairs, p, q).withColumn("distance", F.sqrt(_dot(d, d))).drop("px", "py", "pz", "qx", "qy", "qz")


def bend_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Signed angle in degrees at b between the ways to a and to c."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    return F.atan2(ux * vy - uy * vx, ux * vx + uy * vy) * 180 / F.lit(3.14159265)


def turn_angle(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Signed turn in (rough) degrees from one step to another."""
    return F.atan2(ux * vy - uy * vx, ux * vx + uy * vy) * 180 / F.lit(ROUGH_PI)


def curvature3(x1, y1, x2, y2, x3, y3, parity: bool = False) -> Column:
    """Area of the triangle over the product of its sides; ``parity`` has x2 where the area formula wants x3."""
    l1, l2, l3 = F.hypot(x1 - x2, y1 - y2), F.hypot(x2 - x3, y2 - y3), F.hypot(x3 - x1, y3 - y1)
    area = F.abs(x1 * (y2 - y3) + x2 * (y3 - y1) + (x2 if parity else x3) * (y1 - y2)) / 2
    sides = l1 * l2 * l3
    return area / F.when(sides != 0, sides)


def line_meets_tube(x1: Column, y1: Column, x2: Column, y2: Column, p: str) -> tuple[Column, Column, Column]:
    """Where the line through two points meets a tube's line in x and y, and the height there by the share of y; null if parallel."""
    near, far = tube_ends(p)
    ux, uy, vx, vy = x1 - x2, y1 - y2, near[0] - far[0], near[1] - far[1]
    cross = ux * vy - uy * vx
    det = F.when(cross != 0, cross)
    a, b = x1 * y2 - y1 * x2, near[0] * far[1] - near[1] * far[0]
    x, y = (a * vx - ux * b) / det, (a * vy - uy * b) / det
    return x, y, height_on_tube(y, p)


def height_on_tube(y: Column, p: str) -> Column:
    """The height on a tube's wire at a given y; null for a wire without a slope in y."""
    near, _ = tube_ends(p)
    dy = F.col(f"{p}dy")
    return near[2] + F.col(f"{p}dz") * (y - near[1]) / F.when(dy != 0, dy)


def on_tube(x: Column, y: Column, p: str) -> Column:
    """Whether a point of a tube's line lies on the tube, up to 1 in the sum of its distances to the ends."""
    near, far = tube_ends(p)
    ways = F.hypot(x - near[0], y - near[1]) + F.hypot(x - far[0], y - far[1])
    return ways <= F.hypot(far[0] - near[0], far[1] - near[1]) + 1


def strictly_met(x1: Column, y1: Column, x2: Column, y2: Column, tube: Column) -> Column:
    """Where the line through two points meets the tube of a struct, as struct(on, x, y, z): ``on`` is false where they are parallel or meet over 1 off the tube's ends."""
    reach = lambda c: tube["half_length"] * tube[f"d{c}"]
    ends = F.struct(*((tube[c] - reach(c)).alias(f"{c}3") for c in "xyz"), *((tube[c] + reach(c)).alias(f"{c}4") for c in "xy"))

    def met(e: Column) -> Column:
        cross = (x1 - x2) * (e.y3 - e.y4) - (y1 - y2) * (e.x3 - e.x4)
        det, a, b = F.when(cross != 0, cross), x1 * y2 - y1 * x2, e.x3 * e.y4 - e.y3 * e.x4
        return F.struct(((a * (e.x3 - e.x4) - (x1 - x2) * b) / det).alias("x"), ((a * (e.y3 - e.y4) - (y1 - y2) * b) / det).alias("y"), e.alias("e"))

    def judged(p: Column) -> Column:
        ways = F.hypot(p.x - p.e.x3, p.y - p.e.y3) + F.hypot(p.x - p.e.x4, p.y - p.e.y4)
        on = F.coalesce(ways <= F.hypot(p.e.x4 - p.e.x3, p.e.y4 - p.e.y3) + 1, F.lit(False))
        z = p.e.z3 + tube["dz"] * (p.y - p.e.y3) / F.when(tube["dy"] != 0, tube["dy"])
        return F.struct(on.alias("on"), p.x.alias("x"), p.y.alias("y"), z.alias("z"))

    one = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    return one(ends, lambda e: one(met(e), judged))


def clamped_met(x1: Column, y1: Column, x2: Column, y2: Column, tube: Column) -> Column:
    """As strictly_met, as struct(x, y, z): the nearer end of the tube where the point is off it, its centre at height 0 where they are parallel."""
    one = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    reach = lambda c: tube["half_length"] * tube[f"d{c}"]

    def placed(p: Column) -> Column:
        near, far = [tube[c] - reach(c) for c in "xyz"], [tube[c] + reach(c) for c in "xyz"]
        first = F.hypot(p.x - near[0], p.y - near[1]) < F.hypot(p.x - far[0], p.y - far[1])
        at = [F.when(p.x.isNull(), tube[c]).when(p.on, p[c]).when(first, near[k]).otherwise(far[k]) for k, c in enumerate("xy")]
        height = lambda q: near[2] + tube["dz"] * (q.y - near[1]) / F.when(tube["dy"] != 0, tube["dy"])
        return one(F.struct(at[0].alias("x"), at[1].alias("y")), lambda q: F.struct(q.x.alias("x"), q.y.alias("y"), F.when(p.x.isNull(), 0.0).otherwise(height(q)).alias("z")))

    return one(strictly_met(x1, y1, x2, y2, tube), placed)


def with_clamped(rows: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, p: str) -> DataFrame:
    """Rows with cx, cy and cz: as line_meets_tube; the nearer end of the tube where the point is off it, its centre at height 0 where they are parallel."""
    kept = rows.columns
    x, y, _ = line_meets_tube(x1, y1, x2, y2, p)
    near, far = tube_ends(p)
    # Stored, as the planner would else write these expressions out wherever they are used.
    step = stored(rows.withColumns({"_x": x, "_y": y}), "met")
    x, y = F.col("_x"), F.col("_y")
    step = step.withColumns({"_on": on_tube(x, y, p), "_first": F.hypot(x - near[0], y - near[1]) < F.hypot(x - far[0], y - far[1])})
    at = lambda own, n, f, centre: F.when(x.isNull(), centre).when(F.col("_on"), own).when(F.col("_first"), n).otherwise(f)
    step = step.withColumns({"cx": at(x, near[0], far[0], F.col(f"{p}x")), "cy": at(y, near[1], far[1], F.col(f"{p}y"))})
    return step.select(*kept, "cx", "cy", F.when(x.isNull(), 0.0).otherwise(height_on_tube(F.col("cy"), p)).alias("cz"))


def step_direction(now: Column, before: Column, dead: float = 1.0) -> Column:
    """1, -1, or 0 for a step within the dead band."""
    return F.when(now - before > dead, 1).when(now - before < -dead, -1).otherwise(0)


def unwrapped(now: Column, before: Column) -> Column:
    """An angle in degrees moved by a whole turn where it and the one before lie beyond 150 degrees on opposite sides."""
    return F.when((now > 150) & (before < -150), now - 360).when((now < -150) & (before > 150), now + 360).otherwise(now)


def line_angle(dx: Column, dy: Column) -> Column:
    """The angle of a line to the x axis, in [0, pi)."""
    turn = F.atan2(dy, dx)
    folded = F.when(turn < 0, turn + F.pi()).otherwise(turn)
    return F.when(folded >= F.pi(), 0.0).otherwise(folded)
