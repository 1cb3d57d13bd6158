"""Track finding over all events at once: growing, summarising, extending, joining and cleaning of tracklets.

Members are (event_id, track_id, pos, det_id); positions come from the node
table.  Loops advance all tracklets of all events by one step and keep their
state in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.functions.shared import let, stored
from trackframe.operators.graph import VIRTUAL, components

C = F.col
DOWN, SAME, UP = 1, 2, 4
TRACK = ["event_id", "track_id"]


def dealt(rows: DataFrame, tasks: int | None) -> DataFrame:
    """Rows dealt by event over so many tasks, which Spark does not put together again; as they are without a number."""
    return rows.repartition(tasks, "event_id") if tasks else rows


def placed(members: DataFrame, nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Members with layer, sector, type, limits and position of their nodes, dealt by event over ``tasks`` if they are given."""
    return dealt(members.join(nodes.select("det_id", "layer", "sector", "node_type", "layer_limit", "x", "y", "z"), "det_id"), tasks)


def classify_neighbours(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """active edges -> (event_id, src, n_virtual, n_next, n_prev, n_same, mask, complex): kinds of each node's neighbours.

    The mask has 1 for lower, 2 for same and 4 for higher layers; a node with
    all three is complex.  Virtual neighbours count apart.
    """
    layer = nodes.select(C("det_id").alias("src"), C("layer").alias("layer"))
    real = C("dst_type") != VIRTUAL
    kind = F.when(C("dst_layer") > C("layer"), UP).when(C("dst_layer") < C("layer"), DOWN).otherwise(SAME)
    count = lambda c: F.count(F.when(c, 1))
    kinds = found.join(layer, "src").withColumn("kind", F.when(real, kind))
    out = kinds.groupBy("event_id", "src").agg(
        count(~real).alias("n_virtual"), count(C("kind") == UP).alias("n_next"), count(C("kind") == DOWN).alias("n_prev"), count(C("kind") == SAME).alias("n_same"),
        F.coalesce(F.bit_or("kind"), F.lit(0)).cast("long").alias("mask"),
    )
    return out.withColumn("complex", C("mask") > 6)


def all_adjacent(sets: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Sets of nodes (by, det_id) -> (by, n, pairs, adjacent): whether at least n - 1 pairs of them are neighbours."""
    size = sets.groupBy(*by).agg(F.count("*").alias("n"))
    a, b = sets.withColumnRenamed("det_id", "a"), sets.withColumnRenamed("det_id", "b")
    # Only pairs that are edges are made: each node goes to its neighbours, and those are looked up in the set.
    near = a.join(edges.select(C("src").alias("a"), C("dst").alias("b")), "a").filter("a < b").join(b, [*by, "b"])
    pairs = near.groupBy(*by).agg(F.count("*").alias("pairs"))
    return size.join(pairs, by, "left").select(*by, "n", F.coalesce("pairs", F.lit(0)).alias("pairs"), (F.coalesce("pairs", F.lit(0)) >= C("n") - 1).alias("adjacent"))


def prune_frontier(sets: DataFrame, found: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """Sets of nodes (by, det_id) without those that have a same-layer neighbour outside the set, where some but not all have one."""
    layer = nodes.select(C("det_id"), C("layer"))
    foreign = sets.join(layer, "det_id").join(found.select("event_id", C("src").alias("det_id"), "dst", "dst_layer", "dst_type"), ["event_id", "det_id"])
    foreign = foreign.filter(f"dst_layer = layer AND dst_type <> {VIRTUAL}").join(sets.withColumnRenamed("det_id", "dst"), [*by, "dst"], "left_anti")
    marked = sets.join(foreign.select(*by, "det_id").distinct().withColumn("foreign", F.lit(True)), [*by, "det_id"], "left").withColumn("foreign", F.coalesce("foreign", F.lit(False)))
    w = Window.partitionBy(*by)
    marked = marked.withColumns({"all": F.count("*").over(w), "bad": F.count(F.when(C("foreign"), 1)).over(w)})
    return marked.filter("NOT foreign OR bad = all").select(*by, "det_id")


def nearest_virtual(virtual: DataFrame, nodes: DataFrame, active: DataFrame) -> DataFrame:
    """(event_id, prev, virtual): for each fired first parent, the virtual node shared with its nearest fired second parent."""
    at = nodes.select("det_id", "x", "y")
    pairs = virtual.select(C("det_id").alias("virtual"), C("parent_a").alias("prev"), C("parent_b").alias("next"))
    pairs = pairs.join(at.toDF("prev", "ax", "ay"), "prev").join(at.toDF("next", "bx", "by"), "next")
    fired = pairs.join(active.withColumnRenamed("det_id", "prev"), "prev").join(active.withColumnRenamed("det_id", "next"), ["event_id", "next"])
    away = F.round(F.hypot(C("ax") - C("bx"), C("ay") - C("by")), 6)
    return fired.groupBy("event_id", "prev").agg(F.min(F.struct(away.alias("d"), "virtual")).alias("m")).select("event_id", "prev", C("m.virtual").alias("virtual"))


def drop_short(members: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """Members of tracks with at least so many real nodes."""
    real = members.join(nodes.filter(C("node_type") != VIRTUAL).select("det_id"), "det_id", "left_semi")
    kept = real.groupBy(*TRACK).agg(F.count("*").alias("n")).filter(C("n") >= least).select(*TRACK)
    return members.join(kept, TRACK, "left_semi")


def track_summary(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event_id, track_id, length, tail, head, min_layer, max_layer, status): FINISHED where both ends are at a layer limit, else ONGOING."""
    own = placed(members, nodes)
    ends = own.groupBy(*TRACK).agg(
        F.count("*").alias("length"), F.min_by("det_id", "pos").alias("tail"), F.max_by("det_id", "pos").alias("head"), F.min("layer").alias("min_layer"), F.max("layer").alias("max_layer"),
        (F.min_by("layer_limit", "pos") & F.max_by("layer_limit", "pos")).alias("closed"),
    )
    return ends.withColumn("status", F.when(C("closed"), "FINISHED").otherwise("ONGOING")).drop("closed")


def anchors(members: DataFrame, nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """(event_id, track_id, pos, layer, n, x, y, z): one point for each change of layer, nodes of one layer averaged by twos.

    The first two nodes always open an anchor.
    """
    return anchors_of(placed(members, nodes, tasks))


def anchors_of(own: DataFrame) -> DataFrame:
    """As ``anchors``, of members that have layers and positions already."""
    order = Window.partitionBy(*TRACK).orderBy("pos")
    opens = F.when((F.row_number().over(order) <= 2) | (F.lag("layer").over(order) != C("layer")), 1).otherwise(0)
    own = own.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pair = F.floor((F.row_number().over(Window.partitionBy(*TRACK, "run").orderBy("pos")) - 1) / 2)
    grouped = own.withColumn("pair", pair).groupBy(*TRACK, "run", "pair").agg(F.count("*").alias("n"), F.first("layer").alias("layer"), *(F.avg(a).alias(a) for a in "xyz"))
    number = F.row_number().over(Window.partitionBy(*TRACK).orderBy("run", "pair")).cast("long")
    return grouped.select(*TRACK, number.alias("pos"), "layer", "n", "x", "y", "z")


def in_turn(members: DataFrame, nodes: DataFrame, start, step, done):
    """A fold over the nodes of each track in order: (event_id, track_id, s), with ``done`` of the last state."""
    node = F.struct("pos", "det_id", "layer", "node_type", "x", "y", "z", "half_length", "dx", "dy", "dz")
    own = members.join(nodes.select("det_id", "layer", "node_type", "x", "y", "z", "half_length", "dx", "dy", "dz"), "det_id")
    return own.groupBy(*TRACK).agg(F.array_sort(F.collect_list(node)).alias("m")).select(*TRACK, F.aggregate("m", start, step, done).alias("s"))


def anchors_in_turn(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """As ``anchors``, where a skewed node that opens a layer is first moved to where its tube meets the line through the last anchor and the one three before it.

    Those may have been moved themselves, so the nodes of a track are folded
    in order.  A node stays at its tube's centre if there are fewer than four
    anchors, if the line is parallel to its tube or meets it more than 1 off
    its ends.
    """
    point = "struct<layer:bigint,n:bigint,x:double,y:double,z:double>"
    start = F.struct(F.lit(0).cast("long").alias("k"), F.lit(None).cast("long").alias("layer"), F.lit(0).cast("long").alias("run"), F.array().cast(f"array<{point}>").alias("a"))

    def made(layer, n, x, y, z):
        return F.struct(layer.cast("long").alias("layer"), n.cast("long").alias("n"), x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))

    def step(s, m):
        opens = (s.k < 2) | (s.layer != m.layer)
        own = made(m.layer, F.lit(1), m.x, m.y, m.z)
        line = F.struct(F.get(s.a, F.size(s.a) - 1).alias("q"), F.get(s.a, F.size(s.a) - 4).alias("p"))
        at = F.when(opens & (s.k >= 2) & (m.node_type == 2) & (F.size(s.a) > 3), let(line, lambda v: let(G.strictly_met(v.p.x, v.p.y, v.q.x, v.q.y, m), lambda c: F.when(c.on, made(m.layer, F.lit(1), c.x, c.y, F.coalesce(c.z, m.z))).otherwise(own)))).otherwise(own)
        run = F.when(opens, F.lit(0).cast("long")).otherwise(s.run + 1)
        last = F.get(s.a, F.size(s.a) - 1)
        mean = let(last, lambda b: made(m.layer, b.n + 1, (b.x + m.x) / 2, (b.y + m.y) / 2, (b.z + m.z) / 2))
        return let(F.struct(opens.alias("opens"), run.alias("run")), lambda o: F.struct(
            (s.k + 1).alias("k"), m.layer.cast("long").alias("layer"), o.run.alias("run"),
            F.when(o.opens | (o.run % 2 == 0), F.concat(s.a, F.array(at))).otherwise(F.concat(F.slice(s.a, F.lit(1), F.size(s.a) - 1), F.array(mean))).alias("a"),
        ))

    found = in_turn(members, nodes, start, step, lambda s: s.a)
    return found.select(*TRACK, F.posexplode("s").alias("k", "p")).select(*TRACK, (C("k") + 1).cast("long").alias("pos"), "p.layer", "p.n", "p.x", "p.y", "p.z")


def unwrapped_in_turn(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event_id, track_id, pos, det_id, theta): azimuths in degrees, each moved by a whole turn where it and the (moved) one before lie beyond 150 on opposite sides.

    The first two nodes stay as they are.
    """
    start = F.array().cast("array<struct<pos:bigint,det_id:bigint,theta:double>>")

    def step(s, m):
        now, before = F.degrees(F.atan2(m.y, m.x)), F.get(s, F.size(s) - 1).theta
        theta = F.when(F.size(s) < 2, now).otherwise(G.unwrapped(now, before))
        return F.concat(s, F.array(F.struct(m.pos.cast("long").alias("pos"), m.det_id.cast("long").alias("det_id"), theta.alias("theta"))))

    return in_turn(members, nodes, start, step, lambda s: s).select(*TRACK, F.explode("s").alias("p")).select(*TRACK, "p.pos", "p.det_id", "p.theta")


def correct_skew(members: DataFrame, nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Members with corrected cx, cy, cz: skewed nodes between straight ones lie where their tube meets the line between these.

    The line runs from the mean of the last straight layer before to that of
    the first one after; a node between layers that are less than two apart,
    or without one of them, stays at its tube's centre with height 0.
    """
    return skew_corrected(members, nodes, tasks).drop("layer")


def skew_corrected(members: DataFrame, nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """As ``correct_skew``, with the layers."""
    own = dealt(members.join(nodes.select("det_id", "layer", "node_type", "x", "y", "z", "half_length", "dx", "dy", "dz"), "det_id"), tasks)
    # A straight layer's mean stands at its first node, found by a window, so that members are laid out once.
    layer, straight = Window.partitionBy(*TRACK, "layer"), lambda c: F.when(C("node_type") == 1, C(c))
    own = own.withColumns({"at": F.min(straight("pos")).over(layer), "lx": F.avg(straight("x")).over(layer), "ly": F.avg(straight("y")).over(layer)})
    along = Window.partitionBy(*TRACK).orderBy("pos")
    both = own.withColumn("level", F.when(C("pos") == C("at"), F.struct("at", "layer", "lx", "ly"))).withColumns({
        "before": F.last("level", True).over(along.rowsBetween(Window.unboundedPreceding, -1)), "after": F.first("level", True).over(along.rowsBetween(1, Window.unboundedFollowing)),
    })
    both = G.with_clamped(both, C("before.lx"), C("before.ly"), C("after.lx"), C("after.ly"), "")
    usable = (C("node_type") == 2) & C("before").isNotNull() & C("after").isNotNull() & (F.abs(C("before.layer") - C("after.layer")) >= 2)
    return both.select(
        *TRACK, "pos", "det_id", "layer", F.when(usable, C("cx")).otherwise(C("x")).alias("cx"), F.when(usable, C("cy")).otherwise(C("y")).alias("cy"), F.when(usable, C("cz")).otherwise(0.0).alias("cz")
    )


def with_shared_virtuals(members: DataFrame, virtual: DataFrame) -> DataFrame:
    """Members with the virtual node that two neighbours in a track share put between them; positions are numbered anew."""
    order = Window.partitionBy(*TRACK).orderBy("pos")
    own = members.select(*TRACK, "pos", "det_id", F.lag("det_id").over(order).alias("before"))
    pair = virtual.select(C("det_id").alias("between"), F.least("parent_a", "parent_b").alias("a"), F.greatest("parent_a", "parent_b").alias("b"))
    shared = own.join(pair, (F.least("before", "det_id") == C("a")) & (F.greatest("before", "det_id") == C("b"))).select(*TRACK, (2 * C("pos") - 1).alias("place"), C("between").alias("det_id"))
    every = own.select(*TRACK, (2 * C("pos")).alias("place"), "det_id").unionByName(shared)
    return every.select(*TRACK, F.row_number().over(Window.partitionBy(*TRACK).orderBy("place", "det_id")).cast("long").alias("pos"), "det_id")


def correct_islands(members: DataFrame, grid: DataFrame, most: int = 3, too_many: int = 6) -> DataFrame:
    """(event_id, track_id, pos, det_id, cx, cy, cz, fixed): members, virtual nodes among them, with skewed nodes corrected between islands of virtual nodes.

    ``grid`` has real and virtual nodes.  Straight nodes are fixed.  At the
    first real node after an island, V is the mean of its first three nodes.
    If the node before the island is straight, the island's nodes are fixed as
    they are.  Else the line runs from L, the mean of the last fixed nodes
    (those of one layer), to V: the nodes in between, three of a layer, move
    to where their tubes meet it, at their nearer ends if off, and are fixed.
    Where L's and V's layers are under two apart, or over ``too_many`` nodes
    wait, the nodes in between go back to their tubes' centres at height 0,
    and the island's first node is fixed at V.  A track without a fixed node
    stays.  Later islands build on what earlier ones fixed, so the nodes of a
    track are folded in order.
    """
    number = {"pos": "bigint", "det_id": "bigint", "layer": "bigint", "t": "bigint", "w": "bigint"} | dict.fromkeys(("cx", "cy", "cz", "x", "y", "z", "half_length", "dx", "dy", "dz"), "double")
    kind = f"struct<{','.join(f'{n}:{t}' for n, t in number.items())}>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("a"), F.lit(0).alias("p"))
    mean = lambda some, c: F.aggregate(some, F.lit(0.0), lambda s, e: s + e[c], lambda s: s / F.size(some))

    def node(e, **new):
        return F.struct(*(new.get(n, e[n]).cast(t).alias(n) for n, t in number.items()))

    def corrected(a, p):
        """The nodes so far, ended by an island of ``p``, after the correction."""
        base = F.size(a) - p
        island = F.slice(a, base + 1, F.least(p, F.lit(3)))
        places = F.sequence(F.lit(0), base - 1)
        at = lambda k: F.get(a, k)

        def line(j):
            first = F.aggregate(places, F.lit(-1), lambda s, k: F.when((k < j) & (at(k).layer != at(j).layer), k).otherwise(s)) + 1
            return let(F.struct(j.alias("j"), first.alias("first")), lambda f: let(F.struct(
                f.j.alias("j"), F.filter(F.slice(a, f.first + 1, f.j - f.first + 1), lambda e: e.w == 1).alias("fixed"),
                F.size(F.filter(F.slice(a, f.first + 1, base - f.first), lambda e: (e.t != VIRTUAL) & (e.w == 0))).alias("waiting"),
            ), lambda g: F.struct(
                g.j.alias("j"), at(g.j).layer.alias("layer"), mean(g.fixed, "cx").alias("lx"), mean(g.fixed, "cy").alias("ly"), g.waiting.alias("waiting"),
                mean(island, "cx").alias("vx"), mean(island, "cy").alias("vy"), mean(island, "cz").alias("vz"),
            )))

        def moved(g):
            close = (F.abs(g.layer - at(base).layer) < 2) | (g.waiting > too_many)

            def one(e, k):
                between = (k > g.j) & (k < base) & (e.t != VIRTUAL)
                rank = F.size(F.filter(F.slice(a, g.j + 2, F.greatest(k - g.j - 1, F.lit(0))), lambda q: (q.t != VIRTUAL) & (q.layer == e.layer)))
                back = node(e, cx=e.x, cy=e.y, cz=F.lit(0.0), w=F.lit(0))
                onto = let(G.clamped_met(g.lx, g.ly, g.vx, g.vy, e), lambda c: node(e, cx=c.x, cy=c.y, cz=c.z, w=F.lit(1)))
                return F.when(close & between, back).when(close & (k == base), node(e, cx=g.vx, cy=g.vy, cz=g.vz, w=F.lit(1))).when(~close & between & (rank < most), onto).otherwise(node(e))

            return F.transform(a, one)

        marked = F.transform(a, lambda e, k: F.when(k >= base, node(e, w=F.lit(1))).otherwise(node(e)))
        last = F.when(base > 0, F.aggregate(places, F.lit(-1), lambda s, k: F.when(at(k).w == 1, k).otherwise(s))).otherwise(-1)
        return F.when((base <= 0) | (at(base - 1).t == 1), marked).otherwise(let(last, lambda j: F.when(j < 0, a).otherwise(let(line(j), moved))))

    def step(s, m):
        straight = m.node_type == 1
        own = F.struct(*(c.cast(number[n]).alias(n) for n, c in {
            "pos": m.pos, "det_id": m.det_id, "layer": m.layer, "t": m.node_type, "w": F.when(straight, 1).otherwise(0), "cx": m.x, "cy": m.y, "cz": F.when(m.node_type == VIRTUAL, m.z).otherwise(0.0),
        }.items()), *(m[c].cast("double").alias(c) for c in ("x", "y", "z", "half_length", "dx", "dy", "dz")))
        island = m.node_type == VIRTUAL
        before = F.when(island | (s.p == 0), s.a).otherwise(corrected(s.a, s.p))
        return F.struct(F.concat(before, F.array(own)).alias("a"), F.when(island, s.p + 1).otherwise(0).alias("p"))

    found = in_turn(members, grid, start, step, lambda s: s.a).select(*TRACK, F.explode("s").alias("n"))
    return found.select(*TRACK, "n.pos", "n.det_id", "n.cx", "n.cy", "n.cz", (C("n.w") == 1).alias("fixed"))


def fit_next(points: DataFrame, candidates: DataFrame, nodes: DataFrame, farthest: float = 6.0) -> DataFrame:
    """(event_id, track_id, det_id, distance): for each track's head the candidate nearest to where its last three anchors lead.

    x and y are fitted as lines of the length along the anchors and told at
    the candidate's distance from the last one.  A track that went through
    three layers in a row wants the next one, else a node of the same.
    """
    last = Window.partitionBy(*TRACK).orderBy(F.desc("pos"))
    tail = points.withColumn("back", F.row_number().over(last)).filter("back <= 3")
    order = Window.partitionBy(*TRACK).orderBy("pos")
    step = F.coalesce(F.hypot(C("x") - F.lag("x").over(order), C("y") - F.lag("y").over(order)), F.lit(0.0))
    tail = tail.withColumn("step", step).withColumn("p", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fit = tail.groupBy(*TRACK).agg(
        *(f(a, "p").alias(f"{n}{a}") for a in "xy" for f, n in ((F.regr_slope, "m"), (F.regr_intercept, "i"))), F.max("p").alias("p_last"), *(F.max_by(a, "pos").alias(f"last_{a}") for a in "xy"),
        F.max_by("layer", "pos").alias("l1"), F.max(F.when(C("back") == 3, C("layer"))).alias("l3"),
    )
    at = nodes.select("det_id", "layer", C("x").alias("nx"), C("y").alias("ny"))
    own = candidates.join(fit, TRACK).join(at, "det_id")
    away = F.hypot(C("nx") - C("last_x"), C("ny") - C("last_y"))
    own = own.withColumn("at", C("p_last") + away)
    own = own.withColumn("distance", F.round(F.hypot(C("nx") - (C("ix") + C("mx") * C("at")), C("ny") - (C("iy") + C("my") * C("at"))), 5))
    way = C("l1") - C("l3")
    straight = F.coalesce(F.abs(way) == 2, F.lit(False))
    rank = F.when(~straight | (C("layer") == C("l1") + way / 2), 0).when(C("layer") == C("l1"), 1)
    best = own.withColumn("class", rank).filter("class IS NOT NULL AND distance IS NOT NULL").groupBy(*TRACK).agg(F.min(F.struct("class", "distance", "det_id")).alias("b"))
    return best.filter(C("b.distance") < farthest).select(*TRACK, C("b.det_id").alias("det_id"), C("b.distance").alias("distance"))


def head_candidates(members: DataFrame, found: DataFrame) -> DataFrame:
    """(event_id, track_id, det_id): fired neighbours of each track's head outside the track."""
    head = members.groupBy(*TRACK).agg(F.max_by("det_id", "pos").alias("src"))
    near = head.join(found.filter(C("dst_type") != VIRTUAL).select("event_id", "src", C("dst").alias("det_id")), ["event_id", "src"]).select(*TRACK, "det_id")
    return near.join(members.select(*TRACK, "det_id"), [*TRACK, "det_id"], "left_anti")


def propose_from_fit(chosen: DataFrame, members: DataFrame, nodes: DataFrame, least: float = 105.0) -> DataFrame:
    """(event_id, track_a, track_b, det_id, angle): the predicted node is an end of another track, and the way goes on nearly straight there."""
    own = placed(members, nodes)
    order = Window.partitionBy(*TRACK).orderBy("pos")
    ends = own.withColumns({"n": F.count("*").over(Window.partitionBy(*TRACK)), "back": F.lag("x").over(order), "back_y": F.lag("y").over(order), "on": F.lead("x").over(order), "on_y": F.lead("y").over(order)})
    ends = ends.withColumn("k", F.row_number().over(order))
    tail = ends.filter("k = 1 AND n > 1").select("event_id", C("track_id").alias("track_b"), "det_id", "x", "y", C("on").alias("tx"), C("on_y").alias("ty"))
    head = ends.filter("k = n AND n > 1").select("event_id", C("track_id").alias("track_b"), "det_id", "x", "y", C("back").alias("tx"), C("back_y").alias("ty"))
    last = ends.filter("k = n").select("event_id", C("track_id").alias("track_a"), C("x").alias("fx"), C("y").alias("fy"))
    met = chosen.select("event_id", C("track_id").alias("track_a"), "det_id").join(tail.unionByName(head), ["event_id", "det_id"]).filter("track_a <> track_b").join(last, ["event_id", "track_a"])
    met = met.withColumn("angle", F.abs(F.round(G.bend_angle(C("fx"), C("fy"), C("x"), C("y"), C("tx"), C("ty")), 3)))
    return met.filter(C("angle") > least).select("event_id", "track_a", "track_b", "det_id", "angle")


def free_nodes(members: DataFrame, active: DataFrame) -> DataFrame:
    """(event_id, det_id): fired nodes outside all tracks."""
    return active.join(members.select("event_id", "det_id").distinct(), ["event_id", "det_id"], "left_anti").select("event_id", "det_id")


def absorb_same_layer(members: DataFrame, active: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event_id, det_id, track_id): fired nodes outside all tracks join the track of their first same-layer neighbour in one.

    Nodes that were just absorbed absorb in turn, until none is.  A node that
    is still free has no neighbour among those that were there before, so each
    round looks at what the last one absorbed.  Of ``found`` the edges from
    free nodes count.
    """
    layer = nodes.select(C("det_id").alias("src"), C("layer").alias("layer"))
    owned = members.groupBy("event_id", "det_id").agg(F.min("track_id").alias("track_id"))
    free = stored(free_nodes(members, active), "free")
    same = found.join(layer, "src").filter(f"dst_layer = layer AND dst_type <> {VIRTUAL}").select("event_id", C("src").alias("det_id"), C("dst").alias("near"))
    same = stored(same.join(free, ["event_id", "det_id"], "left_semi"), "same")
    absorbed = None
    while True:
        near = same.join(owned.withColumnsRenamed({"det_id": "near", "track_id": "of"}), ["event_id", "near"]).join(free, ["event_id", "det_id"], "left_semi")
        new = stored(near.groupBy("event_id", "det_id").agg(F.min(F.struct("near", "of")).alias("m")).select("event_id", "det_id", C("m.of").alias("track_id")), "absorbed")
        absorbed = new if absorbed is None else absorbed.unionByName(new)
        if new.isEmpty():
            return absorbed
        owned, free = new, stored(free.join(new, ["event_id", "det_id"], "left_anti"), "free")


def leftover_components(members: DataFrame, active: DataFrame, found: DataFrame, more_than: int = 5) -> DataFrame:
    """(event_id, component, det_id): connected components of more than so many fired nodes outside all tracks."""
    free = active.join(members.select("event_id", "det_id").distinct(), ["event_id", "det_id"], "left_anti")
    links = found.filter(C("dst_type") != VIRTUAL).select("event_id", "src", "dst")
    for end in ("src", "dst"):
        links = links.join(free.withColumnRenamed("det_id", end), ["event_id", end], "left_semi")
    labelled = components(free, links)
    large = labelled.groupBy("event_id", "component").agg(F.count("*").alias("n")).filter(C("n") > more_than).select("event_id", "component")
    return labelled.join(large, ["event_id", "component"], "left_semi").select("event_id", "component", "det_id")


#: A track from layer 0 to beyond this one has gone through.
FAR_LAYER = 21


def propose_from_ends(members: DataFrame, nodes: DataFrame, taken: DataFrame | None = None, remaining: DataFrame | None = None, finished: DataFrame | None = None, farthest: float = 6.0, most: int = 5, turn: float = 70.0) -> DataFrame:
    """(event_id, track_a, end_a, track_b, end_b, angle): an unfinished track's end and the first of its nearest other ends that goes on straight.

    Finished tracks neither ask nor are asked: those of ``finished``
    (event_id, track_id), or else those with both ends at a layer limit or
    with layer 0 and one beyond 21.  Ends at a layer limit, in ``taken``
    (links track_a, end_a, track_b, end_b, on either side) or in ``remaining``
    (event_id, track_id, end: neighbours are left there) do not ask.  Of
    another track that end is looked at whose id is nearer.  Sectors may
    differ by one, for heads also by five (over the seam); of the ``most``
    nearest ends those in ``taken`` are passed over.  Ends meet by square
    cells of the largest distance, so an event's number of ends does not count.
    """
    ends = ends_of(members, nodes)
    ends = ends.filter("NOT closed") if finished is None else ends.join(finished.select(*TRACK).distinct(), TRACK, "left_anti")
    key = [*TRACK, "end"]
    if taken is None:
        ends = ends.withColumn("free", F.lit(True))
    else:
        both = taken.select("event_id", C("track_a").alias("track_id"), C("end_a").alias("end")).unionByName(taken.select("event_id", C("track_b").alias("track_id"), C("end_b").alias("end")))
        ends = ends.join(both.distinct().withColumn("busy", F.lit(True)), key, "left").withColumn("free", C("busy").isNull()).drop("busy")
    cell = lambda a: F.floor(C(a) / farthest)
    every = stored(ends.drop("closed").withColumns({"cx": cell("x"), "cy": cell("y")}), "ends")
    asking = every.filter("free AND NOT layer_limit")
    if remaining is not None:
        asking = asking.join(remaining.select(*key), key, "left_anti")
    around = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    a = asking.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).withColumns({"cx": C("cx") + C("dx"), "cy": C("cy") + C("dy")}).drop("dx", "dy")
    a = a.select("event_id", "cx", "cy", *(C(c).alias(f"a_{c}") for c in every.columns if c not in ("event_id", "cx", "cy")))
    b = every.select("event_id", "cx", "cy", *(C(c).alias(f"b_{c}") for c in every.columns if c not in ("event_id", "cx", "cy")))
    away = F.round(F.hypot(C("a_x") - C("b_x"), C("a_y") - C("b_y")), 5)
    apart = F.abs(C("a_sector") - C("b_sector"))
    own, other = F.abs(C("a_det_id") - C("b_det_id")), F.abs(C("a_det_id") - C("b_other_id"))
    nearer = F.when(C("b_end") == "tail", own < other).otherwise(own <= other)
    near = a.join(b, ["event_id", "cx", "cy"]).filter("a_track_id <> b_track_id").filter(nearer).filter((apart <= 1) | ((apart == 5) & (C("a_end") == "head"))).withColumn("away", away).filter(C("away") < farthest)
    first = Window.partitionBy("event_id", "a_track_id", "a_end").orderBy("away", "b_track_id")
    near = near.withColumn("place", F.row_number().over(first)).filter(C("place") <= most)
    near = near.filter("b_free").withColumn("angle", F.abs(F.round(G.turn_angle(C("a_ux"), C("a_uy"), -C("b_ux"), -C("b_uy")), 3))).filter(C("angle") < turn)
    best = near.withColumn("choice", F.row_number().over(first)).filter("choice = 1")
    return best.select("event_id", C("a_track_id").alias("track_a"), C("a_end").alias("end_a"), C("b_track_id").alias("track_b"), C("b_end").alias("end_b"), "angle")


def ends_of(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event_id, track_id, end, det_id, other_id, sector, layer_limit, x, y, ux, uy, closed): both ends of tracks of two nodes or more, the other end's node and the way they point.

    ``closed`` tracks have both ends at a limit, or go from layer 0 to beyond 21.
    """
    point = F.struct("pos", "det_id", "x", "y", "sector", "layer_limit")
    whole = placed(members, nodes).groupBy(*TRACK).agg(F.array_sort(F.collect_list(point)).alias("p"), F.min("layer").alias("low"), F.max("layer").alias("high")).filter(F.size("p") > 1)
    at = lambda k: F.element_at("p", k)
    through = (at(1).layer_limit & at(-1).layer_limit) | ((C("low") == 0) & (C("high") > FAR_LAYER))
    two = whole.select(*TRACK, through.alias("closed"), F.explode(F.array(
        F.struct(F.lit("tail").alias("end"), at(1).alias("e"), at(2).alias("next"), at(-1).det_id.alias("other_id")), F.struct(F.lit("head").alias("end"), at(-1).alias("e"), at(-2).alias("next"), at(1).det_id.alias("other_id")))).alias("s"))
    return two.select(*TRACK, "s.end", "s.e.det_id", "s.other_id", "s.e.sector", "s.e.layer_limit", "s.e.x", "s.e.y", (C("s.e.x") - C("s.next.x")).alias("ux"), (C("s.e.y") - C("s.next.y")).alias("uy"), "closed")


def end_nodes(members: DataFrame) -> DataFrame:
    """(event_id, det_id): first and last nodes of tracks, each once."""
    ends = members.groupBy(*TRACK).agg(F.min_by("det_id", "pos").alias("tail"), F.max_by("det_id", "pos").alias("head"))
    return ends.select("event_id", F.explode(F.array("tail", "head")).alias("det_id")).distinct()


def remaining_ends(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members and active edges -> (event_id, track_id, end): ends with a fired neighbour, virtual ones too, outside their track."""
    last = members.groupBy(*TRACK).agg(F.min_by("det_id", "pos").alias("tail"), F.max_by("det_id", "pos").alias("head"))
    ends = last.select(*TRACK, F.explode(F.array(*(F.struct(F.lit(e).alias("end"), C(e).alias("src")) for e in ("tail", "head")))).alias("e")).select(*TRACK, "e.end", "e.src")
    near = ends.join(found.select("event_id", "src", C("dst").alias("det_id")), ["event_id", "src"])
    return near.join(members.select(*TRACK, "det_id"), [*TRACK, "det_id"], "left_anti").select(*TRACK, "end").distinct()


def mutual(proposals: DataFrame) -> DataFrame:
    """Proposals (event_id, track_a, end_a, track_b, end_b) that both ends make: every end has one link at most."""
    one = proposals.groupBy("event_id", "track_a", "end_a").agg(F.min(F.struct("track_b", "end_b")).alias("m")).select("event_id", "track_a", "end_a", C("m.track_b").alias("track_b"), C("m.end_b").alias("end_b"))
    back = one.select("event_id", C("track_b").alias("track_a"), C("end_b").alias("end_a"), C("track_a").alias("track_b"), C("end_a").alias("end_b"))
    return one.join(back.hint("merge"), one.columns, "left_semi")


def merged_ids(tracks: DataFrame, links: DataFrame) -> DataFrame:
    """(event_id, track_id, merged_id): the smallest track that each one is linked with."""
    nodes = tracks.select("event_id", C("track_id").alias("det_id"))
    found = components(nodes, links.select("event_id", C("track_a").alias("src"), C("track_b").alias("dst")))
    return found.select("event_id", C("det_id").alias("track_id"), C("component").alias("merged_id"))


def merge_tracks(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of merged tracks (event_id, track_id, pos, det_id), tracks laid end to end along mutual links.

    Every chain is walked from its free end with the smallest track, by the
    tail if both of its ends are free (a loop from its smallest track's tail),
    all chains one track further in each round; a track that is entered by its
    head is reversed.  A node counts once, where
    it comes first.
    """
    tracks, links = stored(members.select(*TRACK).distinct(), "tracks"), stored(links, "links")
    ids = stored(merged_ids(tracks, links), "merged")
    ends = tracks.withColumn("end", F.explode(F.array(F.lit("head"), F.lit("tail"))))
    free = ends.join(links.select("event_id", C("track_a").alias("track_id"), C("end_a").alias("end")), [*TRACK, "end"], "left_anti")
    # Entered by a free end where the chain has one; the smallest track's tail else.
    start = ids.join(free, TRACK, "left").groupBy("event_id", "merged_id").agg(F.min(F.struct(C("end").isNull().alias("none"), "track_id", F.coalesce(C("end") == "head", F.lit(False)).alias("by_head"))).alias("s"))
    at = stored(start.select("event_id", "merged_id", C("s.track_id").alias("track_id"), F.when(C("s.by_head"), "head").otherwise("tail").alias("entered"), F.lit(0).alias("step")), "walk")
    walked = at
    while True:
        leave = at.withColumn("end_a", F.when(C("entered") == "head", "tail").otherwise("head")).withColumnRenamed("track_id", "track_a")
        on = leave.join(links, ["event_id", "track_a", "end_a"]).select("event_id", "merged_id", C("track_b").alias("track_id"), C("end_b").alias("entered"), (C("step") + 1).alias("step"))
        at = stored(on.join(walked, [*TRACK], "left_anti"), "walk")
        if at.isEmpty():
            break
        walked = walked.unionByName(at)
    key = F.when(C("entered") == "head", -C("pos")).otherwise(C("pos"))
    laid = members.join(walked, TRACK).withColumn("key", key)
    first = Window.partitionBy("event_id", "merged_id", "det_id").orderBy("step", "key")
    once = laid.withColumn("copy", F.row_number().over(first)).filter("copy = 1")
    number = F.row_number().over(Window.partitionBy("event_id", "merged_id").orderBy("step", "key")).cast("long")
    return once.select("event_id", C("merged_id").alias("track_id"), number.alias("pos"), "det_id")


def dedupe_overlap(members: DataFrame, share: float = 0.66) -> DataFrame:
    """(event_id, track_id) of the tracks that stay: a track goes if one that stays, longer or of the smaller id, overlaps it.

    Overlap is common nodes over the share of the shorter one.  In rounds: what
    no undecided track dominates stays, what those dominate goes.
    """
    n = stored(members.groupBy(*TRACK).agg(F.countDistinct("det_id").alias("n")), "sizes")
    own = members.select(*TRACK, "det_id").distinct().join(n, TRACK)
    a = own.select("event_id", "det_id", C("track_id").alias("a"), C("n").alias("na"))
    b = own.select("event_id", "det_id", C("track_id").alias("b"), C("n").alias("nb"))
    common = a.join(b, ["event_id", "det_id"]).filter("a <> b AND (nb > na OR (nb = na AND b < a))").groupBy("event_id", "a", "b", "na", "nb").agg(F.count("*").alias("m"))
    over = stored(common.filter(C("m") > share * F.least("na", "nb")).select("event_id", C("a").alias("track_id"), "b"), "dominated")
    kept, open_ = None, n.select(*TRACK)
    while True:
        live = over.join(open_, TRACK, "left_semi").join(open_.withColumnRenamed("track_id", "b"), ["event_id", "b"], "left_semi")
        free = stored(open_.join(live.select(*TRACK).distinct(), TRACK, "left_anti"), "free")
        kept = free if kept is None else kept.unionByName(free)
        gone = over.join(free.withColumnRenamed("track_id", "b"), ["event_id", "b"], "left_semi").select(*TRACK).distinct()
        open_ = stored(open_.join(free, TRACK, "left_anti").join(gone, TRACK, "left_anti"), "open")
        if open_.isEmpty():
            return kept


def valid_tracks(summary: DataFrame, least: int = 3) -> DataFrame:
    """Tracks of at least so many members, numbered anew from 0 in each event."""
    number = F.row_number().over(Window.partitionBy("event_id").orderBy("track_id")) - 1
    return summary.filter(C("length") >= least).withColumn("number", number.cast("long"))


def reconstruct_z(members: DataFrame, nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """(event_id, track_id, det_id, z, scatter): heights along a track from line fits of its points.

    Skewed nodes are corrected first (``correct_skew``); straight tubes have
    no height of their own.  See ``heights``.
    """
    moved = skew_corrected(members, nodes, tasks).select(*TRACK, "pos", "det_id", "layer", C("cx").alias("x"), C("cy").alias("y"), C("cz").alias("z"))
    return heights(dealt(moved, tasks), tasks)


def heights(own: DataFrame, tasks: int | None = None) -> DataFrame:
    """Members with layers and (corrected) positions -> (event_id, track_id, det_id, z, scatter); a height of 0 is none.

    The points are the origin and then the anchors from the lower layer on, of
    heights from -35 to 105; where one or none is usable, the members whose
    height is neither 0 nor the tubes' common 35 take their place.  z and y are fitted as lines of
    the length in the y-z plane.  A node's height lies between 0 and the fit's
    end by its share of the length in x and y, within -40 and 110; an end
    beyond 110 counts as 105.  Tracks without a point keep their heights.
    """
    order, whole = Window.partitionBy(*TRACK).orderBy("o"), Window.partitionBy(*TRACK)
    fits = lambda *none: F.coalesce(~C("z").isin(*none) & C("z").between(-35, 105), F.lit(False))
    anchor = anchors_of(own).select(*TRACK, "pos", "layer", "y", "z", fits(0.0).alias("ok"))
    member = own.select(*TRACK, "pos", F.lit(None).cast("long").alias("layer"), "y", "z", fits(0.0, 35.0).alias("ok")).filter("ok")
    point = dealt(anchor.unionByName(member), tasks)
    at = F.when(C("layer").isNotNull(), C("pos"))
    point = point.withColumns({"up": F.min_by("layer", at).over(whole) <= F.max_by("layer", at).over(whole), "enough": F.count(F.when(C("ok") & C("layer").isNotNull(), 1)).over(whole) > 1})
    point = point.withColumn("usable", C("ok") & (C("enough") == C("layer").isNotNull()))
    # The others lie before the first and count nothing.
    point = point.withColumn("o", F.when(C("usable"), F.when(C("up"), C("pos")).otherwise(-C("pos")))).withColumn("z", F.when(C("usable"), C("z")))
    step = F.hypot(C("z") - F.coalesce(F.lag("z").over(order), F.lit(0.0)), C("y") - F.coalesce(F.lag(F.when(C("usable"), C("y"))).over(order), F.lit(0.0)))
    point = point.withColumn("step", step).withColumn("p", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Sums of the line fits, in which the origin is one more point of zeros.
    total = lambda c: F.sum(F.when(C("usable"), c))
    sums = point.groupBy(*TRACK).agg(
        F.first("up").alias("up"), (F.count(F.when(C("usable"), 1)) + 1).alias("n"), F.max("p").alias("end"), total(C("p")).alias("sp"), total(C("p") * C("p")).alias("spp"),
        *(f for a in "zy" for f in (total(C(a)).alias(f"s{a}"), total(C("p") * C(a)).alias(f"sp{a}"))),
    )
    spread = C("n") * C("spp") - C("sp") * C("sp")
    slope = lambda a: F.when(spread > 0, (C("n") * C(f"sp{a}") - C("sp") * C(f"s{a}")) / spread)
    fit = sums.withColumns({"mz": slope("z"), "my": slope("y")}).withColumn("last", (C("sz") - C("mz") * C("sp")) / C("n") + C("mz") * C("end"))
    fit = fit.select(*TRACK, "up", F.when(C("last") > 110, 105.0).otherwise(C("last")).alias("zf"), F.atan(C("my") / F.when(C("mz") != 0, C("mz"))).alias("scatter"))
    own = dealt(own.join(fit, TRACK), tasks).withColumn("o", F.when(C("up"), C("pos")).otherwise(-C("pos")))
    step = F.hypot(C("x") - F.coalesce(F.lag("x").over(order), F.lit(0.0)), C("y") - F.coalesce(F.lag("y").over(order), F.lit(0.0)))
    own = own.withColumn("step", step).withColumn("d", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("total", F.max("d").over(whole))
    z = F.least(F.greatest(C("zf") * C("d") / C("total"), F.lit(-40.0)), F.lit(110.0))
    # greatest and least pass over nulls, so a missing fit is asked for by name.
    return own.select(*TRACK, "det_id", F.when(C("zf").isNotNull() & (C("total") > 0), z).otherwise(C("z")).alias("z"), "scatter")
