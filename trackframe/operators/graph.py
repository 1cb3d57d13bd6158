"""The static detector graph, and the part of it that each event fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.functions.shared import let, stored

PARA, SKEW, VIRTUAL = 1, 2, 6
#: Ids of first nodes whose pairs are numbered by one task.
SPAN = 4096


def symmetrise(edges: DataFrame) -> DataFrame:
    """Edges with every reverse, each once."""
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(both).alias("e")).select("e.src", "e.dst").distinct()


def repaired_layer_limit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes whose layer_limit is also true where no neighbour lies in a higher layer."""
    layer = nodes.select(F.col("det_id").alias("dst"), F.col("layer").alias("dst_layer"))
    higher = edges.join(layer, "dst").join(nodes.select(F.col("det_id").alias("src"), "layer"), "src").filter("dst_layer > layer").select(F.col("src").alias("det_id")).distinct()
    found = nodes.join(higher.withColumn("has", F.lit(True)), "det_id", "left")
    return found.withColumn("layer_limit", F.col("layer_limit") | F.col("has").isNull()).drop("has")


def boundaries(nodes: DataFrame) -> DataFrame:
    """(det_id, boundary): real nodes at a limit of layers or of sectors."""
    kinds = F.array_compact(F.array(F.when(F.col("layer_limit"), "layer"), F.when(F.col("sector_limit") != 0, "sector")))
    return nodes.filter(F.col("node_type") != VIRTUAL).select("det_id", F.explode(kinds).alias("boundary"))


def layer_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b), a < b: neighbours of adjacent layers with different slopes, each pair once."""
    own = nodes.select("det_id", "layer", "slope")
    a = own.toDF("src", "la", "sa")
    b = own.toDF("dst", "lb", "sb")
    pairs = edges.join(a, "src").join(b, "dst").filter("abs(la - lb) = 1 AND sa <> sb")
    return pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def virtual_nodes(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """A node for each pair, midway between the closest points of its tubes; it is in the sector and layer of the first.

    Ids follow the largest of the real nodes, in the order of the pairs: they
    are counted within spans of first nodes, and by the pairs of the spans
    before, which are one row a span.
    """
    tube = ("det_id", "sector", "layer", "x", "y", "z", "half_length", "dx", "dy", "dz")
    a = nodes.select(*(F.col(c).alias("a" if c == "det_id" else f"a_{c}") for c in tube))
    b = nodes.select(*(F.col(c).alias("b" if c == "det_id" else f"b_{c}") for c in tube))
    x, y, z = ((F.col(f"p{c}") + F.col(f"q{c}")) / 2 for c in "xyz")
    last = nodes.agg(F.max("det_id")).first()[0] or 0
    met = G.with_closest_points(pairs.join(a, "a").join(b, "b"), "a_", "b_", 0.10).select("a", "b", "a_sector", "a_layer", x.alias("x"), y.alias("y"), z.alias("z"))
    span = F.expr(f"a div {SPAN}").alias("span")
    before = F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = pairs.groupBy(span).agg(F.count("*").alias("n")).select("span", before.alias("earlier"))
    met = met.withColumn("span", span).join(earlier, "span")
    number = F.row_number().over(Window.partitionBy("span").orderBy("a", "b")).cast("long") + F.col("earlier")
    return met.select(
        (number + last).alias("det_id"), F.col("a_sector").alias("sector"), F.col("a_layer").alias("layer"), F.lit(VIRTUAL).cast("long").alias("node_type"),
        "x", "y", "z", F.hypot("x", "y").alias("r"), F.degrees(F.atan2("y", "x")).alias("theta_deg"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"),
    )


def virtual_edges(virtual: DataFrame) -> DataFrame:
    """Edges between virtual nodes and their parents, both ways."""
    ends = F.explode(F.array("parent_a", "parent_b")).alias("dst")
    return symmetrise(virtual.select(F.col("det_id").alias("src"), ends))


def seam_edges(nodes: DataFrame, most: float = 3.5) -> DataFrame:
    """(src, dst): skewed tubes at the left limit of a sector to those at the right limit of the sector before, of near layers, under a distance."""
    tube = ("det_id", "sector", "layer", "x", "y", "z", "half_length", "dx", "dy", "dz")
    skewed = nodes.filter(F.col("node_type") == SKEW)
    left = skewed.filter("sector_limit = -1").select(*(F.col(c).alias(f"a_{c}") for c in tube))
    left = left.withColumn("sector", (F.col("a_sector") + 5) % 6).withColumn("layer", F.explode(F.array(*(F.col("a_layer") + d for d in (-1, 0, 1)))))
    right = skewed.filter("sector_limit = 1").select(F.col("sector"), F.col("layer"), *(F.col(c).alias(f"b_{c}") for c in tube))
    near = G.with_segment_distance(left.join(right, ["sector", "layer"]), "a_", "b_").select("a_det_id", "b_det_id", "distance")
    # Stored before the filter, which would else be written out in terms of the tubes' columns.
    near = stored(near, "seam").filter(F.col("distance") < most)
    return near.select(F.col("a_det_id").alias("src"), F.col("b_det_id").alias("dst"))


def extend(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Both node tables; columns that one has not got are null."""
    return nodes.unionByName(more, allowMissingColumns=True)


def lookup(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids with found = the id of the node, or -1."""
    return ids.join(nodes.select("det_id", F.col("det_id").alias("found")), "det_id", "left").withColumn("found", F.coalesce("found", F.lit(-1)))


def is_neighbour(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) with adjacent."""
    known = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct().withColumn("adjacent", F.lit(True))
    return pairs.join(known, ["a", "b"], "left").withColumn("adjacent", F.coalesce("adjacent", F.lit(False)))


def neighbour_steps(edges: DataFrame) -> DataFrame:
    """(det_id, steps): each node's neighbours as steps from its own id, which are alike for most nodes and so take little room where they are sent."""
    return edges.groupBy(F.col("src").alias("det_id")).agg(F.collect_set(F.col("dst") - F.col("src")).alias("steps"))


def steps_from(steps: Column | str, at: Column | str) -> Column:
    """The nodes that steps lead to from a node."""
    return F.transform(steps, lambda s: s + at)


def _by_event(active: DataFrame, steps: DataFrame, tasks: int | None) -> DataFrame:
    """(event_id, det_id, steps): fired nodes with their steps, dealt by event over ``tasks`` if they are given; none are left out."""
    own = active.join(steps, "det_id", "left").select("event_id", "det_id", "steps")
    return own.repartition(tasks, "event_id") if tasks else own


def active_two_hop(edges: DataFrame, active: DataFrame, tasks: int | None = None) -> DataFrame:
    """(event_id, det_id, reached): active nodes within two steps of an active node; inactive ones in between count, itself does not.

    What two steps reach is told once for each node of the detector; fired
    nodes take it to their event, where those that fired are side by side.
    """
    near = neighbour_steps(edges)
    first = near.select("det_id", F.explode("steps").alias("step")).select("det_id", "step", (F.col("det_id") + F.col("step")).alias("at"))
    second = first.join(near.toDF("at", "more"), "at").select("det_id", steps_from("more", F.col("step")).alias("steps"))
    both = near.unionByName(second).groupBy("det_id").agg(F.array_remove(F.array_distinct(F.flatten(F.collect_list("steps"))), 0).alias("steps"))
    own = _by_event(active, both, tasks).withColumn("fired", F.collect_list("det_id").over(Window.partitionBy("event_id")))
    return own.select("event_id", "det_id", F.explode(F.array_intersect(steps_from("steps", F.col("det_id")), "fired")).alias("reached"))


def active_k_hop(edges: DataFrame, active: DataFrame, depth: int, tasks: int | None = None) -> DataFrame:
    """(event_id, det_id, reached): active nodes found in at most ``depth`` steps.

    From each level the search goes on through the active nodes found there,
    or through all nodes of the level if none is active (it jumps a gap).  The
    start may be reached again.

    Searches that meet no gap stay within their event, whose fired nodes have
    their neighbours with them; only the others go over the static graph.
    """
    near = neighbour_steps(edges)
    none = F.array().cast("array<bigint>")
    node = F.struct("det_id", F.coalesce(steps_from("steps", F.col("det_id")), none).alias("near"))
    events = _by_event(active, near, tasks).groupBy("event_id").agg(F.collect_list(node).alias("e"))

    def searched(lists: Column, fired: Column) -> Column:
        """For each node of an event what it finds, and the level that has a gap, if any, with its number."""
        at = lambda d: F.get(lists, (F.array_position(fired, d) - 1).cast("int"))
        told = lambda found, front, gap: F.struct(found.alias("found"), front.alias("front"), gap.cast("int").alias("gap"))

        def further(s: Column, k: int) -> Column:
            on = F.array_distinct(F.flatten(F.transform(s.front, lambda d: at(d).on)))
            whole = F.array_distinct(F.flatten(F.transform(s.front, lambda d: at(d).near)))
            return F.when(s.gap.isNull(), let(on, lambda o: F.when(F.size(o) > 0, told(F.array_union(s.found, o), o, F.lit(None))).otherwise(told(s.found, whole, F.lit(k))))).otherwise(s)

        def search(x: Column) -> Column:
            first = F.when(F.size(x.on) > 0, told(x.on, x.on, F.lit(None))).otherwise(told(none, x.near, F.lit(1)))
            for k in range(2, depth + 1):
                first = let(first, lambda s, k=k: further(s, k))
            return F.struct(x.det_id.alias("det_id"), first.alias("s"))

        return F.transform(lists, search)

    lit = let(F.col("e.det_id"), lambda fired: let(F.transform("e", lambda x: F.struct(x.det_id.alias("det_id"), x.near.alias("near"), F.array_intersect(x.near, fired).alias("on"))), lambda lists: searched(lists, fired)))
    rows = events.select("event_id", F.explode(lit).alias("x")).select("event_id", "x.det_id", "x.s.*")
    rows = stored(rows.select("event_id", "det_id", "found", F.when(F.col("gap") < depth, F.col("front")).alias("front"), "gap"), "hops")
    out, open_ = rows.filter("front IS NULL"), rows.filter("front IS NOT NULL")
    fired = rows.groupBy("event_id").agg(F.collect_list("det_id").alias("fired"))
    for k in range(2, depth + 1):
        go, wait = open_.filter(F.col("gap") < k), open_.filter(F.col("gap") >= k)
        level = go.select("event_id", "det_id", F.explode("front").alias("at")).join(near.toDF("at", "steps"), "at").select("event_id", "det_id", steps_from("steps", F.col("at")).alias("ids"))
        level = level.groupBy("event_id", "det_id").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("level"))
        level = go.join(level, ["event_id", "det_id"], "left").withColumn("level", F.coalesce("level", none)).join(fired, "event_id").withColumn("on", F.array_intersect("level", "fired"))
        gone = level.select("event_id", "det_id", F.array_union("found", "on").alias("found"), F.when(F.size("on") > 0, F.col("on")).otherwise(F.col("level")).alias("front"), "gap")
        open_ = stored(gone.unionByName(wait), "gaps")
    return out.unionByName(open_).select("event_id", "det_id", F.explode("found").alias("reached"))


#: Edges of a static graph that may be broadcast with the kinds of their nodes, with some 50 bytes each.
MOST_EDGES = 1_000_000


def active_edges(edges: DataFrame, active: DataFrame, nodes: DataFrame, tasks: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(event_id, src, dst, dst_type, dst_layer): edges between fired nodes, and to virtual nodes both of whose parents fired.

    The edges are those of the detector: up to ``MOST_EDGES`` they are sent to
    the fired nodes, so that only what they lead to is dealt by event and
    node.  Beyond it each fired node gets its list of neighbours, and those
    that fired are picked where the nodes of an event are side by side (over
    ``tasks`` if they are given), so that edges to nodes that did not fire are
    never dealt.  With ``asked`` (event_id, det_id), fired nodes, only edges
    from those are told, and only they get lists.
    """
    kinds = nodes.select(F.col("det_id").alias("dst"), F.col("node_type").alias("dst_type"), F.col("layer").alias("dst_layer"))
    fired = active
    if "parent_a" in nodes.columns:
        both = nodes.filter("parent_a IS NOT NULL").select("det_id", "parent_a", "parent_b")
        one = both.join(active.withColumnRenamed("det_id", "parent_a"), "parent_a")
        lit = one.join(active.withColumnRenamed("det_id", "parent_b"), ["event_id", "parent_b"]).select("event_id", "det_id")
        fired = active.unionByName(lit)
    static = stored(edges.select(F.col("src").alias("det_id"), "dst"), "static-edges")
    few = static.count() <= MOST_EDGES
    static = static.join(kinds, "dst")
    if few:
        out = (fired if asked is None else asked).join(F.broadcast(static), "det_id").withColumnRenamed("det_id", "src")
        return out.join(fired.withColumnRenamed("det_id", "dst"), ["event_id", "dst"]).select("event_id", "src", "dst", "dst_type", "dst_layer")
    near = static.groupBy("det_id").agg(F.collect_list(F.struct((F.col("dst") - F.col("det_id")).alias("step"), "dst_type", "dst_layer")).alias("near"))
    if asked is None:
        own, lights = fired.join(near, "det_id", "left").select("event_id", "det_id", "near"), F.col("det_id")
    else:
        own = fired.select("event_id", "det_id", F.lit(None).cast(near.schema["near"].dataType).alias("near")).unionByName(asked.join(near, "det_id").select("event_id", "det_id", "near"))
        lights = F.when(F.col("near").isNull(), F.col("det_id"))
    own = own.repartition(tasks, "event_id") if tasks else own
    own = own.withColumn("lit", F.collect_list(lights).over(Window.partitionBy("event_id"))).filter("near IS NOT NULL")
    lit = F.array_intersect("lit", steps_from("near.step", F.col("det_id")))
    met = F.explode(let(lit, lambda on: F.filter("near", lambda n: F.array_contains(on, n.step + F.col("det_id"))))).alias("n")
    return own.select("event_id", F.col("det_id").alias("src"), met).select("event_id", "src", (F.col("src") + F.col("n.step")).alias("dst"), "n.dst_type", "n.dst_layer")


def same_layer(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges within a layer."""
    layer = nodes.select("det_id", "layer")
    return edges.join(layer.toDF("src", "layer"), "src").join(layer.toDF("dst", "dst_layer"), "dst").filter("layer = dst_layer").select("src", "dst")


def seed_order(active: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event_id, det_id, degree, place): nodes at a layer limit first, then ends, then the rest; by degree and id."""
    degree = found.groupBy("event_id", F.col("src").alias("det_id")).agg(F.count("*").alias("degree"))
    own = active.join(degree, ["event_id", "det_id"], "left").join(nodes.select("det_id", "layer_limit"), "det_id").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kind = F.when(F.col("layer_limit"), 0).when(F.col("degree") == 1, 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("event_id").orderBy(kind, "degree", "det_id")).cast("long")
    return own.select("event_id", "det_id", "degree", place.alias("place"))


def initial_coords(active: DataFrame, nodes: DataFrame) -> DataFrame:
    """Fired nodes with the coordinates that an event starts from: height 0 for straight tubes."""
    at = nodes.select("det_id", F.col("x").alias("x_det"), F.col("y").alias("y_det"), F.when(F.col("node_type") == PARA, 0.0).otherwise(F.col("z")).alias("z_det"))
    return active.join(at, "det_id")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(event_id, det_id, component): the smallest node that each node of an event reaches.

    ``nodes`` has (event_id, det_id), ``edges`` (event_id, src, dst).  Labels
    fall to the least of the neighbours' and then to the label of the label,
    all events at once, until none changes.
    """
    links = stored(edges.select("event_id", "src", "dst").union(edges.select("event_id", "dst", "src")).distinct(), "links")
    labels = stored(nodes.select("event_id", "det_id", F.col("det_id").alias("component")), "labels")
    while True:
        near = links.join(labels.withColumnRenamed("det_id", "src"), ["event_id", "src"]).groupBy("event_id", F.col("dst").alias("det_id")).agg(F.min("component").alias("least"))
        lower = labels.join(near, ["event_id", "det_id"], "left").select("event_id", "det_id", "component", F.least("component", F.coalesce("least", "component")).alias("now"))
        top = labels.select("event_id", F.col("det_id").alias("now"), F.col("component").alias("above"))
        new = stored(lower.join(top, ["event_id", "now"]).select("event_id", "det_id", F.least("now", "above").alias("component"), (F.least("now", "above") < F.col("component")).alias("moved")), "labels")
        labels = new.select("event_id", "det_id", "component")
        if new.filter("moved").isEmpty():
            return labels
