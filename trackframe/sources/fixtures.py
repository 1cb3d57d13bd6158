"""Detector-shaped inputs derived from the star-schema tables, as DataFrames and as SQL.

``view(spark, sf_dir, name)`` gives a DataFrame; ``with_views(body, names)``
prepends the same view as common table expressions to a SQL body.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PI = math.pi
#: Nodes up to which Spark may broadcast them.  It judges by the size of part's files, where a node takes a few bytes, and would send millions.
MOST_SENT = 200_000
#: Line items up to which a shuffle by event is put together at will, and those of one task beyond.
ONE_SHUFFLE, ONE_TASK = 2_000_000, 250_000


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _rings(part: DataFrame) -> int:
    """Rings per sector and layer: a full set has 6 sectors times 26 layers."""
    return max(1, part.count() // 156)


def _place(sector: Column, layer: Column, ring: Column, rings: int) -> tuple[Column, Column, Column]:
    """Azimuth, x and y of a node."""
    phi = F.lit(2 * PI) * (sector + (ring + 0.5) / F.lit(rings)) / 6
    return phi, (16 + layer) * F.cos(phi), (16 + layer) * F.sin(phi)


def _complete(part: DataFrame, rings: int) -> bool:
    """Whether each ring has all its nodes, each once."""
    key = F.col("p_partkey")
    found = part.filter((key >= 0) & (key < rings * 156)).agg(F.count(key), F.countDistinct(key)).first()
    return set(found) == {rings * 156}


def event_tasks(items: DataFrame) -> int | None:
    """Over how many tasks what comes of these line items is dealt by event; None where they are few enough to be put together at will."""
    n = items.count()
    return None if n <= ONE_SHUFFLE else max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ONE_TASK))


def _by_event(items: DataFrame) -> DataFrame:
    """Items dealt by event, once for all that goes by event or track; many of them over tasks of bounded size."""
    tasks = event_tasks(items)
    return items.repartition(tasks, "event_id") if tasks else items.repartition("event_id")


def f_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static node table; one row for each part whose ring is complete.

    Beyond ``MOST_SENT`` nodes it is joined by a shuffle wherever it is used.
    """
    part = _read(spark, sf_dir, "part").select("p_partkey")
    rings = _rings(part)
    key = F.col("p_partkey")
    grid = part.select(
        (key + 1).alias("det_id"), (key % 6).alias("sector"), (F.floor(key / 6) % 26).alias("layer"), F.floor(key / 156).alias("ring")
    ).filter(F.col("ring") < rings)
    phi, x, y = _place(F.col("sector"), F.col("layer"), F.col("ring"), rings)
    skewed = F.col("layer").between(8, 15)
    tilt = F.when(~skewed, 0.0).when(F.col("layer") % 2 == 0, 3.0).otherwise(-3.0) * F.lit(PI) / 180
    placed = grid.withColumn("phi", phi).withColumn("tilt", tilt)
    nodes = placed.select(
        "det_id", "sector", "layer", "ring",
        F.when(skewed, 2).otherwise(1).cast("long").alias("node_type"),
        x.alias("x"),
        y.alias("y"),
        F.lit(35.0).alias("z"),
        F.lit(75.0).alias("half_length"),
        F.when(skewed, F.sin("tilt") * -F.sin("phi")).otherwise(0.0).alias("dx"),
        F.when(skewed, F.sin("tilt") * F.cos("phi")).otherwise(0.0).alias("dy"),
        F.cos("tilt").alias("dz"),
        (F.col("layer") == 0).alias("layer_limit"),
        F.when(F.col("ring") == 0, -1).when(F.col("ring") == rings - 1, 1).otherwise(0).cast("long").alias("sector_limit"),
    )
    return nodes if rings * 156 <= MOST_SENT else nodes.hint("merge")


def f_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring nodes of a sector; some edges lack their reverse."""
    nodes = f_nodes(spark, sf_dir).select("det_id", "sector", "layer", "ring")
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    near = nodes.select("det_id", "sector", F.col("layer"), F.col("ring"), F.explode(steps).alias("s"))
    left = near.select(F.col("det_id").alias("src"), "sector", (F.col("layer") + F.col("s.a")).alias("layer"), (F.col("ring") + F.col("s.b")).alias("ring"))
    right = nodes.withColumnRenamed("det_id", "dst")
    pairs = left.join(right, ["sector", "layer", "ring"]).filter("src <> dst")
    return pairs.filter("(src + dst) % 3 <> 0 OR src < dst").select("src", "dst")


def f_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with simulated truth, one for each line item.

    Where the nodes are too many to be sent, a hit's place follows from the
    number of its node, if the rings have all of theirs; else they are joined.
    """
    part = _read(spark, sf_dir, "part")
    rings = _rings(part)
    items = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_shipdate",
        F.floor(F.col("l_orderkey") / 30).alias("event_id"),
        F.floor((F.col("l_orderkey") % 30) / 3).alias("track_id"),
    )
    in_track = Window.partitionBy("event_id", "track_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = _by_event(items).withColumn("k", F.row_number().over(in_track).cast("long"))
    event, track, k = F.col("event_id"), F.col("track_id"), F.col("k")
    sector, layer = (event + track) % 6, (k - 1) % 26
    ring = (event + F.floor(track / 6) * (event % 4) + F.floor((k - 1) / 4)) % rings
    in_event = Window.partitionBy("event_id").orderBy("track_id", "k")
    items = items.withColumn("det_id", ring * 156 + layer * 6 + sector + 1).withColumn("seq", F.row_number().over(in_event).cast("long"))
    if rings * 156 > MOST_SENT and _complete(part, rings):
        _, x, y = _place(sector, layer, ring, rings)
        items = items.withColumns({"x": x, "y": y})
    else:
        items = items.join(f_nodes(spark, sf_dir).select("det_id", "x", "y"), "det_id")
    return items.select(
        "event_id", "track_id", "k", "det_id", "seq",
        (F.col("l_discount") * 5).alias("isochrone"),
        F.col("l_shipdate").alias("ts"),
        F.lit(1).cast("long").alias("hit_type"),
        (F.col("x") + (F.col("l_tax") - 0.04)).alias("tx"),
        (F.col("y") + (F.col("l_discount") - 0.05)).alias("ty"),
        (F.col("l_extendedprice") / 1000 - 35).alias("tz"),
        (0.1 + F.col("l_tax") * 20).alias("px"),
        (0.1 + F.col("l_discount") * 10).alias("py"),
        (F.col("l_quantity") / 10).alias("pz"),
    )


def f_curved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of curved tracks, a helix for each three orders, three to an event, with a hit in every layer.

    The azimuth at radius r is phi0 + asin(r / 2 rho) in the track's sense,
    the height 35 and the length of the arc times the slope; the tube is the
    one whose wire is nearest at that height.  Curvatures and slopes fall with
    the tubes' width, so that hits of neighbouring layers lie in tubes that
    are mostly neighbours.
    """
    rings = _rings(_read(spark, sf_dir, "part"))
    k = F.col("key")
    tracks = _read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 3).alias("key")).distinct()
    tracks = tracks.select(
        F.floor(k / 3).alias("event_id"), (k % 3).alias("track_id"), (F.lit(2 * PI) * ((k * 7919) % 10007) / 10007).alias("phi0"),
        F.when(k % 2 == 0, 1.0).otherwise(-1.0).alias("way"), ((60.0 + (k * 31) % 200) * max(1.0, rings / 24)).alias("rho"), (((k * 17) % 101 - 50) / (50.0 * rings)).alias("slope"),
    )
    layer, r = F.col("layer"), F.col("layer") + 16.0
    hits = tracks.withColumn("layer", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(25).cast("long"))))
    bend = F.asin(r / (2 * F.col("rho")))
    hits = hits.withColumns({"phi": F.col("phi0") + F.col("way") * bend, "tz": 35 + 2 * F.col("rho") * bend * F.col("slope")})
    tilt = F.when(~layer.between(8, 15), 0.0).when(layer % 2 == 0, 3.0).otherwise(-3.0) * F.lit(PI) / 180
    wire = F.col("phi") - F.atan((F.col("tz") - 35) * F.tan(tilt) / r)
    turn = F.pmod(F.floor(wire * F.lit(6.0 * rings) / F.lit(2 * PI)), F.lit(6 * rings))
    det = (turn % rings) * 156 + layer * 6 + F.floor(turn / rings) + 1
    return hits.select(
        "event_id", "track_id", (layer + 1).alias("k"), det.cast("long").alias("det_id"), (F.col("track_id") * 26 + layer + 1).alias("seq"),
        (r * F.cos("phi")).alias("tx"), (r * F.sin("phi")).alias("ty"), "tz",
    )


def f_reco(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found tracks with every kind of fault: lost, part of another, split, thinned."""
    t = (F.col("track_id") + F.col("event_id")) % 10
    hits = f_hits(spark, sf_dir).select("event_id", "track_id", "k", "det_id").withColumn("t", t)
    found = hits.filter("t <> 9 AND NOT (t = 7 AND k % 4 = 0) AND NOT (t = 8 AND k % 2 = 0)")
    name = F.when(F.col("t") == 5, (F.col("track_id") + 9) % 10).when((F.col("t") == 6) & (F.col("k") > 8), 10 + F.col("track_id")).otherwise(F.col("track_id"))
    once = found.withColumn("reco_id", name).groupBy("event_id", "reco_id", "det_id").agg(F.min(F.struct("k", "track_id")).alias("m"))
    order = Window.partitionBy("event_id", "reco_id").orderBy("m.k", "m.track_id", "det_id")
    return once.select("event_id", "reco_id", "det_id", F.row_number().over(order).cast("long").alias("pos"))


def f_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the stages of each event."""
    e = _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("evt"), (F.col("event_id") % 3).alias("run"), (1 + F.col("user_id") % 12).alias("trks"), (5 + F.floor(F.col("value") * 2)).alias("hits")
    )
    e = e.select(
        "run", "evt", "trks", "hits",
        (F.col("hits") * F.lit(1e-6)).alias("filltime"),
        (F.col("hits") * (1 + F.col("evt") % 5) * F.lit(1e-6)).alias("contime"),
        (F.col("hits") * (1 + F.col("evt") % 7) * F.lit(1e-6)).alias("fittime"),
        ((1 + F.col("evt") % 11) * F.lit(1e-5)).alias("mergtime"),
        (F.col("hits") * F.lit(5e-7)).alias("ztime"),
    )
    return e.withColumn("tottime", F.col("filltime") + F.col("contime") + F.col("fittime") + F.col("mergtime") + F.col("ztime"))


def f_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of tracks, one for each line item."""
    q = F.col("l_quantity")
    return _read(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 3).cast("long").alias("run"),
        F.col("l_orderkey").alias("evt"),
        (F.col("l_linestatus") == "F").alias("complex"),
        q.alias("length"),
        F.when(q < 5, 0.0).when(q >= 40, 1.0).otherwise(q / 50).alias("f1"),
        (1 + F.col("l_partkey") % 6).alias("rank"),
        F.when(F.col("l_linenumber") == 7, 200.0).otherwise((F.col("l_discount") - 0.05) * 1000 + F.col("l_tax") * 100).alias("disz"),
        (0.1 + F.col("l_tax") * 20).alias("px"),
        (0.1 + F.col("l_discount") * 10).alias("py"),
        (q / 10).alias("pz"),
        (30 + F.col("l_extendedprice") / 500).alias("radius"),
        F.col("l_linenumber").cast("long").alias("line"),
    )


def f_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of tracks with four hits or more, for fits."""
    hits = f_hits(spark, sf_dir).select("event_id", "track_id", "k", "det_id")
    nodes = f_nodes(spark, sf_dir).select("det_id", "x", "y")
    enough = hits.groupBy("event_id", "track_id").count().filter("count >= 4").drop("count")
    return hits.join(nodes, "det_id").join(enough, ["event_id", "track_id"], "left_semi").select("event_id", "track_id", "k", "x", "y")


def f_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed signals of nodes."""
    return _read(spark, sf_dir, "events").select("ts", F.col("user_id").alias("det_id"), "value")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view of that name."""
    return globals()[name](spark, sf_dir)


#: SQL of each view and the views that it reads.
SQL: dict[str, tuple[str, list[str]]] = {
    "f_rings": ("SELECT greatest(1, count(*) // 156) AS r FROM part", []),
    "f_nodes": (
        f"""SELECT p_partkey + 1 AS det_id, p_partkey % 6 AS sector, (p_partkey // 6) % 26 AS layer, p_partkey // 156 AS ring,
          CASE WHEN (p_partkey // 6) % 26 BETWEEN 8 AND 15 THEN 2 ELSE 1 END AS node_type,
          (16 + (p_partkey // 6) % 26) * cos(phi) AS x, (16 + (p_partkey // 6) % 26) * sin(phi) AS y, 35.0::DOUBLE AS z, 75.0::DOUBLE AS half_length,
          CASE WHEN (p_partkey // 6) % 26 BETWEEN 8 AND 15 THEN sin(tilt) * -sin(phi) ELSE 0.0::DOUBLE END AS dx,
          CASE WHEN (p_partkey // 6) % 26 BETWEEN 8 AND 15 THEN sin(tilt) * cos(phi) ELSE 0.0::DOUBLE END AS dy, cos(tilt) AS dz,
          (p_partkey // 6) % 26 = 0 AS layer_limit, CASE WHEN p_partkey // 156 = 0 THEN -1 WHEN p_partkey // 156 = r - 1 THEN 1 ELSE 0 END AS sector_limit
        FROM (SELECT *, {2 * PI!r}::DOUBLE * (p_partkey % 6 + (p_partkey // 156 + 0.5::DOUBLE) / r) / 6 AS phi,
          (CASE WHEN (p_partkey // 6) % 26 NOT BETWEEN 8 AND 15 THEN 0.0::DOUBLE WHEN (p_partkey // 6) % 2 = 0 THEN 3.0::DOUBLE ELSE -3.0::DOUBLE END) * {PI!r}::DOUBLE / 180 AS tilt
          FROM part, f_rings WHERE p_partkey // 156 < r)""",
        ["f_rings"],
    ),
    "f_edges": (
        """SELECT a.det_id AS src, b.det_id AS dst FROM f_nodes a JOIN f_nodes b ON a.sector = b.sector AND abs(a.layer - b.layer) <= 1
          AND abs(a.ring - b.ring) <= 1 AND a.det_id <> b.det_id WHERE (a.det_id + b.det_id) % 3 <> 0 OR a.det_id < b.det_id""",
        ["f_nodes"],
    ),
    "f_items": (
        """SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY track_id, k) AS seq FROM (
          SELECT l.*, l_orderkey // 30 AS event_id, (l_orderkey % 30) // 3 AS track_id,
          row_number() OVER (PARTITION BY l_orderkey // 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem l)""",
        [],
    ),
    "f_hits": (
        """SELECT event_id, track_id, k, i.det_id, seq, l_discount * 5 AS isochrone, l_shipdate AS ts, 1 AS hit_type, x + (l_tax - 0.04::DOUBLE) AS tx,
          y + (l_discount - 0.05::DOUBLE) AS ty, l_extendedprice / 1000 - 35 AS tz, 0.1::DOUBLE + l_tax * 20 AS px, 0.1::DOUBLE + l_discount * 10 AS py, l_quantity / 10 AS pz
        FROM (SELECT *, ((event_id + (track_id // 6) * (event_id % 4) + (k - 1) // 4) % r) * 156 + ((k - 1) % 26) * 6 + (event_id + track_id) % 6 + 1 AS det_id
          FROM f_items, f_rings) i JOIN f_nodes n ON i.det_id = n.det_id""",
        ["f_rings", "f_nodes", "f_items"],
    ),
    "f_curved": (
        f"""SELECT event_id, track_id, layer + 1 AS k, (turn % r) * 156 + layer * 6 + turn // r + 1 AS det_id, track_id * 26 + layer + 1 AS seq, rad * cos(phi) AS tx, rad * sin(phi) AS ty, tz FROM (
          SELECT *, ((floor((phi - atan((tz - 35) * tan(tilt) / rad)) * (6.0::DOUBLE * r) / {2 * PI!r}::DOUBLE)::BIGINT % (6 * r)) + 6 * r) % (6 * r) AS turn FROM (
          SELECT *, phi0 + way * bend AS phi, 35 + 2 * rho * bend * slope AS tz, (CASE WHEN layer NOT BETWEEN 8 AND 15 THEN 0.0::DOUBLE WHEN layer % 2 = 0 THEN 3.0::DOUBLE ELSE -3.0::DOUBLE END) * {PI!r}::DOUBLE / 180 AS tilt FROM (
          SELECT *, layer + 16.0::DOUBLE AS rad, asin((layer + 16.0::DOUBLE) / (2 * rho)) AS bend FROM (
          SELECT key // 3 AS event_id, key % 3 AS track_id, {2 * PI!r}::DOUBLE * ((key * 7919) % 10007) / 10007 AS phi0, CASE WHEN key % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS way,
            (60.0::DOUBLE + (key * 31) % 200) * greatest(1.0::DOUBLE, r / 24::DOUBLE) AS rho, ((key * 17) % 101 - 50) / (50.0::DOUBLE * r) AS slope, unnest(range(0, 26)) AS layer, r FROM (SELECT DISTINCT l_orderkey // 3 AS key FROM lineitem), f_rings))))""",
        ["f_rings"],
    ),
    "f_reco": (
        """SELECT event_id, reco_id, det_id, row_number() OVER (PARTITION BY event_id, reco_id ORDER BY mk, mt, det_id) AS pos FROM (
          SELECT event_id, reco_id, det_id, min(k) AS mk, arg_min(track_id, k * 1000 + track_id) AS mt FROM (
            SELECT *, CASE WHEN t = 5 THEN (track_id + 9) % 10 WHEN t = 6 AND k > 8 THEN 10 + track_id ELSE track_id END AS reco_id
            FROM (SELECT *, (track_id + event_id) % 10 AS t FROM f_hits) WHERE t <> 9 AND NOT (t = 7 AND k % 4 = 0) AND NOT (t = 8 AND k % 2 = 0))
          GROUP BY event_id, reco_id, det_id)""",
        ["f_hits"],
    ),
    "f_timing": (
        """SELECT *, filltime + contime + fittime + mergtime + ztime AS tottime FROM (SELECT event_id % 3 AS run, event_id AS evt, 1 + user_id % 12 AS trks, hits,
          hits * 1e-6::DOUBLE AS filltime, hits * (1 + event_id % 5) * 1e-6::DOUBLE AS contime, hits * (1 + event_id % 7) * 1e-6::DOUBLE AS fittime,
          (1 + event_id % 11) * 1e-5::DOUBLE AS mergtime, hits * 5e-7::DOUBLE AS ztime
          FROM (SELECT *, 5 + CAST(floor(value * 2) AS BIGINT) AS hits FROM events))""",
        [],
    ),
    "f_scores": (
        """SELECT l_linenumber % 3 AS run, l_orderkey AS evt, l_linestatus = 'F' AS complex, l_quantity AS length,
          CASE WHEN l_quantity < 5 THEN 0.0::DOUBLE WHEN l_quantity >= 40 THEN 1.0::DOUBLE ELSE l_quantity / 50 END AS f1, 1 + l_partkey % 6 AS rank,
          CASE WHEN l_linenumber = 7 THEN 200.0::DOUBLE ELSE (l_discount - 0.05::DOUBLE) * 1000 + l_tax * 100 END AS disz, 0.1::DOUBLE + l_tax * 20 AS px,
          0.1::DOUBLE + l_discount * 10 AS py, l_quantity / 10 AS pz, 30 + l_extendedprice / 500 AS radius, l_linenumber AS line FROM lineitem""",
        [],
    ),
    "f_points": (
        """SELECT event_id, track_id, k, x, y FROM (SELECT h.*, n.x, n.y, count(*) OVER (PARTITION BY event_id, track_id) AS c
          FROM f_hits h JOIN f_nodes n ON h.det_id = n.det_id) WHERE c >= 4""",
        ["f_hits", "f_nodes"],
    ),
    "f_stream": ("SELECT ts, user_id AS det_id, value FROM events", []),
}


def with_views(body: str, *names: str, more: dict[str, str] | None = None) -> str:
    """``body`` after the definitions of the named views, those that they read, and ``more`` of one's own."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in SQL[name][1]:
            add(other)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({SQL[n][0]})" for n in order] + [f"{n} AS ({s})" for n, s in (more or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
