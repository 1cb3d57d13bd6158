"""Reading and writing of node, hit, score and timing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Codes of node types and of hit types in files (fixed values of the formats).
NODE_TYPES = {1: "PARA", 2: "SKEW", 6: "VIRTUAL"}
HIT_TYPES = {1: "STT", 2: "MVD"}
TIMING = "evt long, trks long, hits long, filltime double, contime double, fittime double, mergtime double, ztime double, tottime double"
SLOPE = 0.052407779283041196  # tan 3 degrees


def slope_class(dx: Column, dy: Column) -> Column:
    """Slope of a wire by its azimuth: positive, negative, or 1 for a wire along z."""
    turn = F.atan2(dy, dx)
    return F.when((dx == 0) & (dy == 0), 1.0).when(turn > 0, SLOPE).when(turn < 0, -SLOPE).otherwise(1.0)


def node_kind(code: Column) -> Column:
    """The name of a node type."""
    return F.coalesce(*(F.when(code == k, v) for k, v in NODE_TYPES.items()), F.lit("UNKNOWN"))


def hit_kind(code: Column) -> Column:
    """The name of a hit type."""
    return F.coalesce(*(F.when(code == k, v) for k, v in HIT_TYPES.items()), F.lit("UNKNOWN"))


def as_nodes(raw: DataFrame) -> DataFrame:
    """Nodes with kind, weight (0 for virtual ones) and slope."""
    kind = node_kind(F.col("node_type"))
    return raw.withColumns({"kind": kind, "weight": F.when(kind == "VIRTUAL", 0).otherwise(1).cast("long"), "slope": slope_class(F.col("dx"), F.col("dy"))})


def load_nodes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A node table with neighbour lists -> nodes and edges."""
    raw = spark.read.parquet(path)
    edges = raw.select(F.col("det_id").alias("src"), F.explode("neighbours").alias("dst"))
    return as_nodes(raw.drop("neighbours")), edges


def load_hits(spark: SparkSession, path: str) -> DataFrame:
    """A hit table, with the kind of each hit."""
    return spark.read.parquet(path).withColumn("kind", hit_kind(F.col("hit_type")))


def parse_neighbour_lines(lines: DataFrame) -> DataFrame:
    """Lines "id,neighbour,neighbour,..." -> (src, dst); zeros and blanks are no neighbours."""
    fields = lines.select(F.split(F.trim("value"), r"\s*,\s*").alias("f"))
    pairs = fields.select(F.expr("try_cast(f[0] AS BIGINT)").alias("src"), F.explode(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0)))).alias("d"))
    return pairs.select("src", F.expr("try_cast(d AS BIGINT)").alias("dst")).filter("src IS NOT NULL AND dst <> 0")


def load_neighbour_csv(spark: SparkSession, path: str) -> DataFrame:
    """A file of neighbour lines -> (src, dst)."""
    return parse_neighbour_lines(spark.read.text(path))


def derive_nodes(raw: DataFrame) -> DataFrame:
    """A detector description -> nodes with polar position, type by the parallel flag, and starting z (0 for parallel tubes)."""
    return raw.select(
        "det_id", "sector", "layer", F.when(F.col("parallel"), 1).otherwise(2).cast("long").alias("node_type"), "x", "y", "z",
        F.hypot("x", "y").alias("r"), F.degrees(F.atan2("y", "x")).alias("theta_deg"),
        F.when(F.col("parallel"), 0.0).otherwise(F.col("z")).alias("z_det"), "layer_limit", "sector_limit",
    )


def enrich_hits(hits: DataFrame, points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits with the truth point (tx, ty, ...) that their ref names in the event and with the tube's position, both cartesian and polar.

    Hits without a point or a tube are left out; ``enrich_noise`` keeps them.
    """
    tubes = nodes.select("det_id", F.col("x").alias("tube_x"), F.col("y").alias("tube_y"), F.col("z").alias("tube_z"))
    polar = lambda x, y, n: {f"{n}_r": F.hypot(x, y), f"{n}_theta": F.atan2(F.col(y), F.col(x)), f"{n}_theta_deg": F.degrees(F.atan2(F.col(y), F.col(x)))}
    return hits.join(points, ["event_id", "ref"]).join(tubes, "det_id").withColumns(polar("tube_x", "tube_y", "tube") | polar("tx", "ty", "truth"))


def enrich_noise(hits: DataFrame, points: DataFrame, sentinel: float = -10000.0) -> DataFrame:
    """Hits by their reference to a truth point; hits without one get the sentinel."""
    fields = [c for c in points.columns if c != "ref"]
    joined = hits.join(points, "ref", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(sentinel)) for c in fields})


def load_timing(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Timing files of several runs, with a run label."""
    runs = [spark.read.csv(path, header=True, schema=TIMING).withColumn("run", F.lit(run)) for run, path in paths.items()]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def load_scores(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns of a score table."""
    return spark.read.parquet(path).select(*columns)


def write_tables(tables: dict[str, DataFrame], path: str, bucket: int | None = None) -> None:
    """Result tables as Parquet, by buckets of ``bucket`` events where a table has events.

    A bucket is written by one task, so there is one file for each, not one
    for each task that has some of its rows.
    """
    for name, df in tables.items():
        if bucket and "event_id" in df.columns:
            df = df.withColumn("event_bucket", F.floor(F.col("event_id") / bucket))
            df.repartition("event_bucket").write.mode("overwrite").partitionBy("event_bucket").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def component_table(members: DataFrame, matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event_id, track, best, det_id, x, y, r, theta_deg): members with their best match (-1: none) and position."""
    at = nodes.select("det_id", "x", "y", F.hypot("x", "y").alias("r"), F.degrees(F.atan2("y", "x")).alias("theta_deg"))
    best = matches.select("event_id", "reco_id", F.col("track_id").alias("best"))
    return members.join(at, "det_id").join(best, ["event_id", "reco_id"], "left").withColumn("best", F.coalesce("best", F.lit(-1)))


def track_id_list(members: DataFrame, track: str = "track_id", more_than: int = 5) -> DataFrame:
    """(event_id, number, det_id): nodes of tracks with more than so many, the tracks of an event numbered from 0."""
    once = members.select("event_id", track, "det_id").distinct()
    long = once.groupBy("event_id", track).agg(F.count("*").alias("n")).filter(F.col("n") > more_than)
    number = long.select("event_id", track, (F.row_number().over(Window.partitionBy("event_id").orderBy(track)) - 1).cast("long").alias("number"))
    return once.join(number, ["event_id", track]).select("event_id", "number", "det_id")


def member_coords(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members with the tube's position and the corrected one (that of the tube where there is none)."""
    at = nodes.select("det_id", "x", "y", "z")
    own = members if "cx" in members.columns else members.withColumns({c: F.lit(None).cast("double") for c in ("cx", "cy", "cz")})
    return own.join(at, "det_id").withColumns({f"c{a}": F.coalesce(f"c{a}", a) for a in "xyz"})


#: Header of the file of hits and the columns that stand under it (fixed values of the format).
HIT_FILE = {
    "EvtNum": "event_id", "x": "tx", "y": "ty", "z": "tz", "mx": "tube_x", "my": "tube_y", "mz": "tube_z", "r": "truth_r", "theta": "truth_theta", "thetaDeg": "truth_theta_deg",
    "mr": "tube_r", "mtheta": "tube_theta", "mthetaDeg": "tube_theta_deg", "isochrone": "isochrone", "type": "hit_type", "trackID": "track_id", "timeStamp": "ts", "detID": "det_id",
}


def write_hits_csv(enriched: DataFrame, path: str) -> None:
    """Enriched hits as compressed CSV files with the full header."""
    write_csv(enriched.select(*(F.col(c).alias(n) for n, c in HIT_FILE.items())), path, compression="gzip")


def read_hits_csv(spark: SparkSession, path: str) -> DataFrame:
    """What write_hits_csv wrote."""
    kinds = {"EvtNum": "long", "type": "long", "trackID": "long", "detID": "long", "timeStamp": "string"}
    return spark.read.csv(path, header=True, schema=", ".join(f"{n} {kinds.get(n, 'double')}" for n in HIT_FILE))


def write_csv(df: DataFrame, path: str, header: bool = True, compression: str = "none") -> None:
    """A table as CSV files."""
    df.write.mode("overwrite").csv(path, header=header, compression=compression)


def tracks_json(members: DataFrame, track: str = "track_id", order: str = "seq") -> DataFrame:
    """(event_id, json): {"ID", "Trajectories": [{"ID", "Hits": [ids]}]} of each event, hits in order."""
    rows = members.groupBy("event_id", track).agg(F.array_sort(F.collect_list(F.struct(order, "det_id"))).alias("h"))
    events = rows.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(F.col(track).alias("ID"), F.col("h.det_id").alias("Hits")))).alias("Trajectories"))
    return events.select("event_id", F.to_json(F.struct(F.col("event_id").alias("ID"), "Trajectories")).alias("json"))


def components_json(members: DataFrame, nodes: DataFrame, track: str = "track_id", order: str = "pos") -> DataFrame:
    """As tracks_json, without virtual nodes."""
    real = nodes.filter(node_kind(F.col("node_type")) != "VIRTUAL").select("det_id")
    return tracks_json(members.join(real, "det_id", "left_semi"), track, order)


def grid_dump(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(det_id, sector, layer, x, y, neighbours): neighbour ids in order, joined by blanks."""
    near = edges.groupBy("src").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_set("dst")), lambda d: d.cast("string"))).alias("neighbours"))
    return nodes.join(near, nodes.det_id == near.src, "left").select("det_id", "sector", "layer", "x", "y", F.coalesce("neighbours", F.lit("")).alias("neighbours"))


def fired_nodes(active: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that fired in some event, with original and starting coordinates."""
    fired = nodes.join(active.select("det_id").distinct(), "det_id", "left_semi")
    return fired.select("det_id", "x", "y", "z", F.col("x").alias("x_det"), F.col("y").alias("y_det"), F.when(node_kind(F.col("node_type")) == "PARA", 0.0).otherwise(F.col("z")).alias("z_det"))


def write_by_event(df: DataFrame, path: str, events: int = 1000) -> None:
    """A table with event_id, in folders of ``events`` consecutive events each, sorted by event within its files."""
    own = df.withColumn("event_bucket", F.expr(f"event_id div {events}"))
    own.repartition("event_bucket").sortWithinPartitions("event_bucket", "event_id").write.partitionBy("event_bucket").parquet(path)


def read_by_event(spark: SparkSession, path: str, first: int = -1, last: int = -1, events: int = 1000) -> DataFrame:
    """Rows of events from ``first`` up to, but without, ``last`` (all if both are negative) of such a table; other folders are not read."""
    found = spark.read.parquet(path)
    if first >= 0 or last >= 0:
        first, last = max(first, 0), max(last, 0)
        found = found.filter((F.col("event_bucket") >= first // events) & (F.col("event_bucket") <= (last - 1) // events) & (F.col("event_id") >= first) & (F.col("event_id") < last))
    return found.drop("event_bucket")
