from pyspark.sql import functions as F

from tests.test_dealt import dealt, fired_chain
from trackframe.operators import finder, graph
from trackframe.plans import finding
from trackframe.sources.fixtures import view


def tables(spark):
    """A track of one node, next to which four of its layer fired in a row, and one of another layer."""
    ids = [1, 2, 3, 4, 5, 9]
    nodes = spark.createDataFrame([(d, 7 if d == 9 else 3, 1) for d in ids], "det_id long, layer long, node_type long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 9)], "src long, dst long")
    hits = spark.createDataFrame([(0, d) for d in ids], "event_id long, det_id long")
    reco = spark.createDataFrame([(0, 6, 1, 1)], "event_id long, reco_id long, pos long, det_id long")
    return {"f_nodes": nodes, "f_edges": edges, "f_hits": hits, "f_reco": reco, "lineitem": hits}


def test_absorbed_nodes_absorb_in_turn_until_none_is_left(spark):
    for query in (finding.absorb_same_layer, finding.absorb_all):
        found = query(tables(spark).__getitem__).collect()
        assert sorted((r.det_id, r.track_id) for r in found) == [(2, 6), (3, 6), (4, 6), (5, 6)]


def test_edges_from_asked_nodes_only(spark, monkeypatch):
    edges, active = fired_chain(spark)
    nodes = spark.range(1, 31).select(F.col("id").alias("det_id"), F.lit(1).cast("long").alias("node_type"), F.lit(0).cast("long").alias("layer"))
    asked = active.filter("det_id IN (1, 7)")
    rows = lambda df: sorted((r.event_id, r.src, r.dst) for r in df.collect())
    every = rows(graph.active_edges(edges, active, nodes))
    for most in (graph.MOST_EDGES, 0):
        monkeypatch.setattr(graph, "MOST_EDGES", most)
        assert rows(graph.active_edges(edges, active, nodes)) == every
        assert rows(graph.active_edges(edges, active, nodes, 3, asked)) == [r for r in every if r[1] in (1, 7)]


def test_absorbing_looks_at_free_nodes_only(spark):
    edges, active = fired_chain(spark)
    nodes = spark.range(1, 31).select(F.col("id").alias("det_id"), F.lit(1).cast("long").alias("node_type"), F.lit(0).cast("long").alias("layer"))
    members = active.filter("det_id < 30").select("event_id", F.lit(0).cast("long").alias("track_id"), F.col("det_id").alias("pos"), "det_id")
    found = graph.active_edges(edges, active, nodes)
    out = []
    dealt(spark, lambda: out.extend(finder.absorb_same_layer(members, active, found, nodes).collect()))
    assert sorted((r.event_id, r.det_id, r.track_id) for r in out) == [(e, 30, 0) for e in range(20)]
    assert sorted((r.event_id, r.det_id) for r in finder.free_nodes(members, active).collect()) == [(e, 30) for e in range(20)]


def test_open_ends_lay_members_and_fired_nodes_out_once(spark):
    read, folder = [], "/root/testdata/sf0.001"

    def v(name):
        read.append(name)
        return view(spark, folder, name) if name.startswith("f_") else spark.read.parquet(f"{folder}/{name}.parquet")

    finding.propose_from_open_ends(v)
    assert read.count("f_reco") == read.count("f_hits") == 1
