"""Operators on hand-made graphs and tracks with known results, and streams against batches."""

import math
import os

import pytest
from pyspark.sql import functions as F

from trackframe.operators import finder, fits, graph, growing, hits, reconstruct, score, shape, stats
from trackframe.sources import io
from trackframe.streaming import windows

NODE = "det_id long, node_type long, sector long, layer long, layer_limit boolean, sector_limit long, x double, y double, z double, half_length double, dx double, dy double, dz double"


def node(d, layer, x, y, limit=False, sector=0, kind=1):
    return (d, kind, sector, layer, limit, 0, float(x), float(y), 35.0, 75.0, 0.0, 0.0, 1.0)


def chain(spark, ids):
    return graph.symmetrise(spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long"))


@pytest.fixture(scope="module")
def line(spark):
    """Eight nodes in a row, both ends at a layer limit."""
    nodes = spark.createDataFrame([node(k + 1, k, k, 0.01 * k, limit=k in (0, 7)) for k in range(8)], NODE)
    return nodes, chain(spark, list(range(1, 9)))


def fired(spark, ids, event=0):
    return spark.createDataFrame([(event, d) for d in ids], "event_id long, det_id long")


def summary(members, nodes):
    return {r.track_id: r for r in finder.track_summary(members, nodes).collect()}


def lists(rows):
    """Tracks as lists of nodes in order, by their names."""
    out = {}
    for r in sorted(rows, key=lambda r: r.pos):
        out.setdefault(r.track_id, []).append(r.det_id)
    return out


def test_connect_grows_a_line(spark, line):
    nodes, edges = line
    members = growing.connect(fired(spark, range(1, 9)), nodes, edges)
    assert lists(members.collect()) == {1: list(range(1, 9))}
    assert summary(members, nodes)[1].status == "FINISHED"


def test_connect_stops_before_a_gap_and_fit_does_not_jump_it(spark, line):
    nodes, edges = line
    active = fired(spark, [1, 2, 3, 5, 6, 7, 8])
    members = growing.connect(active, nodes, edges)
    assert lists(members.collect()) == {1: [1, 2, 3], 8: [8, 7, 6, 5]}
    assert growing.fit_phase(members, active, nodes, edges).count() == 7


def test_fit_extends_a_head(spark, line):
    nodes, edges = line
    members = spark.createDataFrame([(0, 1, k, k) for k in range(1, 5)], "event_id long, track_id long, pos long, det_id long")
    grown = growing.fit_phase(members, fired(spark, range(1, 9)), nodes, edges)
    assert [r.det_id for r in grown.sort("pos").collect()] == list(range(1, 9))


def test_fit_links_two_ends(spark, line):
    """Heads that meet the end of another track ask to be joined; both meet here, and the link is one."""
    nodes, edges = line
    rows = [(0, 1, k, k) for k in range(1, 5)] + [(0, 8, k, 9 - k) for k in range(1, 5)]
    members = spark.createDataFrame(rows, "event_id long, track_id long, pos long, det_id long")
    links = [r for r in growing.fit_phase(members, fired(spark, range(1, 9)), nodes, edges).collect() if r.pos is None]
    assert {(r.track_id, r.end, r.other, r.other_end) for r in links} == {(1, "head", 8, "head"), (8, "head", 1, "head")}


def test_crossing_and_parallel_chains(spark):
    """Chains with a common node stop before it and go straight on in the fit; neighbouring chains stay two."""
    rows = [node(k + 1, k, k, k - 3, limit=k in (0, 6)) for k in range(7)] + [node(k + 11, k, k, 3 - k, limit=k in (0, 6)) for k in range(7) if k != 3]
    nodes = spark.createDataFrame(rows, NODE)
    pairs = list(zip([1, 2, 3, 4, 5, 6], [2, 3, 4, 5, 6, 7])) + [(11, 12), (12, 13), (13, 4), (4, 15), (15, 16), (16, 17)]
    edges = graph.symmetrise(spark.createDataFrame(pairs, "src long, dst long"))
    active = fired(spark, [r[0] for r in rows])
    members = growing.connect(active, nodes, edges)
    found = lists(members.collect())
    assert found[1][:3] == [1, 2, 3] and all(len(e) < 7 for e in found.values())
    grown = lists(r for r in growing.grow(active, nodes, edges).collect() if r.pos is not None)
    assert grown[1] == [1, 2, 3, 4, 5, 6, 7] or set(grown[1]) <= set(range(1, 8))
    side = [node(k + 1, k, k, 0, limit=k in (0, 5)) for k in range(6)] + [node(k + 11, k, k, 1, limit=k in (0, 5)) for k in range(6)]
    nodes = spark.createDataFrame(side, NODE)
    pairs = list(zip(range(1, 6), range(2, 7))) + list(zip(range(11, 16), range(12, 17))) + [(3, 13)]
    members = growing.grow(fired(spark, [r[0] for r in side]), nodes, graph.symmetrise(spark.createDataFrame(pairs, "src long, dst long")))
    own = lists(r for r in members.collect() if r.pos is not None)
    assert all(set(t) <= set(range(1, 7)) or set(t) <= set(range(11, 17)) for t in own.values())


def test_virtual_nodes_lie_between_steps(spark, line):
    nodes, edges = line
    virtual = spark.createDataFrame([(101, 2, 3)], "det_id long, parent_a long, parent_b long")
    members = growing.connect(fired(spark, range(1, 9)), nodes, edges, virtual)
    assert lists(members.collect()) == {1: [1, 2, 101, 3, 4, 5, 6, 7, 8]}


def test_joining_chains_loops_and_twins(spark):
    ids = "event_id long, track_id long, pos long, det_id long"
    asked = "event_id long, track_a long, end_a string, track_b long, end_b string, place int"

    def joined(tracks, links):
        rows = [(0, t, p, d) for t, ds in tracks.items() for p, d in enumerate(ds)]
        both = [(0, *link, 0) for a, ea, b, eb in links for link in ((a, ea, b, eb), (b, eb, a, ea))]
        return lists(growing.join_ends(spark.createDataFrame(rows, ids), spark.createDataFrame(both, asked)).collect())

    tracks = {t: [10 * t + 1, 10 * t + 2] for t in (1, 2, 3)}
    assert joined(tracks, [(1, "head", 3, "head"), (3, "tail", 2, "tail")]) == {1: [11, 12, 32, 31, 21, 22]}
    assert joined(tracks, [(1, "head", 2, "tail"), (2, "head", 3, "tail"), (3, "head", 1, "tail")]) == {1: [11, 12, 21, 22, 31, 32]}
    assert joined(tracks, [(1, "head", 2, "tail"), (3, "head", 2, "tail")]) == {1: [11, 12, 21, 22], 3: [31, 32]}
    for common, kept in ((66, {1, 2}), (67, {1})):  # of a hundred nodes; over two thirds go
        assert set(joined({1: range(110), 2: range(110 - common, 210 - common)}, [])) == kept


def test_reconstruction_of_lines_and_gaps(spark):
    """A whole track, and one with a missing layer whose parts near each other are joined, are found and ranked."""
    rows = [(k + 1, 1, 0, k, k in (0, 9), 0, 16.0 + k, 0.0, 35.0, 75.0, 0.0, 0.0, 1.0, 1.0) for k in range(10)]
    nodes = spark.createDataFrame(rows, NODE + ", slope double")
    hits_of = lambda event, ids: [(event, 7, s, d) for s, d in enumerate(ids)]
    h = spark.createDataFrame(hits_of(0, range(1, 11)) + hits_of(1, [1, 2, 3, 4, 6, 7, 8, 9, 10]) + hits_of(2, [1, 2]), "event_id long, track_id long, seq long, det_id long")
    edges = spark.createDataFrame(list(zip(range(1, 10), range(2, 11))), "src long, dst long")
    for partitions in (1, 5):
        found = reconstruct.reconstruct(h.repartition(partitions), nodes, edges).collect()
        assert sorted((r.event_id, r.track_id, r.overlap, r.rank, r.clone) for r in found) == [(0, 7, 10, 1, False), (1, 7, 9, 1, False)]


def test_merge_walks_chains_and_loops(spark):
    rows = [(0, t, p, 10 * t + p) for t in (1, 2, 3) for p in (1, 2)] + [(1, t, p, 10 * t + p) for t in (1, 2, 3) for p in (1, 2)]
    members = spark.createDataFrame(rows, "event_id long, track_id long, pos long, det_id long")
    ask = [(0, 1, "head", 3, "head"), (0, 3, "head", 1, "head"), (0, 3, "tail", 2, "tail"), (0, 2, "tail", 3, "tail"), (0, 2, "head", 9, "head")]
    ask += [(1, a, "head", b, "tail") for a, b in ((1, 2), (2, 3), (3, 1))] + [(1, b, "tail", a, "head") for a, b in ((1, 2), (2, 3), (3, 1))]
    links = finder.mutual(spark.createDataFrame(ask, "event_id long, track_a long, end_a string, track_b long, end_b string"))
    found = finder.merge_tracks(members, links).sort("event_id", "pos").collect()
    assert [r.det_id for r in found if r.event_id == 0] == [11, 12, 32, 31, 21, 22]
    assert [r.det_id for r in found if r.event_id == 1] == [11, 12, 21, 22, 31, 32]
    assert {r.track_id for r in found} == {1}


def test_dedupe_keeps_what_a_dropped_track_overlaps(spark):
    sets = {1: range(0, 10), 2: range(3, 12), 3: range(5, 13)}  # 1 drops 2, which alone would drop 3
    rows = [(0, t, p, d) for t, s in sets.items() for p, d in enumerate(s)]
    members = spark.createDataFrame(rows, "event_id long, track_id long, pos long, det_id long")
    assert sorted(r.track_id for r in finder.dedupe_overlap(members).collect()) == [1, 3]


def test_anchors_average_by_twos(spark):
    layers = [0, 0, 1, 1, 1, 2]
    nodes = spark.createDataFrame([node(k, layer, k, 0) for k, layer in enumerate(layers)], NODE)
    members = spark.createDataFrame([(0, 0, k, k) for k in range(6)], "event_id long, track_id long, pos long, det_id long")
    found = [(r.layer, r.x) for r in finder.anchors(members, nodes).sort("pos").collect()]
    assert found == [(0, 0.0), (0, 1.0), (1, 2.5), (1, 4.0), (2, 5.0)]


def test_components_and_hops(spark):
    links = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 7, 8), (1, 1, 3)], "event_id long, src long, dst long")
    nodes = fired(spark, [1, 2, 3, 7, 8, 9]).union(fired(spark, [1, 2, 3], 1))
    found = {(r.event_id, r.det_id): r.component for r in graph.components(nodes, links).collect()}
    assert found == {(0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 7): 7, (0, 8): 7, (0, 9): 9, (1, 1): 1, (1, 2): 2, (1, 3): 1}
    edges = chain(spark, [1, 2, 3, 4])
    two = graph.active_two_hop(edges, fired(spark, [1, 3]))
    assert sorted((r.det_id, r.reached) for r in two.collect()) == [(1, 3), (3, 1)]


@pytest.mark.parametrize("kind", ["kasa", "hyper", "pratt", "taubin"])
def test_circles_through_exact_points(spark, kind):
    points = spark.range(12).select(F.lit(0).alias("g"), (3 + 7 * F.cos(F.col("id") / 7)).alias("x"), (-2 + 7 * F.sin(F.col("id") / 7)).alias("y"))
    fit = fits.circle(points, ["g"], kind).first()
    assert abs(fit.a - 3) < 1e-5 and abs(fit.b + 2) < 1e-5 and abs(fit.r - 7) < 1e-5


def test_geometric_circle(spark):
    points = spark.range(40).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 2 == 0, 3 + (7 + 0.01 * F.sin("id")) * F.cos(F.col("id") / 9)).otherwise(F.col("id")).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, (7 + 0.01 * F.sin("id")) * F.sin(F.col("id") / 9)).otherwise(1.0).alias("y"))
    found = {r.g: r for r in fits.geometric_circle(points, ["g"]).collect()}
    assert found[0].code == 0 and abs(found[0].r - 7) < 0.05 and found[0].sigma < 0.01 and found[1].code == 3


def test_moments_in_one_grouping(spark):
    points = spark.range(30).select((F.col("id") % 2).alias("g"), F.sin("id").alias("x"), F.cos(F.col("id") * 3).alias("y"), F.lit(0.4).alias("cx"), F.lit(-0.2).alias("cy"))
    a = {r.g: r for r in fits.moments(points, ["g"]).collect()}
    b = {r.g: r for r in fits.moments_about(points, ["g"], "cx", "cy").collect()}
    for g in a:
        for c in ("mean_x", "mean_y", "mxx", "myy", "mxy", "mxz", "myz", "mzz"):
            assert abs(a[g][c] - b[g][c]) < 1e-9


def test_refits_of_displaced_points(spark):
    at = [(0, t, k, 10 * math.cos(k), 10 * math.sin(k), wide) for t, wide in ((1, 0.0), (2, 0.2)) for k in range(6)]
    points = spark.createDataFrame(at, "event_id long, track_id long, k long, x double, y double, isochrone double")
    still, moved = sorted(fits.isochrone_refit(points, ["event_id", "track_id"], 20).collect(), key=lambda r: r.track_id)
    assert (still.r16, still.r50, still.r84) == pytest.approx((10, 10, 10))
    assert 9.5 < moved.r16 < moved.r50 < moved.r84 < 10.5


def test_complex_tracks_are_scanned_up_to_their_first_gap(spark):
    # Track 1 leaps from node 2 to node 5 and only then meets track 2, at its third hit.
    hits = spark.createDataFrame([(0, 1, s, d) for s, d in enumerate((1, 2, 5, 6), 1)] + [(0, 2, s, d) for s, d in enumerate((7, 8), 5)], "event_id long, track_id long, seq long, det_id long")
    edges = chain(spark, [1, 2]).unionByName(chain(spark, [5, 6, 7, 8]))
    shares = lambda parity: {r.track_id for r in score.complex_tracks(hits, graph.symmetrise(edges), parity).collect() if r.shares}
    assert shares(False) == {1, 2} and shares(True) == set()


def test_distance_to_curve(spark):
    rows = [(0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 2.0), (0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 3.0, 0.0), (1.0, 2.0, 0.5, 0.0, 1.0, -1.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "x0 double, x1 double, x2 double, y0 double, y1 double, y2 double, px double, py double")
    for r in fits.distance_to_curve(df).collect():
        best = min(math.hypot(r.x0 + t * (r.x1 + t * r.x2) - r.px, r.y0 + t * (r.y1 + t * r.y2) - r.py) for t in (k / 2000 for k in range(-20000, 20001)))
        assert abs(r.distance - best) < 1e-3


def test_best_match_is_greedy_by_length(spark):
    truth = [(0, t, s, d) for t, ds in {1: range(10), 2: range(5, 14), 3: [20, 21]}.items() for s, d in enumerate(ds)]
    found = [(0, r, d) for r, ds in {1: range(4, 12), 2: range(0, 3), 3: [20]}.items() for d in ds]
    h = spark.createDataFrame(truth, "event_id long, track_id long, seq long, det_id long")
    m = score.best_match(spark.createDataFrame(found, "event_id long, reco_id long, det_id long"), h)
    assert sorted((r.track_id, r.reco_id) for r in m.collect()) == [(1, 1), (3, 3)]


def test_order_and_partitions_do_not_matter(spark, line):
    nodes, edges = line
    rows = [(0, 1, k, k) for k in range(1, 6)] + [(0, 2, k, k + 3) for k in range(1, 6)]
    a = spark.createDataFrame(rows, "event_id long, track_id long, pos long, det_id long").repartition(1)
    b = spark.createDataFrame(rows[::-1], a.schema).repartition(7)
    for f in (lambda m: finder.anchors(m, nodes), lambda m: finder.reconstruct_z(m, nodes), lambda m: shape.end_stops(m, edges), lambda m: finder.dedupe_overlap(m)):
        assert sorted(map(tuple, f(a).collect()), key=str) == sorted(map(tuple, f(b).collect()), key=str)


def test_statistics(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (float("nan"),), (None,), (99.0,)], "x double")
    assert {r.bin: r.n for r in stats.histogram(df, "x", 0.0, 10.0, 5).collect()} == {0: 1, 2: 1, 4: 1}
    assert {r.bin: r.n for r in stats.clipped_histogram(df, "x", 0.0, 10.0, 5).collect()} == {0: 1, 2: 1, 4: 2}
    r = stats.median_spread(df, [], "x").first()
    assert r.n == 4 and r.median == 7.5
    gaps = stats.bin_gaps(spark.createDataFrame([(1, 1.0), (4, 4.0)], "bin long, median double"), 0, 5).sort("bin").collect()
    assert [g.filled for g in gaps] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_tables_round_trip(spark, tmp_path):
    lines = tmp_path / "near.csv"
    lines.write_text("1,2,0,3\n2,1\n\n4\n")
    assert sorted(map(tuple, io.load_neighbour_csv(spark, str(lines)).collect())) == [(1, 2), (1, 3), (2, 1)]
    own = spark.createDataFrame([(1, 1, [2, 0]), (2, 6, [1])], "det_id long, node_type long, neighbours array<long>").withColumns({"dx": F.lit(0.0), "dy": F.lit(0.0)})
    own.write.parquet(str(tmp_path / "nodes"))
    nodes, edges = io.load_nodes(spark, str(tmp_path / "nodes"))
    assert {r.det_id: (r.kind, r.weight) for r in nodes.collect()} == {1: ("PARA", 1), 2: ("VIRTUAL", 0)} and edges.count() == 3
    timing = spark.createDataFrame([(1, 2, 3, 0.1, 0.1, 0.1, 0.1, 0.1, 0.5)], io.TIMING)
    io.write_csv(timing, str(tmp_path / "a"))
    assert [r.run for r in io.load_timing(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "a")}).collect()] == ["a", "b"]
    io.write_tables({"t": spark.createDataFrame([(0, 1), (7, 2)], "event_id long, v long")}, str(tmp_path / "out"), bucket=5)
    assert io.load_scores(spark, str(tmp_path / "out/t"), ["v"]).count() == 2


def heights_of(spark, rows):
    own = spark.createDataFrame([(0, 1, i, i, float(layer), 0.0, z, layer) for i, (layer, z) in enumerate(rows, 1)], "event_id long, track_id long, pos long, det_id long, x double, y double, z double, layer long")
    return [r.z for r in finder.heights(own).orderBy("det_id").collect()]


def test_heights_rise_with_the_length(spark):
    assert heights_of(spark, [(1, 10.0), (2, 20.0), (3, 0.0), (4, 40.0)]) == pytest.approx([10, 20, 30, 40])


def test_heights_come_from_members_where_one_anchor_is_usable(spark):
    # Four nodes of one layer: two open anchors of their own, and the mean of the others is out of range.
    assert heights_of(spark, [(2, 50.0), (2, 0.0), (2, -34.0), (2, -40.0)])[0] != 50.0
    # A single node at its tube's height, or at none, gives no point and keeps it.
    assert heights_of(spark, [(2, 35.0)]) == [35.0]
    assert heights_of(spark, [(2, 0.0), (3, 0.0)]) == [0.0, 0.0]


def test_hit_file_keeps_its_header(spark, tmp_path):
    hits = spark.createDataFrame([(0, 0, 5, 1, 0.1, 1, "t"), (0, 7, 5, 1, 0.2, 1, "t")], "event_id long, ref long, det_id long, track_id long, isochrone double, hit_type long, ts string")
    points = spark.createDataFrame([(0, 0, 3.0, 4.0, 1.0)], "event_id long, ref long, tx double, ty double, tz double")
    enriched = io.enrich_hits(hits, points, spark.createDataFrame([(5, 6.0, 8.0, 35.0)], "det_id long, x double, y double, z double"))
    io.write_hits_csv(enriched, f"{tmp_path}/hits")
    (row,) = io.read_hits_csv(spark, f"{tmp_path}/hits").collect()
    assert (row.EvtNum, row.r, row.mr, row.detID, row.timeStamp) == (0, 5.0, 10.0, 5, "t")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).select(F.timestamp_seconds(F.col("id") * 977).alias("ts"), (F.col("id") % 7).alias("det_id"), (F.col("id") * 0.5).alias("value"))
    rows.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([(4_000_000_000, 0, 0.0)], "s long, det_id long, value double").select(F.timestamp_seconds("s").alias("ts"), "det_id", "value")
    last.write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.signals(spark, str(tmp_path / "in"), "ts timestamp, det_id long, value double", files_per_trigger=100)
    windows.write(windows.windowed(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, hits.time_windows(rows).collect()))
    assert [w for w in got if w[0].year < 2000] == want


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["qa_rank", "clone_rank", "global_error", "active_edges", "fit_next", "reconstruct_z", "circle_kasa", "median_spread", "best_match", "merge_tracks", "propose_from_ends", "dedupe_overlap_all", "absorb_all", "circle_hyper", "hits_csv",
    "grown_step", "grown_next", "grown_gather", "grown_leftovers", "grown_chain", "grown_clean", "propose_from_open_ends", "anchors_in_turn", "unwrap_in_turn", "correct_islands", "mahalanobis_pairs", "curved_hits", "classify_with_virtual", "global_error_parity"])
def test_queries_against_sql(spark, name):
    import duckdb

    from trackframe.plans import catalog

    con = duckdb.connect()
    for t in ("part", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    want = con.sql(catalog.oracle_sql()[name]).df()[sorted(got.columns)]
    key = lambda rows: sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))
    assert key(same_rows(got.select(*sorted(got.columns)).collect())) == key(same_rows(want.itertuples(index=False)))


def same_rows(rows):
    return [tuple(None if v is None or v != v else v if isinstance(v, str) else round(float(v), 3) for v in r) for r in rows]


def test_every_query_has_a_name_of_its_own():
    import __spark_entry__ as entry

    names = entry.queries()
    assert len(names) > 140 and set(entry.oracle_sql()) <= set(names)
