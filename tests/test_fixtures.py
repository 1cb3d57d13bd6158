"""The fixture views on many nodes and hits: no broadcast, the same rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from trackframe.operators import fits, graph
from trackframe.plans import catalog
from trackframe.sources import fixtures

SF = "/root/testdata/sf0.01"


def compared(spark, folder, name, digits=3):
    """Rows of a query and of its SQL over the tables of a folder, each in order."""
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet*/*.parquet')" if (folder / f"{t}.parquet").is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = catalog.queries()[name](spark, str(folder))
    want = con.sql(catalog.oracle_sql()[name]).df()[sorted(got.columns)]
    plain = lambda rows: sorted((tuple(None if v is None or v != v else v if isinstance(v, str) else round(float(v), digits) for v in r) for r in rows), key=lambda r: tuple((v is None, v or 0) for v in r))
    return plain(got.select(*sorted(got.columns)).collect()), plain(want.itertuples(index=False))


@pytest.fixture
def many(monkeypatch):
    """The way of large tables, on small ones."""
    monkeypatch.setattr(fixtures, "MOST_SENT", 0)
    monkeypatch.setattr(fixtures, "ONE_SHUFFLE", 0)
    monkeypatch.setattr(fixtures, "ONE_TASK", 10_000)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_nodes_are_not_broadcast(spark, tmp_path):
    """Part's files are small even where its nodes are many, and Spark would send these to the driver."""
    spark.range(300_000).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    nodes, edges, hits = (fixtures.view(spark, str(tmp_path), n) for n in ("f_nodes", "f_edges", "f_hits"))
    assert "Broadcast" not in plan(edges)
    assert "Broadcast" not in plan(edges.join(nodes.select(F.col("det_id").alias("src"), "layer").filter("layer > 3"), "src"))
    assert "Join" not in plan(hits) and plan(hits).count("Exchange") == 1


def test_views_of_many_nodes_have_the_same_rows(spark, many, monkeypatch):
    got = {n: sorted(fixtures.view(spark, SF, n).collect(), key=str) for n in ("f_edges", "f_hits", "f_reco")}
    monkeypatch.undo()
    for name, rows in got.items():
        assert rows == sorted(fixtures.view(spark, SF, name).collect(), key=str), name


def test_hits_of_nodes_that_are_missing_are_left_out(spark, many, tmp_path):
    """Where rings lack nodes, hits are joined with those that are there."""
    spark.read.parquet(f"{SF}/part.parquet").filter("p_partkey % 7 <> 3").write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = compared(spark, tmp_path, "initial_coords")
    assert got == want and 0 < len(got)


@pytest.mark.parametrize("span", (1, 50))
def test_virtual_nodes_are_numbered_by_spans(spark, monkeypatch, span):
    monkeypatch.setattr(graph, "SPAN", span)
    from pathlib import Path

    got, want = compared(spark, Path(SF), "virtual_nodes")
    assert got == want


@pytest.mark.parametrize("name", ("active_edges", "active_virtuals"))
def test_active_edges_beyond_what_is_broadcast(spark, monkeypatch, name):
    """Edges to nodes that did not fire are not dealt: none of the shuffles by event has rows by (event, node)."""
    from pathlib import Path

    monkeypatch.setattr(graph, "MOST_EDGES", 0)
    got, want = compared(spark, Path(SF), name)
    assert got == want
    nodes = spark.createDataFrame([(d, 1, 0) for d in (1, 2, 3)], "det_id long, node_type long, layer long")
    fired = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 1)], "event_id long, det_id long")
    found = graph.active_edges(spark.createDataFrame([(1, 2), (1, 3), (2, 9)], "src long, dst long"), fired, nodes)
    assert sorted((r.event_id, r.src, r.dst) for r in found.collect()) == [(0, 1, 2), (0, 1, 3)]
    assert "hashpartitioning(event_id#" in plan(found) and "dst#" not in "".join(line for line in plan(found).splitlines() if "hashpartitioning(event_id" in line)


@pytest.mark.parametrize("name", ("classify_with_virtual", "correct_islands", "grown_leftovers", "nearest_virtual"))
def test_virtual_nodes_where_a_tube_lies_across_the_axis(spark, tmp_path, name):
    """With an odd number of rings a skewed tube's azimuth is next to 0 or a half turn; its slope has the sign of that azimuth, however small."""
    spark.range(468).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = compared(spark, tmp_path, name)
    assert got == want


def test_two_points_have_no_circle(spark):
    """On a line both ends of the fit's quotients are rounding, which engines do differently."""
    far, turn = 0.5 + F.col("id") % 41, F.col("id") * 0.37
    two = spark.range(4000).select("id", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"), far.alias("far"), turn.alias("turn"))
    points = two.select("id", (-3.277779 + F.col("t") * F.col("far") * F.cos("turn")).alias("x"), (-15.660657 + F.col("t") * F.col("far") * F.sin("turn")).alias("y"))
    assert fits.circle(points, ["id"]).filter("r IS NOT NULL").count() == 0
    arc = spark.range(30).select(F.floor(F.col("id") / 3).alias("g"), (20 * F.cos(F.col("id") / 20)).alias("x"), (20 * F.sin(F.col("id") / 20)).alias("y"))
    assert all(abs(r.r - 20) < 0.01 for r in fits.circle(arc, ["g"]).collect())


@pytest.mark.parametrize("name", ("anchors", "covariance"))
def test_tracks_of_many_hits_are_dealt_over_tasks_of_bounded_size(spark, many, name):
    """What sorts and groups tracks stays in the tasks that hits are dealt over; a shuffle by track would be put together by bytes."""
    from pathlib import Path

    got, want = compared(spark, Path(SF), name)
    assert got == want
    text = plan(catalog.queries()[name](spark, SF))
    assert "REPARTITION_BY_NUM" in text and "hashpartitioning(event_id" in text
    assert not [line for line in text.splitlines() if "Exchange hashpartitioning(event_id" in line and "REPARTITION_BY_NUM" not in line]


@pytest.mark.parametrize("name", ("correct_skew", "reconstruct_z"))
def test_corrections_of_many_hits_run_in_tasks_of_bounded_size(spark, many, name):
    """Members that meet their tubes are laid out once and dealt by event; what is stored between comes from several tasks."""
    from pathlib import Path

    got, want = compared(spark, Path(SF), name)
    assert got == want
    found = catalog.queries()[name](spark, SF)
    assert len(found.inputFiles()) > 1
    assert name == "correct_skew" or "REPARTITION_BY_NUM" in plan(found)


def test_file_of_hits_is_compressed(spark):
    from pathlib import Path

    got, want = compared(spark, Path("/root/testdata/sf0.001"), "hits_csv")
    assert got == want
    assert all(f.endswith(".csv.gz") for f in catalog.queries()["hits_csv"](spark, "/root/testdata/sf0.001").inputFiles())


@pytest.mark.parametrize("name", ("residuals", "mean_residuals", "overlap", "step_direction"))
def test_what_goes_by_event_is_dealt_by_event_alone(spark, many, name):
    """Found tracks, matches, members and points meet in the tasks that hits are dealt over, without a shuffle by track or by event and node."""
    from pathlib import Path

    got, want = compared(spark, Path(SF), name)
    assert got == want
    text = plan(catalog.queries()[name](spark, SF))
    assert "REPARTITION_BY_NUM" in text
    assert not [line for line in text.splitlines() if "Exchange hashpartitioning(event_id" in line and "REPARTITION_BY_NUM" not in line]


@pytest.mark.parametrize("name", ("residuals_of_perfect", "global_error_parity"))
def test_scores_do_not_deal_members_again(spark, many, name):
    """Beside the deal by event only tables of one row a track or event are shuffled by these."""
    from pathlib import Path

    got, want = compared(spark, Path(SF), name)
    assert got == want
    text = plan(catalog.queries()[name](spark, SF))
    again = [line for line in text.splitlines() if "Exchange hashpartitioning(event_id" in line and "REPARTITION_BY_NUM" not in line]
    assert not [line for line in again if "det_id" in line]


@pytest.mark.parametrize("name", ("complex_tracks", "complex_tracks_parity"))
def test_complex_tracks_send_nothing_through_the_driver(spark, many, name):
    """A table guessed small from its files was broadcast, however many rows it had."""
    from pathlib import Path

    got, want = compared(spark, Path(SF), name)
    assert got == want
    assert "Broadcast" not in plan(catalog.queries()[name](spark, SF))


def test_links_of_ends_send_nothing_through_the_driver(spark, many):
    """Ends of tracks and what they propose grow with the events, and were broadcast where they take few bytes."""
    from pathlib import Path

    got, want = compared(spark, Path(SF), "grown_chain")
    assert got == want
    assert "Broadcast" not in plan(catalog.queries()["grown_chain"](spark, SF))
