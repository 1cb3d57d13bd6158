"""The tables that a run leaves behind, by their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.functions.shared import stored
from trackframe.operators import finder, fits, score
from trackframe.sources import io

C = F.col
BY = ["event_id", "track_id"]


def curvatures(members: DataFrame, hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event_id, track_id, truth_r, tube_r, anchor_r, reco_r, px, py, pz, scatter) of matched tracks.

    Radii of circles through the true points, the tubes, the anchors and the
    corrected points; the first true momentum; the scatter angle.
    """
    sets = {
        "truth": hits.select(*BY, C("tx").alias("x"), C("ty").alias("y")), "tube": finder.placed(members, nodes), "anchor": finder.anchors(members, nodes),
        "reco": finder.correct_skew(members, nodes).select(*BY, C("cx").alias("x"), C("cy").alias("y")),
    }
    found = hits.groupBy(*BY).agg(*(F.min_by(c, "seq").alias(c) for c in ("px", "py", "pz")))
    for name, points in sets.items():
        found = found.join(fits.circle(points.select(*BY, "x", "y"), BY).select(*BY, C("r").alias(f"{name}_r")), BY, "left")
    return found.join(finder.reconstruct_z(members, nodes).groupBy(*BY).agg(F.min("scatter").alias("scatter")), BY, "left")


def result_tables(reco: DataFrame, hits: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """The result tables of found tracks (event_id, reco_id, pos, det_id) against their truth; their names are fixed values of the format."""
    matches = stored(score.best_match(reco, hits), "matches")
    members = reco.withColumnRenamed("reco_id", "track_id")
    own = reco.join(matches.select("event_id", "reco_id", "track_id"), ["event_id", "reco_id"]).select(*BY, "pos", "det_id")
    moved = finder.correct_skew(members, nodes)
    return {
        "GlobalEvtError": score.global_error(reco, hits),
        "PerMCTrackError": score.f1_scores(matches, reco, hits),
        "PerTrackCurv": curvatures(own, hits, nodes),
        "PerRecoTrackError": score.mark_clones(score.qa_ranks(reco, hits)),
        "CoordDiff": score.residuals(matches, reco, hits, nodes),
        "ConnectedComponents": io.component_table(reco, matches, nodes),
        "Anchors": finder.anchors(members, nodes),
        "ComponentPerEvt": reco.groupBy("event_id").agg(F.countDistinct("reco_id").alias("n_components")),
        "MCDetID": io.track_id_list(hits),
        "RecoDetID": io.track_id_list(reco, "reco_id"),
        "CoordCollected": io.member_coords(moved, nodes),
    }
