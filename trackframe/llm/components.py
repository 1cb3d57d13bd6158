"""Connected components of a large edge table by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.storage import salted_join, stored


def _jump(parents: DataFrame) -> DataFrame:
    """Replaces every parent by its own parent until all point at their roots.

    A node that most others point at is a hot key, whose rows are salted.
    """
    while True:
        up = parents.filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("above"))
        parents = stored(
            salted_join(parents, up, ["root"], ["node"], "left").select(
                "node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")
            ),
            "jump",
        )
        if parents.filter("moved").isEmpty():
            return parents.select("node", "root")
        parents = parents.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, root): the smallest node that each node reaches.

    Each round hooks every node to its smallest neighbour, jumps pointers to
    the roots and contracts the edges to roots.  Loops and repeated edges are
    allowed; nodes without an edge are not returned.  The work of a round is
    grouped minima, pre-aggregated on the map side, and joins in which nodes of
    a high degree are salted; every round is stored in the shared folder.
    """
    edges = stored(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"))
        hooks = both.groupBy("e.node").agg(F.min("e.other").alias("other"))
        roots = _jump(stored(hooks.select("node", F.least("node", "other").alias("root")), "hooks"))
        rounds.append(roots)
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        named = stored(salted_join(edges, left, ["a"], ["b"]), "named")
        edges = stored(
            salted_join(named, right, ["b"], ["a"]).filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for later in rounds[1:]:
        up = later.select(F.col("node").alias("root"), F.col("root").alias("above"))
        found = stored(salted_join(found, up, ["root"], ["node"], "left").select("node", F.coalesce("above", "root").alias("root")), "found")
    return found
