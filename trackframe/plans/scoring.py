"""Queries that score found tracks against the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.operators import graph, score
from trackframe.plans.registry import query
from trackframe.sources.fixtures import event_tasks

TRUTH = "SELECT event_id, track_id, det_id FROM f_hits GROUP BY ALL"
OVERLAP = "SELECT r.event_id, reco_id, track_id, count(*) AS overlap FROM f_reco r JOIN truth t ON r.event_id = t.event_id AND r.det_id = t.det_id GROUP BY ALL"
SIZES = "SELECT event_id, track_id, count(*) AS l FROM truth GROUP BY ALL"
RSIZES = "SELECT event_id, reco_id, count(DISTINCT det_id) AS rl FROM f_reco GROUP BY ALL"
MORE = {"truth": TRUTH, "ov": OVERLAP, "sz": SIZES, "rsz": RSIZES}
#: A match for queries that need one given: each found track's best true one, where that has no better.
GIVEN = """SELECT event_id, track_id, reco_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY event_id, track_id ORDER BY overlap DESC, reco_id) AS p FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id, reco_id ORDER BY overlap DESC, track_id) AS o FROM ov) WHERE o = 1) WHERE p = 1"""
SYM = "SELECT src, dst FROM f_edges UNION SELECT dst, src FROM f_edges"


def given(v):
    """The match of GIVEN."""
    best = score.best_overlaps(score.overlaps(v("f_reco"), v("f_hits")))
    one = best.groupBy("event_id", "track_id").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "reco_id")).alias("m"))
    return one.select("event_id", "track_id", F.col("m.reco_id").alias("reco_id"), (-F.col("m.o")).alias("overlap"))


def rounded(df, names, digits=5):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("""SELECT t.event_id, t.track_id, s.track_id IS NOT NULL AS shares, g.track_id IS NOT NULL AS gap, s.track_id IS NOT NULL OR g.track_id IS NOT NULL AS complex FROM (SELECT DISTINCT event_id, track_id FROM truth) t
  LEFT JOIN (SELECT DISTINCT a.event_id, a.track_id FROM (SELECT event_id, track_id, det_id AS near FROM truth UNION SELECT event_id, track_id, dst FROM truth JOIN sym ON det_id = src) a JOIN truth b ON a.event_id = b.event_id AND a.near = b.det_id AND a.track_id <> b.track_id) s ON t.event_id = s.event_id AND t.track_id = s.track_id
  LEFT JOIN (SELECT DISTINCT event_id, track_id FROM (SELECT event_id, track_id, det_id AS dst, lag(det_id) OVER (PARTITION BY event_id, track_id ORDER BY seq) AS src FROM f_hits) x WHERE src IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sym WHERE sym.src = x.src AND sym.dst = x.dst)) g ON t.event_id = g.event_id AND t.track_id = g.track_id""",
  "f_hits f_edges", MORE | {"sym": SYM, "ov": "SELECT 1", "rsz": "SELECT 1"})
def complex_tracks(v):
    return score.complex_tracks(v("f_hits"), graph.symmetrise(v("f_edges")), tasks=event_tasks(v("lineitem")))


GAPS = "SELECT event_id, track_id, min(seq) AS first_ FROM (SELECT event_id, track_id, seq, det_id AS dst, lag(det_id) OVER (PARTITION BY event_id, track_id ORDER BY seq) AS src FROM f_hits) x ANTI JOIN sym ON sym.src = x.src AND sym.dst = x.dst WHERE x.src IS NOT NULL GROUP BY ALL"
SEEN = "SELECT h.event_id, h.track_id, det_id FROM f_hits h LEFT JOIN gaps g ON g.event_id = h.event_id AND g.track_id = h.track_id WHERE first_ IS NULL OR seq <= first_"
LATER = "SELECT DISTINCT a.event_id, unnest([a.track_id, b.track_id]) AS track_id FROM (SELECT event_id, track_id, det_id AS near FROM seen UNION SELECT event_id, track_id, dst FROM seen JOIN sym ON det_id = src) a JOIN truth b ON a.event_id = b.event_id AND a.near = b.det_id AND a.track_id < b.track_id"


@query("SELECT t.event_id, t.track_id, s.track_id IS NOT NULL AS shares, g.track_id IS NOT NULL AS gap, s.track_id IS NOT NULL OR g.track_id IS NOT NULL AS complex FROM (SELECT DISTINCT event_id, track_id FROM truth) t LEFT JOIN later s ON t.event_id = s.event_id AND t.track_id = s.track_id LEFT JOIN gaps g ON t.event_id = g.event_id AND t.track_id = g.track_id", "f_hits f_edges", {"truth": TRUTH, "sym": SYM, "gaps": GAPS, "seen": SEEN, "later": LATER})
def complex_tracks_parity(v):
    return score.complex_tracks(v("f_hits"), graph.symmetrise(v("f_edges")), parity=True, tasks=event_tasks(v("lineitem")))


@query("SELECT * FROM ov", "f_hits f_reco", MORE)
def overlap(v):
    return score.overlaps(v("f_reco"), v("f_hits"))


def _global(parity: bool = False) -> str:
    figures = [("under", 1, "u"), ("over", 0, "o"), ("total", 1, "sqrt(u ** 2 + o ** 2) / area"), ("under_norm", 1, "u / area"), ("over_norm", 0, "o / area"), ("total_norm", 1, "sqrt((u / area) ** 2 + (o / area) ** 2)")]
    return f"""SELECT n.event_id, CASE WHEN n_reco IS NULL THEN n_all ELSE n_truth END AS n_truth, coalesce(n_reco, 0) AS n_reco, {", ".join(f"round(CASE WHEN n_reco IS NULL THEN {d} ELSE {c} END, 5) AS {k}" for k, d, c in figures)}
      FROM counted n LEFT JOIN area USING (event_id) LEFT JOIN (SELECT event_id, count(*) AS n_reco, coalesce(sum(CASE WHEN m > 0 THEN (l - m) * m / l ELSE {"'nan'::DOUBLE" if parity else 0} END) FILTER (used), 0)::DOUBLE AS u, coalesce(sum(rl - coalesce(m, 0)) FILTER (used), 0)::DOUBLE AS o
        FROM judged GROUP BY event_id) r USING (event_id)"""


def _global_more(more: int, least: int) -> dict[str, str]:
    return MORE | {
        "counted": f"SELECT event_id, count(*) AS n_all, count(*) FILTER (l > {more}) AS n_truth FROM sz GROUP BY event_id",
        "area": f"SELECT h.event_id, count(*) AS area FROM f_hits h SEMI JOIN (SELECT * FROM sz WHERE l > {more}) b ON h.event_id = b.event_id AND h.track_id = b.track_id GROUP BY ALL",
        "judged": f"""SELECT r.event_id, r.reco_id, r.rl, r.rl >= {least} AS used, b.overlap AS m, b.l FROM rsz r LEFT JOIN (SELECT ov.*, sz.l, row_number() OVER (PARTITION BY ov.event_id, ov.reco_id ORDER BY overlap DESC, ov.track_id) AS place FROM ov JOIN sz ON sz.event_id = ov.event_id AND sz.track_id = ov.track_id WHERE l > {more}) b
          ON b.event_id = r.event_id AND b.reco_id = r.reco_id AND place = 1""",
    }


ERRORS = ["under", "over", "total", "under_norm", "over_norm", "total_norm"]


@query(_global(), "f_hits f_reco", _global_more(5, 5))
def global_error(v):
    return rounded(score.global_error(v("f_reco"), v("f_hits")), ERRORS)


@query(_global(), "f_hits f_reco", _global_more(0, 1))
def global_error_all(v):
    return rounded(score.global_error(v("f_reco"), v("f_hits"), more_than=0, least=1), ERRORS)


@query(_global(True), "f_hits f_reco", _global_more(5, 5) | {"ov": "SELECT r.event_id, reco_id, track_id, count(*) AS overlap FROM (SELECT DISTINCT event_id, reco_id, det_id FROM f_reco WHERE NOT (event_id % 5 = 0 AND reco_id = 1)) r JOIN truth USING (event_id, det_id) GROUP BY ALL"})
def global_error_parity(v):
    """Where the found track 1 of every fifth event lies on no fired node, its event's errors are NaN."""
    away = v("f_reco").withColumn("det_id", F.when((F.col("event_id") % 5 == 0) & (F.col("reco_id") == 1), -F.col("det_id")).otherwise(F.col("det_id")))
    return rounded(score.global_error(away, v("f_hits"), parity=True), ERRORS)


#: True tracks in turn, each with its found ones by preference; an event's state is the list of found ones that are taken.
GREEDY = """SELECT event_id, track_id, m.r AS reco_id, m.o AS overlap FROM (WITH RECURSIVE g(event_id, i, used, track_id, m) AS (
  SELECT DISTINCT event_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::STRUCT(r BIGINT, o BIGINT) FROM turns UNION ALL
  SELECT event_id, i, CASE WHEN m IS NULL THEN used ELSE list_append(used, m.r) END, track_id, m FROM (
    SELECT g.event_id, t.i, g.used, t.track_id, list_filter(p.p, lambda x: NOT list_contains(g.used, x.r))[1] AS m FROM g JOIN turns t ON t.event_id = g.event_id AND t.i = g.i + 1
    LEFT JOIN prefs p ON p.event_id = t.event_id AND p.track_id = t.track_id)) SELECT * FROM g) WHERE m IS NOT NULL"""

TURNS = "SELECT event_id, track_id, row_number() OVER (PARTITION BY event_id ORDER BY l DESC, track_id) AS i FROM sz"
PREFS = "SELECT event_id, track_id, list({'r': reco_id::BIGINT, 'o': overlap::BIGINT} ORDER BY overlap DESC, reco_id) AS p FROM ov GROUP BY ALL"


@query(GREEDY, "f_hits f_reco", MORE | {"turns": TURNS, "prefs": PREFS})
def best_match(v):
    return score.best_match(v("f_reco"), v("f_hits"))


@query("SELECT s.event_id, s.track_id, coalesce(g.reco_id, -1) AS match, l AS truth_len, coalesce(rl, -1) AS reco_len, coalesce(overlap, -1) AS inter, coalesce(l + rl - overlap, -1) AS union, round(coalesce(2 * overlap / (l + rl), 0), 6) AS f1 FROM sz s LEFT JOIN given g ON s.event_id = g.event_id AND s.track_id = g.track_id LEFT JOIN rsz r ON g.event_id = r.event_id AND g.reco_id = r.reco_id", "f_hits f_reco", MORE | {"given": GIVEN})
def f1_score(v):
    return rounded(score.f1_scores(given(v), v("f_reco"), v("f_hits")), ["f1"], 6)


RESIDUALS = """SELECT r.event_id, r.track_id, r.det_id, round(x - tx, 5) AS dx, round(y - ty, 5) AS dy, round(CASE WHEN kinds >= 2 THEN z - tz ELSE 200 END, 5) AS dz FROM (
  SELECT g.event_id, g.track_id, g.reco_id, r.det_id, n.x, n.y, n.z, arg_min(h.tx, ((n.x - h.tx) ** 2 + (n.y - h.ty) ** 2, seq)) AS tx, arg_min(h.ty, ((n.x - h.tx) ** 2 + (n.y - h.ty) ** 2, seq)) AS ty, arg_min(h.tz, ((n.x - h.tx) ** 2 + (n.y - h.ty) ** 2, seq)) AS tz
  FROM given g JOIN f_reco r ON g.event_id = r.event_id AND g.reco_id = r.reco_id JOIN truth t ON t.event_id = g.event_id AND t.track_id = g.track_id AND t.det_id = r.det_id JOIN f_nodes n ON n.det_id = r.det_id JOIN f_hits h ON h.event_id = g.event_id AND h.track_id = g.track_id GROUP BY ALL) r
  JOIN (SELECT event_id, reco_id, count(DISTINCT node_type) AS kinds FROM f_reco r JOIN f_nodes n ON r.det_id = n.det_id GROUP BY ALL) k ON r.event_id = k.event_id AND r.reco_id = k.reco_id"""


@query(RESIDUALS, "f_hits f_reco f_nodes", MORE | {"given": GIVEN})
def residuals(v):
    return rounded(score.residuals(given(v), v("f_reco"), v("f_hits"), v("f_nodes"), event_tasks(v("lineitem"))), ["dx", "dy", "dz"])


@query("SELECT event_id, track_id, count(*) AS n, round(avg(abs(dx)), 11) AS mean_dx, round(avg(abs(dy)), 11) AS mean_dy, round(avg(abs(dz)), 11) AS mean_dz FROM res GROUP BY ALL", "f_hits f_reco f_nodes", MORE | {"given": GIVEN, "res": RESIDUALS})
def mean_residuals(v):
    found = rounded(score.residuals(given(v), v("f_reco"), v("f_hits"), v("f_nodes"), event_tasks(v("lineitem"))), ["dx", "dy", "dz"])
    return rounded(score.mean_residuals(found), ["mean_dx", "mean_dy", "mean_dz"], 11)


@query("SELECT o.event_id, o.reco_id, max(o.track_id) AS track_id, max(rl) - arg_max(overlap, o.track_id) AS extra FROM ov o JOIN sz s ON o.event_id = s.event_id AND o.track_id = s.track_id AND overlap = l JOIN rsz r ON o.event_id = r.event_id AND o.reco_id = r.reco_id GROUP BY o.event_id, o.reco_id", "f_hits f_reco", MORE)
def contained_match(v):
    return score.contained_match(v("f_reco"), v("f_hits"))


RANKS = """SELECT event_id, reco_id, track_id, overlap, truth_len, reco_len, CASE WHEN overlap = truth_len AND overlap = reco_len THEN 1 WHEN overlap = truth_len AND overlap / reco_len >= 0.7 THEN 2 WHEN overlap = reco_len AND overlap / truth_len > 0.7 THEN 3
  WHEN overlap / reco_len >= 0.7 THEN 4 ELSE 5 END AS rank FROM (SELECT o.event_id, o.reco_id, o.track_id, overlap, l AS truth_len, rl AS reco_len, row_number() OVER (PARTITION BY o.event_id, o.reco_id ORDER BY overlap DESC, l DESC, o.track_id) AS p
  FROM ov o JOIN sz s ON o.event_id = s.event_id AND o.track_id = s.track_id JOIN rsz r ON o.event_id = r.event_id AND o.reco_id = r.reco_id WHERE rl >= 5) WHERE p = 1"""


@query(RANKS, "f_hits f_reco", MORE)
def qa_rank(v):
    return score.qa_ranks(v("f_reco"), v("f_hits"))


@query("SELECT * EXCLUDE (p, rank), p > 1 AND rank <> 5 AS clone, CASE WHEN p > 1 AND rank <> 5 THEN 6 ELSE rank END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id, track_id ORDER BY rank, reco_id) AS p FROM ranks)", "f_hits f_reco", MORE | {"ranks": RANKS})
def clone_rank(v):
    return score.mark_clones(score.qa_ranks(v("f_reco"), v("f_hits")))


def _ids(name: str) -> str:
    return f"array_to_string(list_sort({name}), ',') "


@query(f"SELECT event_id, reco_id, track_id, {_ids('list_intersect(a, b)')} AS both, {_ids('list_distinct(list_concat(a, b))')} AS either, {_ids('list_filter(a, lambda x: NOT list_contains(b, x))')} AS only_a, {_ids('list_filter(b, lambda x: NOT list_contains(a, x))')} AS only_b FROM given g JOIN (SELECT event_id, track_id, list(det_id) AS a FROM truth GROUP BY ALL) t USING (event_id, track_id) JOIN (SELECT event_id, reco_id, list(det_id) AS b FROM f_reco GROUP BY ALL) r USING (event_id, reco_id)", "f_hits f_reco", MORE | {"given": GIVEN})
def set_algebra(v):
    a = score.truth_nodes(v("f_hits")).groupBy("event_id", "track_id").agg(F.collect_set("det_id").alias("a"))
    b = v("f_reco").groupBy("event_id", "reco_id").agg(F.collect_set("det_id").alias("b"))
    pairs = given(v).select("event_id", "track_id", "reco_id").join(a, ["event_id", "track_id"]).join(b, ["event_id", "reco_id"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return score.set_algebra(pairs, "a", "b").select("event_id", "reco_id", "track_id", *(text(c) for c in ("both", "either", "only_a", "only_b")))


@query("""SELECT n.event_id, n.track_id, n.l AS n FROM sz n WHERE n.l >= 5 AND NOT EXISTS (SELECT 1 FROM (SELECT a.event_id, a.track_id AS ta, b.track_id AS tb, count(*) AS m FROM truth a JOIN truth b ON a.event_id = b.event_id AND a.det_id = b.det_id AND a.track_id <> b.track_id GROUP BY ALL) p
  JOIN sz o ON o.event_id = p.event_id AND o.track_id = p.tb AND o.l >= 5 WHERE p.event_id = n.event_id AND p.ta = n.track_id AND m > 0.66 * least(n.l, o.l) AND (o.l > n.l OR (o.l = n.l AND p.tb < p.ta)))""", "f_hits f_reco", MORE)  # fmt: skip
def valid_tracks_by_overlap(v):
    return score.without_overlapped(score.truth_nodes(v("f_hits")))
