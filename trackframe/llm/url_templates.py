"""URL filters by a tree of path templates, in DataFrame operations alone.

Per host, the segments of paths are the levels of a tree, as deep as the
deepest path; stretches in which all paths below a parent agree are passed at
once, so that the number of rounds is that of branchings.  Numbers, dates and hashes become wildcards at once, and equal
shapes are counted together.  Level by level, a branch becomes a wildcard if
its parent has nearly as many branches as pages (a variable segment); the other
branches of a parent are put in order of their smoothed labelled rates and
merged while neighbours' rates do not differ significantly (similar branches).
A template's purity is the share of clean pages among its labelled ones,
smoothed towards the share of all; too low a purity rejects the template.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.storage import salted_join, stored


@dataclass(frozen=True)
class Tree:
    """Limits of the tree."""

    branches: int = 8  # a variable segment has at least so many under its parent,
    share: float = 0.5  # and at least so many for each page
    z: float = 1.96  # similar rates are within so many standard errors of each other
    steps: int = 20  # that smoothed rates are rounded to; equal ones are merged at once
    weight: float = 4.0  # labelled pages that the smoothing counts for
    least_purity: float = 0.5


@dataclass(frozen=True)
class Rule:
    """A rule on a host with its subdomains and the beginning of a path."""

    verdict: str
    host: str
    path: str


#: The fixed rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, A to Z lower-cased; empty without ://."""
    host = F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _after(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does.  The rules are few and part of the plan."""
    fitting = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        fitting = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(fitting)
    return fitting


def shape_of(path: Column) -> Column:
    """A path's segments, those that are plainly variable as wildcards: numbers (with an ending), dates, hashes and identifiers."""
    shaped = reduce(
        lambda p, rule: F.regexp_replace(p, *rule),
        [
            (r"(?<=/)[0-9]{4}-[0-9]{2}-[0-9]{2}(?=/|$)", "{date}"),
            (r"(?<=/)[0-9]+(?=\.[a-z]{1,5}$|/|$)", "{number}"),
            (r"(?<=/)[0-9a-f]{8}-[0-9a-f-]{27}(?=/|$)", "{uuid}"),
            (r"(?<=/)(?=[^/]*[0-9])[0-9a-fA-F]{8,}(?=\.[a-z]{1,5}$|/|$)", "{hash}"),
        ],
        path,
    )
    return F.regexp_replace(shaped, "^/", "")


def templates(pages: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """(host, shape, bad) -> (host, shape, template, labelled, bad, purity), a row for each host and shape.

    ``bad`` is 1, 0 or null for a page without a label.  Pages are counted by
    host and shape first; all later steps work on these counts.  Parents with
    many branches, and hosts with many shapes, are hot keys and joined salted.
    """
    leaves = pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("b"))
    leaves = stored(leaves, "leaves")
    total = leaves.agg(F.sum("l"), F.sum("b")).first()
    rate = (total[1] / total[0]) if total[0] else 0.0
    now, done = _along(leaves.withColumn("rest", F.split("shape", "/")).withColumn("template", F.lit(""))), []
    while True:
        done.append(now.filter("segment IS NULL").drop("rest", "segment"))
        now = now.filter("segment IS NOT NULL")
        if now.isEmpty():
            break
        marked = salted_join(now, _marks(now, tree), ["host", "template", "segment"], ["shape"])
        now = _along(marked.select("host", "shape", "n", "l", "b", F.expr("slice(rest, 2, size(rest))").alias("rest"), F.concat("template", F.lit("/"), "mark").alias("template")))
    every = reduce(DataFrame.unionByName, done)
    pure = every.groupBy("host", "template").agg(F.sum("l").alias("labelled"), F.sum("b").alias("bad"))
    purity = 1 - (F.col("bad") + tree.weight * F.lit(rate)) / (F.col("labelled") + tree.weight)
    pure = pure.withColumn("purity", F.round(purity, 9))
    return salted_join(every.select("host", "shape", "template"), pure, ["host", "template"], ["shape"]).select("host", "shape", "template", "labelled", "bad", "purity")


def _along(now: DataFrame) -> DataFrame:
    """Leaves (host, template, rest) moved along the segments that all leaves of their parent have in common, with the next segment (null at a path's end); stored."""
    now = stored(now, "level")
    both = now.groupBy("host", "template").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    agreed = F.aggregate(
        F.sequence(F.lit(0), F.least(F.size("low"), F.size("high"))), F.lit(0),
        lambda n, k: F.when((n == k) & (k < F.size("low")) & (F.get("low", k) == F.get("high", k)), n + 1).otherwise(n),
    )
    both = both.select("host", "template", agreed.alias("same")).filter("same > 0")
    moved = salted_join(now, both, ["host", "template"], ["shape"], "left").withColumn("same", F.coalesce("same", F.lit(0)))
    path = F.concat("template", F.array_join(F.transform(F.slice("rest", F.lit(1), F.col("same")), lambda x: F.concat(F.lit("/"), x)), ""))
    moved = moved.select("host", "shape", "n", "l", "b", F.expr("slice(rest, same + 1, size(rest))").alias("rest"), path.alias("template"))
    return stored(moved.withColumn("segment", F.get("rest", F.lit(0))), "along")


def _marks(now: DataFrame, tree: Tree) -> DataFrame:
    """Leaves (host, template, segment, n, l, b) -> (host, template, segment, mark): what each branch's segment becomes."""
    parent = ["host", "template"]
    branch = stored(now.groupBy(*parent, "segment").agg(*(F.sum(c).alias(f"{c}1") for c in "nlb")), "branches")
    above = branch.groupBy(*parent).agg(F.count("*").alias("k"), *(F.sum(f"{c}1").alias(f"{c}0") for c in "nlb"))
    p = F.when(F.col("l0") > 0, F.col("b0") / F.col("l0")).otherwise(0.0)
    smoothed = (F.col("b1") + tree.weight * p) / (F.col("l1") + tree.weight)
    variable = (F.col("k") >= tree.branches) & (F.col("k") >= tree.share * F.col("n0"))
    branch = stored(
        salted_join(branch, above, parent, ["segment"]).select(*parent, "segment", "l1", "b1", F.when(~variable, F.round(smoothed * tree.steps).cast("int")).alias("place")), "placed"
    )
    # At most steps + 1 places a parent, so that the list below is short whatever the number of branches.
    places = branch.filter("place IS NOT NULL").groupBy(*parent, "place").agg(F.count("*").alias("k"), F.sum("l1").alias("l"), F.sum("b1").alias("b"))
    listed = places.groupBy(*parent).agg(F.array_sort(F.collect_list(F.struct("place", "k", "l", "b"))).alias("places"))

    def merged(s: Column, x: Column) -> Column:
        u, v = (s.b + 1) / (s.l + 2), (x.b + 1) / (x.l + 2)
        apart = (s.l > 0) & (x.l > 0) & (F.abs(u - v) > tree.z * F.sqrt(u * (1 - u) / (s.l + 2) + v * (1 - v) / (x.l + 2)))
        group = F.when(apart, s.group + 1).otherwise(s.group)
        own = F.array(F.struct(x.place.alias("place"), x.k.alias("k"), group.alias("group")))
        l, b = (F.when(apart, x[c]).otherwise(s[c] + x[c]).alias(c) for c in "lb")
        return F.struct(l, b, group.alias("group"), F.concat(s.out, own).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("b"), F.lit(1).alias("group"), F.array().cast("array<struct<place: int, k: long, group: int>>").alias("out"))
    groups = listed.select(*parent, F.explode(F.aggregate("places", start, merged)["out"]).alias("o")).select(*parent, "o.place", "o.k", "o.group")
    groups = groups.withColumn("size", F.sum("k").over(Window.partitionBy(*parent, "group")))
    groups = groups.withColumn("several", F.size(F.collect_set(F.when(F.col("size") > 1, F.col("group"))).over(Window.partitionBy(*parent))))
    found = salted_join(branch, groups.drop("k"), [*parent, "place"], ["segment"], "left")
    mark = F.when(F.col("place").isNull() | ((F.col("size") > 1) & (F.col("several") == 1)), "*").when(F.col("size") > 1, F.concat(F.lit("*"), F.col("group").cast("string"))).otherwise(F.col("segment"))
    return found.select(*parent, "segment", mark.alias("mark"))


def judge(pages: DataFrame, bad: DataFrame, rules: tuple[Rule, ...] = RULES, tree: Tree = Tree()) -> DataFrame:
    """pages -> (page_id, host, path, rule, verdict, template, purity), a row for each row of ``pages``.

    ``bad`` has (page_id, bad): 1 or 0 for labelled pages; a page that it
    names several times is bad if any row says so.  A fixed rule decides where
    one fits, else the purity of the page's template does.  Null urls and
    those without :// have an empty host and path, and share one template.
    Repeated rows come back as often as they came, a null page_id has no label;
    without any label everything is allowed that no rule blocks.  Urls of any
    length and depth are judged whole; an empty table gives an empty one.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    own = own.withColumn("shape", shape_of(F.col("path")))
    labels = bad.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    known = templates(own.join(labels, "page_id", "left").select("host", "shape", "bad"), tree)
    ruled = own.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("purity") < tree.least_purity, "block").otherwise("allow")
    return salted_join(ruled, stored(known.select("host", "shape", "template", "purity"), "known"), ["host", "shape"], ["page_id", "path"]).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), "template", "purity"
    )


def document_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) for pages that show a labelled document, whose id is the first number among the path's segments.

    Bad is a document of low quality or a toxic one.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?=\.[a-z]+$|/|$)", 1)
    shown = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
    known = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    return shown.join(known, "doc_id").select("page_id", "bad")
