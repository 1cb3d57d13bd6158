"""Operators on pages and conversations against brute force."""

import gzip
import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("trackframe.llm")
from trackframe.llm import arc_to_warc, chat_snapshots, url_templates  # noqa: E402


def clashing(df, *names):
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit(7))
    return df


def pages():
    long = "<p>" + "é" * 300 + "\nWARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n</p>"
    rows = [(k, f"http://a.example/{k}", long if k % 3 == 0 else f"<b>{k}</b>" * 30) for k in range(12)]
    return rows + [(20, None, None), (21, "", ""), (22, "http://b example/\nx é", "short"), (23, "x", "short"), (24, "y", None), (30, "z", "x" * 100), (29, "z", "x" * 100), (31, "z", "x" * 99), (32, "z", "x" * 99)]


@pytest.mark.parametrize("size", [200, 16 << 20])
def test_pages_through_archives(spark, size):
    df = clashing(spark.createDataFrame(pages(), "page_id long, url string, html string"), "digest", "head", "record_id").repartition(3)
    least = {}
    for p, _, h in pages():
        b = (h or "").encode()
        if len(b) >= 100:
            least[b] = min(p, least.get(b, p))
    want = set()
    for p, _, h in pages():
        b = (h or "").encode()
        first = least.get(b, p)
        want.add((p, len(b), hashlib.sha256(b).hexdigest(), "response" if first == p else "revisit", None if first == p else first))
    found = arc_to_warc.through_archives(df, size).collect()
    assert len(found) == len(pages())
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == want


def test_null_and_repeated_page_ids(spark):
    same = "y" * 200
    df = spark.createDataFrame([(None, "u", same), (5, "u", same), (5, "u", same), (None, None, None)], "page_id long, url string, html string")
    found = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in arc_to_warc.through_archives(df).collect())
    assert found == Counter({(5, 200, "response", None): 1, (5, 200, "revisit", 5): 1, (None, 200, "revisit", 5): 1, (None, 0, "response", None): 1})
    assert arc_to_warc.through_archives(df.limit(0)).count() == 0


def test_arc_versions_and_errors():
    for version in (1, 2):
        block = arc_to_warc.http_message(b"payload\n\nwith lines", 3)
        body = arc_to_warc.version_block(version, "n.arc", "20080430204825")
        record = arc_to_warc.arc_record(version, "http://a/", "20080430204825", block, len(body), "n.arc")
        for content in (body + record + record, gzip.compress(body) + gzip.compress(record) + gzip.compress(record)):
            about, first, second = arc_to_warc.parse_arc(content)
            assert about["URL"] == "filedesc://n.arc" and about["at"] == 0
            assert first["URL"] == "http://a/" and first["block"] == second["block"] == block and first["at"] < second["at"]
            assert set(first) == {*arc_to_warc.FIELDS[version], "archive", "at", "block"}
        with pytest.raises(ValueError):
            list(arc_to_warc.parse_arc((body + record)[:-9]))
    with pytest.raises(ValueError):
        list(arc_to_warc.parse_arc(b"http://a/ 0.0.0.0 20080430204825 text/html 3\nabc\n"))
    assert arc_to_warc.split_http(b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nx") == (b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n", b"x")
    assert arc_to_warc.split_http(b"plain") == (b"", b"plain")
    assert [arc_to_warc.arc_date(d) for d in ("20080430204825", "200804302048", "x")] == ["2008-04-30T20:48:25Z", "2008-04-30T20:48:00Z", "1970-01-01T00:00:00Z"]


def slow_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, after = rest[:cut], rest[cut:]
    end = min((after.find(c) for c in "?#" if c in after), default=len(after))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), after[:end]


def slow_rule(host, path):
    fits = [r for r in url_templates.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://ExAmple.COM", "http://É.com/a", "https://a.net/es/1", "https://net/es/", "https://xnet/es/", "http://www.example.com/en/3?x#y", "http://example.com/en/4", "http://example.com/En/4"]
URLS += ["a://b://c/d", "http://h.org?x/y", "http://h.org#x", "http://com/", "http://a.com", "http://a.com:80/", "http://h\n.org/p\nq?", "http://net/fr/1/2/3/4/5/6/7/8/9/10/11"]


def test_hosts_paths_and_rules(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(None, "http://x.com/1"), (3, URLS[3])]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string"), "host", "shape", "template", "bad")
    found = url_templates.judge(df, spark.createDataFrame([], "page_id long, bad int")).collect()
    assert Counter((r.page_id, r.host, r.path) for r in found) == Counter((k, *slow_url(u)) for k, u in rows)
    for r in found:
        rule, verdict = slow_rule(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or "allow")
    assert url_templates.judge(df.limit(0), spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_templates_and_purity(spark):
    rows = [(k, f"http://good.org/{('a', 'b', 'c')[k % 3]}/{k}.html") for k in range(60)]
    rows += [(100 + k, f"http://bad.org/shop/{k}") for k in range(20)] + [(200 + k, f"http://bad.org/news/{k}") for k in range(20)]
    rows += [(300 + k, f"http://users.org/u{chr(97 + k)}/home") for k in range(20)]
    bad = [(k, 0) for k in range(0, 60, 2)] + [(100 + k, 1) for k in range(15)] + [(100, 1)] + [(200 + k, 0) for k in range(15)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    found = {r.page_id: r for r in url_templates.judge(df, spark.createDataFrame(bad, "page_id long, bad int")).collect()}
    assert {found[k].template for k in range(60)} == {"/*/{number}.html"}  # three branches of the same rate
    assert {found[100 + k].template for k in range(20)} == {"/shop/{number}"} and {found[100 + k].verdict for k in range(20)} == {"block"}
    assert {found[200 + k].template for k in range(20)} == {"/news/{number}"} and {found[200 + k].verdict for k in range(20)} == {"allow"}
    assert {found[300 + k].template for k in range(20)} == {"/*/home"}  # a variable segment
    rate = 15 / (30 + 15 + 15)
    assert abs(found[100].purity - (1 - (15 + 4 * rate) / (15 + 4))) < 1e-6
    assert all(r.verdict == "allow" for k, r in found.items() if not 100 <= k < 120)


def talk():
    t = [("user", "a"), ("assistant", "b <|end|>"), ("user", "c"), ("assistant", None), (None, "d")]
    rows = []
    add = lambda c, turns: rows.extend((c, k, r, x) for k, (r, x) in enumerate(turns))
    add(1, t[:2])
    add(2, t[:4])
    add(3, t)
    add(4, t)
    add(5, [("user", "a"), ("user", "b <|end|>")])
    add(6, t[1:3])
    add(7, [("user", "")])
    add(8, [("user", None)])
    add(9, [(None, "user")])
    add(None, t[:3])
    rows += [(10, 5, "user", "late"), (10, 5, "user", "late"), (10, 2, "user", "early"), (11, None, "user", "q")]
    return rows


def slow_render(rows):
    by = {}
    for c, k, r, t in set(rows):
        by.setdefault(c if c is not None else (k, r, t), []).append((k if k is not None else -1, r or "", t or "", r, t))
    whole = {c: tuple((r, t) for *_, r, t in sorted(v, key=lambda x: x[:3])) for c, v in by.items()}
    out = []
    for c, w in whole.items():
        other = {d: v for d, v in whole.items() if d != c}
        if any(len(v) > len(w) and v[: len(w)] == w for v in other.values()):
            continue
        if any(v == w and not isinstance(d, tuple) and (isinstance(c, tuple) or d < c) for d, v in other.items()):
            continue
        out.append((None if isinstance(c, tuple) else c, len(w), "".join(f"<|{'unknown' if r is None else r}|>\n{(t or '').replace('<|', '< |')}\n<|end|>\n" for r, t in w)))
    return sorted(out, key=str)


def test_snapshots_collapse(spark):
    rows = talk() + [(12, k, "user", f"turn {k} " * (20_000 if k == 3 else 1)) for k in range(500)] + [(13, k, "user", f"turn {k} " * (20_000 if k == 3 else 1)) for k in range(450)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "h", "g", "n", "k", "ts", "alone").repartition(3)
    found = sorted(((r.conv_id, r.n_turns, r.rendered) for r in chat_snapshots.render(df).collect()), key=str)
    assert found == slow_render(rows)
    assert [r[0] for r in found if r[0] is not None] != [] and {r[0] for r in found} == {None, 3, 5, 6, 7, 8, 9, 10, 11, 12}
    assert chat_snapshots.render(df.limit(0)).count() == 0


def slow_templates(pages, tree):
    """(host, shape) -> (template, purity) by loops over the tree; pages are (host, shape, bad)."""
    known = [b for *_, b in pages if b is not None]
    rate = sum(known) / len(known) if known else 0.0
    template = {(h, s): "" for h, s, _ in pages}
    depth = max(s.count("/") + 1 for _, s, _ in pages)
    for level in range(depth):
        parents = {}
        for h, s, bad in pages:
            parts = s.split("/")
            if level < len(parts):
                branch = parents.setdefault((h, template[h, s]), {}).setdefault(parts[level], [0, 0, 0])
                branch[0] += 1
                branch[1] += bad is not None
                branch[2] += bad or 0
        marks = {}
        for parent, branches in parents.items():
            n, l, b = (sum(x[k] for x in branches.values()) for k in range(3))
            if len(branches) >= tree.branches and len(branches) >= tree.share * n:
                marks |= {(*parent, seg): "*" for seg in branches}
                continue
            p = b / l if l else 0.0
            place = {seg: int((x[2] + tree.weight * p) / (x[1] + tree.weight) * tree.steps + 0.5) for seg, x in branches.items()}
            groups, at = [], None
            for k in sorted(set(place.values())):
                own = [seg for seg in branches if place[seg] == k]
                gl, gb = (sum(branches[seg][c] for seg in own) for c in (1, 2))
                if at is not None:
                    u, v = (at[1] + 1) / (at[0] + 2), (gb + 1) / (gl + 2)
                    apart = at[0] and gl and abs(u - v) > tree.z * (u * (1 - u) / (at[0] + 2) + v * (1 - v) / (gl + 2)) ** 0.5
                if at is None or apart:
                    groups.append(own)
                    at = [gl, gb]
                else:
                    groups[-1] += own
                    at = [at[0] + gl, at[1] + gb]
            several = sum(len(g) > 1 for g in groups)
            for number, own in enumerate(groups, 1):
                for seg in own:
                    marks[*parent, seg] = seg if len(own) == 1 else "*" if several == 1 else f"*{number}"
        template = {(h, s): t + "/" + marks[h, t, s.split("/")[level]] if level <= s.count("/") else t for (h, s), t in template.items()}
    out = {}
    for (h, s), t in template.items():
        bads = [b for x, y, b in pages if x == h and template[x, y] == t and b is not None]
        out[h, s] = (t, round(1 - (sum(bads) + tree.weight * rate) / (len(bads) + tree.weight), 9))
    return out


def test_templates_against_loops(spark):
    rng = random.Random(11)
    pages = []
    for host in ("a.org", "b.org", ""):
        for _ in range(400):
            depth = rng.choice([1, 2, 2, 3, 12])
            first = rng.choice(["news", "shop", "spam", "junk", "blog", f"s{rng.randrange(300)}"]) if host != "b.org" else rng.choice(["x", "y"])
            shape = "/".join([first] + [rng.choice(["p", "q", f"v{rng.randrange(40)}"]) for _ in range(depth - 1)])
            worse = {"spam": 0.9, "junk": 0.85, "news": 0.05}.get(first, 0.3)
            pages.append((host, shape, int(rng.random() < worse) if rng.random() < 0.6 else None))
    tree = url_templates.Tree()
    df = spark.createDataFrame(pages, "host string, shape string, bad int").repartition(3)
    found = {(r.host, r.shape): (r.template, r.purity) for r in url_templates.templates(df, tree).collect()}
    assert found == slow_templates(pages, tree)
    tops = {t.split("/")[1] for (h, _), (t, _) in found.items() if h == "a.org"}
    assert any(t.startswith("*") for t in tops)
    assert url_templates.templates(df.limit(0), tree).count() == 0


def crawl(n):
    """An ARC file of a gzip member a record, with a record that is no HTTP message."""
    import gzip

    A = arc_to_warc
    records = [A.version_block(1, "old.arc", "20010203040506")]
    records += [A.arc_record(1, f"http://h.example/{k}", "20010203040506", A.http_message(bytes(f"page {k % 7} ", "ascii") * 40, k), 0, "old.arc") for k in range(n)]
    records.append(A.arc_record(1, "dns:h.example", "20010203040506", b"h.example 3600 IN A 192.0.2.1 " * 5, 0, "old.arc"))
    records.append(records[-1])
    return b"".join(gzip.compress(r, 1) for r in records)


def test_members_resources_and_warcinfo(spark, tmp_path):
    folder = tmp_path / "arcs"
    folder.mkdir()
    (folder / "part-0.arc.gz").write_bytes(crawl(30))
    found = arc_to_warc.convert(spark, str(folder))
    assert {(r.kind, r["count"]) for r in found.groupBy("kind").count().collect()} == {("response", 30), ("resource", 2), ("warcinfo", 1)}
    arc_to_warc.write_warc(arc_to_warc.with_types(found), str(tmp_path / "warcs"))
    rows = arc_to_warc.read_warc(spark, str(tmp_path / "warcs")).collect()
    assert Counter(r.record_type for r in rows) == {"response": 7, "revisit": 23, "resource": 2}
    assert all(r.refers_to == r.page_id % 7 for r in rows if r.record_type == "revisit")
    assert {(r.payload_bytes, r.target) for r in rows if r.record_type == "resource"} == {(150, "dns:h.example")}
    files = b"".join(arc_to_warc.unpacked(f.read_bytes())[0] for f in (tmp_path / "warcs").glob("part-*"))
    fields = [f for f, _ in arc_to_warc.parse_warc(files)]
    assert [f["warc-filename"] for f in fields if f["warc-type"] == "warcinfo"] == ["old.arc"]
    assert all(f["warc-refers-to-target-uri"].startswith("http://h.example/") and f["warc-refers-to-date"] == "2001-02-03T04:05:06Z" for f in fields if f["warc-type"] == "revisit")


def test_many_members_take_linear_time():
    import time

    whole = crawl(40_000)
    began = time.time()
    assert sum(1 for _ in arc_to_warc.parse_arc(whole)) == 40_003
    assert time.time() - began < 20


def test_damaged_archives_are_reported(spark, tmp_path):
    folder = tmp_path / "arcs"
    folder.mkdir()
    whole = crawl(5)
    (folder / "part-0.arc.gz").write_bytes(whole)
    (folder / "part-1.arc.gz").write_bytes(whole[:-20])
    (folder / "part-2.arc").write_bytes(arc_to_warc.unpacked(whole)[0][:-40])
    found = arc_to_warc.convert(spark, str(folder), strict=False)
    assert sorted(r.path.rsplit("/", 1)[1] for r in arc_to_warc.damaged(found).collect()) == ["part-1.arc.gz", "part-2.arc"]
    assert Counter(r.kind for r in found.collect()) == {"response": 15, "resource": 4, "warcinfo": 3, "damaged": 2}
    assert arc_to_warc.with_types(found).filter("record_type = 'damaged'").count() == 0
    with pytest.raises(Exception, match="damaged|no ARC record"):
        arc_to_warc.convert(spark, str(folder)).count()
