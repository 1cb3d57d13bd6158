"""Texts, files and urls made to hurt: long lines, damaged archives, deep paths; and hints against rules without them."""

import gzip
import random
import time

import pytest

pytest.importorskip("trackframe.llm")
from trackframe.llm import arc_to_warc, line_quality, storage, url_templates  # noqa: E402


@pytest.mark.parametrize("line", ["<a " + "x" * 2_000_000, "<" * 1_000_000, "<a" * 500_000, "var " + "x" * 1_000_000, "var" + " " * 1_000_000, "function" * 200_000, "| " * 500_000 + "x", "© " * 400_000])
def test_long_lines_are_judged_in_linear_time(line):
    began = time.time()
    line_quality.judge(line, line_quality.Rules())
    assert time.time() - began < 20


def test_hints_change_no_verdict(spark):
    every = frozenset([*line_quality._HINTS, "symbols"])
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "Lesen Sie die Nutzungsbedingungen.", "a | b | c | d", "wow!! yes?? no!!"]
    rules = line_quality.Rules()
    faults = 0
    for text in texts:
        may = line_quality.hints(text)
        for line in text.split("\n"):
            words = line.encode().split()
            if words:
                found = line_quality.line_fault(line, words, rules, may)
                assert found == line_quality.line_fault(line, words, rules, every)
                faults += found is not None
    assert faults > 100


def test_boilerplate_in_four_languages_and_menus_line_by_line():
    prose = "Ein ganz gewöhnlicher Satz mit genügend vielen Wörtern steht hier, damit der Text lang genug ist und bleibt.\n" + "Noch ein Satz über etwas anderes, der ebenfalls bleiben soll.\n"
    for line in ("All rights reserved.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "Nutzungsbedingungen"):
        found = line_quality.judge(prose + line, line_quality.Rules())
        assert found["line_faults"] == ["boilerplate"] and line not in found["cleaned"]
    found = line_quality.judge("Home\nNews\nShop\n\nContact\nLogin\n" + prose, line_quality.Rules())
    assert found["line_faults"] == ["navigation"] * 5 and found["kept"]
    assert line_quality.judge("One.\nTwo.\nThree.\nFour.\n" + prose, line_quality.Rules())["line_faults"] == []
    assert line_quality.judge("Roses\nViolets\nSugar\n" + prose, line_quality.Rules())["line_faults"] == []


def archive():
    out = [arc_to_warc.version_block(1, "x.arc", "20080430204825")]
    for k in range(20):
        out.append(arc_to_warc.arc_record(1, f"http://a/{k}", "20080430204825", arc_to_warc.http_message(b"body %d" % k, k), 0, "x.arc"))
    return b"".join(out)


def test_damaged_archives_raise_value_errors_only():
    rng, whole = random.Random(7), archive()
    assert len(list(arc_to_warc.parse_arc(whole))) == 21
    for data in (whole, gzip.compress(whole)):
        for _ in range(400):
            own = bytearray(data[: rng.randrange(len(data))] if rng.random() < 0.5 else data)
            for _ in range(rng.randrange(4)):
                if own:
                    own[rng.randrange(len(own))] = rng.randrange(256)
            try:
                for r in arc_to_warc.parse_arc(bytes(own)):
                    arc_to_warc._converted(r)
            except ValueError:
                pass
    for block in (b"1 0 x\n", b"", b"1 0 x\nNAME length\n"):
        with pytest.raises(ValueError):
            list(arc_to_warc.parse_arc(b"filedesc://x 0.0.0.0 20080101 text/plain %d\n" % len(block) + block))
    for data in (b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\n", b"WARC/1.1", b"\xff\xfe\r\n\r\n"):
        with pytest.raises(ValueError):
            list(arc_to_warc.parse_warc(data))


def test_very_long_pages_and_texts(spark, tmp_path):
    """A page of 3 MB among short ones; a text of 300,000 words and its near copy; empty tables."""
    from trackframe.llm import queries, similar_shingles, token_planes

    long = "<p>" + "word " * 600_000
    pages = spark.createDataFrame([(1, "http://a/1", "short"), (2, "http://a/2", long), (3, "http://a/3", long), (4, None, None)], "page_id long, url string, html string")
    found = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in arc_to_warc.through_archives(pages).collect()}
    assert found == {1: (5, "response", None), 2: (len(long), "response", None), 3: (len(long), "revisit", 2), 4: (0, "response", None)}
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(300_000))
    docs = spark.createDataFrame([(1, text), (2, text + " and more"), (3, "another text of some words that stands alone")], "doc_id long, text string")
    assert sorted(r.doc_id for r in similar_shingles.keep_one(docs).collect()) == [1, 3]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert similar_shingles.keep_one(none).collect() == []
    token_planes.write(none, str(tmp_path / "ids"), queries.tokenizer_path())
    assert token_planes.read(spark, str(tmp_path / "ids")).collect() == []


def test_dates_of_the_calendar():
    assert arc_to_warc.arc_date("20080229123456") == "2008-02-29T12:34:56Z"
    assert arc_to_warc.arc_date("20080229") == "2008-02-29T00:00:00Z"
    for bad in ("20080230999999", "00000000", "20081301", "", "2008", "²0080101", "200802291234567"):
        assert arc_to_warc.arc_date(bad) == "1970-01-01T00:00:00Z"


def test_a_url_of_a_thousand_segments(spark):
    deep = "http://trap.example.org/" + "/".join(f"s{k % 7}" for k in range(1000))
    urls = [deep + f"/{e}" for e in ("a", "b", "c")] + [deep, "http://trap.example.org/x/y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    found = {r.page_id: r.template for r in url_templates.judge(pages, spark.createDataFrame([(0, 1), (3, 0)], "page_id long, bad int")).collect()}
    assert time.time() - began < 60
    assert found[3] == "/*/*/" + "/".join(f"s{k % 7}" for k in range(2, 1000)) and found[4] == "/*/*"
    assert found[0] == found[1] == found[2] == found[3] + "/*"


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_joins_of_few_rows(spark, how):
    """Hot, null and absent keys, with salting forced on."""
    left = storage.stored(spark.createDataFrame([(1, k) for k in range(3000)] + [(k, k) for k in range(2, 50)] + [(None, 7), (None, 8), (99, 1)], "k long, v long"), "left")
    right = spark.createDataFrame([(k, k * 10) for k in range(50)] + [(None, 5)], "k long, w long")
    rows = lambda df: sorted((tuple(r) for r in df.select("k", "v", "w").collect()), key=str)
    assert rows(storage.salted_join(left, right, ["k"], ["v"], how, least_rows=0)) == rows(left.join(right, "k", how))
