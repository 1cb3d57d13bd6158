"""Repeated runs of a few short sentences."""

import pytest

pytest.importorskip("trackframe.llm")
from trackframe.llm import substring_dedup  # noqa: E402


def test_short_runs_of_whole_sentences_are_removed(spark):
    line = "All rights reserved. See the licence file."
    rows = [(k, f"Text {k} begins in its own way. {line} Then text {k} goes on.") for k in range(5)]
    # The edges of this passage cut sentences; the whole ones within hold fewer than 24 words.
    passage = "which " * 30 + "ends. " + "It is so. We know it well. " + "Now " + "again " * 30
    rows += [(k, f"Own{k} start {passage} own{k} end.") for k in (10, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in substring_dedup.deduplicate(docs).collect()}
    assert [found[k].n_removed for k in range(5)] == [0, 2, 2, 2, 2]
    assert all(line not in found[k].text for k in range(1, 5))
    assert found[10].n_removed == 0 and found[11].n_removed == 2 and "It is so." not in found[11].text
