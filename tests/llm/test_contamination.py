"""Items of which a document holds question and short answer apart, or all but a made-up answer."""

import pytest

pytest.importorskip("trackframe.llm")
from trackframe.llm import bm25_decontaminate  # noqa: E402

QUESTION = "Which large city on the river Seine is the capital of France today?"
STORY = "The old mill stood by the water for many years before the flood took its wheel and half of the roof with it. Nobody came."
ITEMS = [(1, f"{QUESTION} Paris"), (2, STORY), (3, "Who wrote it? Jane Austen herself")]
FAR = " ".join(f"w{k}" for k in range(200))
DOCS = [
    (1, f"quiz: {QUESTION} Answer: Paris", {1}),
    (2, f"{FAR} Paris. {QUESTION} {FAR}", {1}),
    (3, f"{QUESTION} {FAR} Paris", set()),
    (4, f"{QUESTION} Rome", set()),
    (5, STORY.removesuffix(" Nobody came."), {2}),
    (6, STORY.replace("Nobody", "Somebody"), {2}),
    (7, "The old mill stood by the water. Nobody came.", set()),
    (8, f"{FAR} who wrote it? It was Jane Austen herself {FAR}", {3}),
    (9, f"Paris {FAR}", set()),
]


def test_answers_apart_and_made_up_answers(spark):
    docs = spark.createDataFrame([d[:2] for d in DOCS], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {d: set() for d, _, _ in DOCS}
    for r in bm25_decontaminate.leaks(docs, items).collect():
        found[r.doc_id].add(r.item_id)
    assert found == {d: want for d, _, want in DOCS}
    kept = bm25_decontaminate.without_leaks(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _, want in DOCS if not want]


def test_items_in_scripts_without_blanks(spark):
    """Letters are the words there: a whole copy is found within a text, other texts stay."""
    items = spark.createDataFrame([(1, "法国的首都是哪里？巴黎是法国的首都。"), (2, "日本で一番高い山は富士山です。高さは三千七百七十六メートルです。"), (3, "เมืองหลวงของประเทศไทยคือกรุงเทพมหานคร")], "item_id long, text string")
    texts = ["前言。法国的首都是哪里？巴黎是法国的首都。后记。", "昨日、日本で一番高い山は富士山です。高さは三千七百七十六メートルです。と聞いた。", "A text on เมืองหลวงของประเทศไทยคือกรุงเทพมหานคร here", "法国的天气今天很好，我们去公园散步。", "plain words only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in bm25_decontaminate.leaks(docs, items).collect()}
    assert found == {(0, 1), (1, 2), (2, 3)}
    assert sorted(r.doc_id for r in bm25_decontaminate.without_leaks(docs, items).collect()) == [3, 4]
