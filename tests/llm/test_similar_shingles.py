"""Near-duplicates by shingle similarity against brute force."""

import random

import pytest

pytest.importorskip("trackframe.llm")
import corpus_pipeline  # noqa: E402
from trackframe.llm import similar_shingles  # noqa: E402


def slow_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_copies():
    """Texts in groups of copies with a few changed words: similarities on both sides of 0.8."""
    rng = random.Random(6)
    texts = [None, "", " \n", "one", "One ", "two words"]
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 300))]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 30 + 1)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return [(k, t) for k, t in enumerate(texts)] + [(8, texts[8]), (None, texts[9])]


def slow_tops(texts):
    """A number for each text that names its component of links at similarity 0.8."""
    sets = [slow_set(t) for t in texts]
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            x, y = sorted((len(sets[i]), len(sets[j])))
            if x >= 0.8 * y and (not y or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                root[top(i)] = top(j)
    return [top(k) for k in range(len(sets))]


@pytest.mark.parametrize("most", [3, 2048])
def test_similar_texts_against_brute_force(spark, most):
    rows = near_copies()
    sets = [slow_set(t) for _, t in rows]
    near = [len(a & b) / max(1, len(a | b)) for k, a in enumerate(sets) for b in sets[:k]]
    assert sum(0.8 <= x < 0.9 for x in near) > 15
    tops = slow_tops([t for _, t in rows])
    least = {}
    for k, (i, _) in enumerate(rows):
        least[tops[k]] = min((i is None, i or 0), least.get(tops[k], (True, 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in similar_shingles.keep_one(docs, most).collect())
    assert got == sorted(least.values())


def test_the_stage_finds_copies_at_similarity_of_0_8(spark):
    words = [f"w{k}" for k in range(100)]
    other = words[:20] + ["x"] + words[21:70] + ["y"] + words[71:]
    assert 0.8 <= len(slow_set(" ".join(words)) & slow_set(" ".join(other))) / len(slow_set(" ".join(words)) | slow_set(" ".join(other))) < 0.85
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "else")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]
