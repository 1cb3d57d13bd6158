"""Alignment of two tokenizers' tokens and perfect hashing, against plain versions."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("trackframe.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")
from trackframe.llm import perfect_hash, queries, token_alignment  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "  two  blanks ", "tab\t and\n blank", " starts", "ends ", "a b", "don't they're 's", "<|endoftext|> x <s> </s> <unk> <0x0A>", "lower ▁ one", "▁", "été ñandú Straße", "日本語 の 文章 です", "emoji 😀 👍🏽 x",
    "\x00 \x1c a\x1cb \x85 c", "non breaking   space", "x" * 3000, "1234567 89,000.50 -- !!??", "word " * 2000, "é combining", "a\r\nb \r\n c", " em   space", "A  B   C    D",
]


def plain(texts):
    """Ids, ends, groups and links of each text, token by token."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters = token_alignment.byte_of_letter()
    with open(A, encoding="utf-8") as f:
        a_bytes = {i: bytes(letters[c] for c in t) if i != 50256 else t.encode() for t, i in json.load(f)["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
        raw = [[a_bytes[i] for i in ids[0]], [token_alignment.piece_bytes(b.id_to_piece(i)) for i in ids[1]]]
        if any(b"".join(r) != (" " + text).encode() for r in raw):
            out.append(None)
            continue
        spans = []
        for r in raw:
            at, own = 0, []
            for t in r:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, links, start, i, j = [], [], 0, 0, 0
        for end in both:
            i0, j0 = i, j
            while i < len(ids[0]) and spans[0][i][1] <= end:
                i += 1
            while j < len(ids[1]) and spans[1][j][1] <= end:
                j += 1
            groups.append((ids[0][i0:i], ids[1][j0:j]))
            links += [(ids[0][x], ids[1][y]) for x in range(i0, i) for y in range(j0, j) if spans[0][x][0] < spans[1][y][1] and spans[1][y][0] < spans[0][x][1]]
            start = end
        out.append((len(ids[0]), len(ids[1]), groups, links))
    return out


def expected(rows):
    found = plain([t for _, t in rows])
    counts = Counter(pair for f in found if f for pair in set(f[3]))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (doc, _), f in zip(rows, found):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_alignment_of_odd_texts_equals_the_plain_version(spark):
    from pyspark.sql import functions as F

    rows = list(enumerate(ODD)) + [(3, "repeated row of words"), (3, "repeated row of words"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n in ("key", "n", "row", "piece"):
        docs = docs.withColumn(n, F.lit(1))
    want = expected(rows)
    assert rows_of(token_alignment.align(docs, A, B)) == want
    assert rows_of(token_alignment.align(docs, A, B, most_pairs=0)) == want
    shown = token_alignment.align(docs, A, B, groups=True).filter("doc_id = 7").first()["groups"]
    assert shown.count(";") + 1 == want[[w[0] for w in want].index(7)][3]


def test_empty_tables_and_tables_without_tokens(spark):
    ddl = "doc_id long, text string"
    assert token_alignment.align(spark.createDataFrame([], ddl), A, B).collect() == []
    assert rows_of(token_alignment.align(spark.createDataFrame([(1, None), (2, "")], ddl), A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pair_counts(spark):
    rows = [(1, "the cat"), (2, "the dog the dog"), (3, "a cat"), (3, "a cat")]
    found = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in token_alignment.pair_counts(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    counts = Counter(p for f in plain([t for _, t in rows]) for p in set(f[3]))
    assert {p: n for p, (n, _) in found.items()} == dict(counts)


def test_the_query_equals_the_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(queries.op11_token_alignment(spark, "/root/testdata/sf0.001")) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_words_forgotten_in_between_do_not_change_the_result():
    words, small = token_alignment.Words(A, B), token_alignment.Words(A, B, most=4)
    own = [f"w{k}ord{k % 7}" for k in range(300)]
    assert words.of(own) == [r for k in range(0, 300, 10) for r in small.of(own[k : k + 10])]


def test_perfect_hash_is_minimal_and_knows_its_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 31, 100_000))
    rows, buckets = [], 4
    for b in range(buckets):
        levels, order = perfect_hash.one_bucket(keys[perfect_hash.dealt(keys) % buckets == b].astype(np.uint32))
        rows.append({"bucket": b, "sizes": [len(w) for w in levels], "bits": b"".join(w.tobytes() for w in levels), "keys": order.astype("<u4").tobytes()})
    f = perfect_hash.assembled(rows)
    assert sorted(f.values(keys).tolist()) == list(range(len(keys)))
    assert (f.keys[f.values(keys)] == keys).all()
    others = np.setdiff1d(rng.integers(0, 1 << 31, 10_000), keys)
    assert (f.values(others) == -1).all()
    assert (perfect_hash.assembled([{"bucket": 0, "sizes": [], "bits": b"", "keys": b""}]).values(keys) == -1).all()
    with pytest.raises(ValueError):
        perfect_hash.one_bucket(np.array([5, 5], np.uint32))


def test_sums_of_vectors_as_a_tree(spark):
    rows = [(p, part, np.full(8, part + p, "<i8").tobytes()) for p in range(3) for part in range(11)]
    found = perfect_hash.tree_sum(spark.createDataFrame(rows, "piece long, part long, counts binary"), 11, fan=3).collect()
    assert {r.piece: np.frombuffer(r.counts, "<i8").tolist() for r in found} == {p: [sum(range(11)) + 11 * p] * 8 for p in range(3)}
