"""Operators on documents against brute force, with odd rows in every column."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

pytest.importorskip("trackframe.llm")
from trackframe.llm import bm25_decontaminate, line_quality, mixing, queries, secret_index, simhash_planes, substring_dedup, token_planes  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def corpus():
    """Ids, texts and sources: copies, near copies, empty, null, very long and repeated rows."""
    rng = random.Random(3)
    base = [" ".join(words(rng, n)) for n in (1, 2, 3, 4, 5, 30, 80, 200, 400)]
    texts = [None, "", " \n\t", *base, *base[5:], "word " * 3000, "x" * 50_000]
    for t in base[6:]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += ["É à\x1cb " * 9, "token = abcdef12345 AKIA" + "A" * 16 + " " + "0123456789abcdef" * 2, "a.\nB!! " * 30]
    rows = [(k, t, "en", f"src{k % 3}" if k % 5 else None, None) for k, t in enumerate(texts)]
    return rows + [rows[8], (None, base[6], None, None, 3), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def clashing(df, *names):
    """The table with further columns of names that the operators use."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit(7))
    return df


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    n = len(prints)
    root = list(range(n))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[top(i)] = top(j)
    return [top(k) for k in range(n)]


def test_simhash_against_brute_force(spark, docs):
    rows = corpus()
    prints = [slow_fingerprint(r[1]) for r in rows]
    tops = slow_components(prints)
    least = {}
    for r, t in zip(rows, tops):
        if r[0] is not None:
            least[t] = min(r[0], least.get(t, r[0]))
    want = Counter((r[0], f"{p:016x}", least.get(t)) for r, p, t in zip(rows, prints, tops))
    found = simhash_planes.near_duplicates(clashing(docs, "fingerprint", "row", "root", "component_id"))
    got = found.select("doc_id", simhash_planes.hex16("fingerprint").alias("f"), "component_id").collect()
    assert Counter((r.doc_id, r.f, r.component_id) for r in got) == want


@pytest.mark.parametrize("most", [4, 4096])
def test_bit_planes_find_every_link_of_dense_groups(spark, most):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    prints = set()
    for c in centres:
        for _ in range(40):
            p = c
            for _ in range(rng.randrange(7)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    found = simhash_planes.components(simhash_planes.links(nodes, most=most))
    root = {r.node: r.root for r in found.collect()}
    got, want = {}, {}
    for p, t in zip(signed, slow_components(prints)):
        got.setdefault(root.get(p, p), set()).add(p)
        want.setdefault(t, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_planes_count_all_distances():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    prints[1::3] = prints[::3] ^ 0b1011
    planes = simhash_planes.Planes(prints)
    for d in (1, 2, 63, 64, 65, 130):
        lanes = np.zeros(planes.words * 64, np.uint8)
        lanes[: 300 - d] = 1
        got = planes.close(d, np.packbits(lanes, bitorder="little").view(np.uint64), 4)
        want = [k for k in range(300 - d) if bin(int(prints[k] ^ prints[k + d]) & (1 << 64) - 1).count("1") <= 4]
        assert got.tolist() == want


def test_one_document_of_each_component_stays(spark, docs):
    rows = corpus()
    tops = slow_components([slow_fingerprint(r[1]) for r in rows])
    least = {}
    for r, t in zip(rows, tops):
        least[t] = min((r[0] is None, r[0] or 0), least.get(t, (True, 0)))
    kept = simhash_planes.keep_one(clashing(docs, "fingerprint", "row", "root", "id"))
    assert kept.columns[-4:] == ["fingerprint", "row", "root", "id"]
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == sorted(least.values())


def test_token_planes_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))  # those with equal ids have texts of equal ids here or are settled below
    nulls = [r for r in rows if r[0] is None]
    tie = {r.text: r.t for r in docs.filter("doc_id IS NULL").selectExpr("text", "xxhash64(doc_id, text) AS t").collect()}
    rows = sorted(nulls, key=lambda r: tie[r[1]]) + rows[len(nulls) :]
    start, want, whole = 0, [], []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        whole.append((r[0], ids))
        start += len(ids)
    for kind, size in (("byte", 1 << 22), ("bit", 700)):
        path = str(tmp_path / kind)
        token_planes.write(clashing(docs, "start", "file"), path, queries.tokenizer_path(), file_ids=size, block=257, kind=kind)
        got = token_planes.read(spark, path).collect()
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
        assert sorted((tuple(r) for r in token_planes.read_ids(spark, path).collect()), key=lambda r: (key(r[:1]), r[1])) == sorted(whole, key=lambda r: (key(r[:1]), r[1]))


def test_token_encoder_of_other_vocabularies(tmp_path):
    """Tokenizers that cut texts otherwise get them whole."""
    import pyarrow as pa
    from tokenizers import Tokenizer, models, pre_tokenizers

    cased = Tokenizer(models.WordLevel({"[UNK]": 0, "Paris": 5, "is": 6, "is.": 7, "paris": 8, ".": 9}, unk_token="[UNK]"))
    cased.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    cased.save(str(tmp_path / "cased.json"))
    import public_tokenizers

    texts = ["Paris is.", "Paris is. Paris", "", " it's 12.5 A", "İ <|endoftext|>"]
    for path in (str(tmp_path / "cased.json"), public_tokenizers.path("byte_bpe_50k.json")):
        t, e = Tokenizer.from_file(path), token_planes.WordEncoder(path)
        assert not e.fast and [g.tolist() for g in e.encode(pa.array(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert token_planes.WordEncoder(queries.tokenizer_path()).fast


def test_token_encoder_is_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(2)
    t = Tokenizer.from_file(queries.tokenizer_path())
    e = token_planes.WordEncoder(queries.tokenizer_path(), most=40)
    letters = list("abAB.,!?'_-# \n\t\r\x0b\x0c\x1c\x85\xa0éÉßİΣ²1<|>")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(500)] + ["<|endoftext|> a<|ENDOFTEXT|>", "a" * 99 + "."]
    for k in range(0, len(texts), 50):
        got = e.encode(pa.array(texts[k : k + 50]))
        assert [g.tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts[k : k + 50]]


def test_damaged_files_are_refused():
    ids = np.arange(1000, dtype="<u4")
    whole = token_planes.pack(0, 0, [(1, 400), (None, 600)], ids, 256, "byte", 3)
    names, sizes, back = token_planes.unpack(whole)
    assert names == [1, None] and sizes.tolist() == [400, 600] and (back == ids).all()
    broken = bytearray(whole)
    broken[20] ^= 255
    with pytest.raises(Exception):
        token_planes.unpack(bytes(broken))


def slow_base(text):
    w = WORD.findall(text or "")
    times = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + i for k in range(len(w) - 7) if times[tuple(w[k : k + 8])] > 1 for i in range(8)}
    lines = (text or "").split("\n")
    again = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_figures(spark, docs):
    found = line_quality.figures(clashing(docs, "kept", "cleaned", "n_words")).collect()
    want = Counter((r[0], *slow_base(r[1])) for r in corpus())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == want
    assert all(not r.kept for r in found if r.base_failed)


def test_line_rules():
    good = "A sentence of many plain words that tells something quite ordinary to its readers."
    text = "\n".join([good, "HOME!! NEWS!! SHOP!! ABOUT!! MORE!!", "Home | News | Shop | About", "All rights reserved.", good, "same same same same same same", good.replace("plain", "other")])
    found = line_quality.judge(text, line_quality.Rules())
    assert found["line_faults"] == ["punctuation", "navigation", "boilerplate", "repeated", "repeated"]
    assert found["cleaned"] == good + "\n" + good.replace("plain", "other")
    other = "Several further words of another kind follow here, and none of them was told before this."
    assert line_quality.judge(f"{good}\n{other}\nAll rights reserved.", line_quality.Rules())["kept"]
    junk = "\n".join(f"LINE!! {k}!! OF!! NOISE!! MORE!! NOISE!!" for k in range(9))
    assert not line_quality.judge(f"{good}\n{other}\n{junk}", line_quality.Rules())["kept"]


def test_clean_keeps_columns(spark, docs):
    kept = line_quality.clean(clashing(docs, "kept", "cleaned", "verdict"))
    assert kept.columns == [*docs.columns, "kept", "cleaned", "verdict"]
    for r in kept.collect():
        assert r.n_chars == len(r.text)


def slow_secrets(text):
    base = []
    key = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for order, (kind, pattern, group, least) in enumerate(
        [("assign", key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    ):
        base += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(base)


def test_secrets(spark):
    texts = [r[1] for r in corpus()] + [
        "password: hunter2hunter", "PassWD='short'", 'api-key=abcdefgh apiKey = "abcdefgh"', "secret==token: abcdef", "ghp_" + "a1B2" * 10, "deadbeef" * 3, "é AKIA" + "Z" * 16,
        "-----BEGIN RSA PRIVATE KEY-----", "xoxb-12345678901234", "https://user:pass@host.example", "Key toKen=abcdefg", "ſecret=abcdefgh",
    ]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_index.scan(docs, segment=5).collect()}
    assert len(found) == len(texts)
    for k, t in enumerate(texts):
        full = sorted((a, n, b) for n, r in enumerate(secret_index.RULES) for a, b in secret_index.spans(t or "", r, re.compile(r.pattern)))
        assert found[k] == [(secret_index.RULES[n].kind, a, b) for a, n, b in full]
        base = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in slow_secrets(t))
        own = ",".join(f"{kind}:{a}:{b}" for kind, a, b in found[k] if kind in secret_index.BASE)
        assert secret_index.digest(own) == hashlib.sha256(base.encode()).hexdigest()
    assert secret_index.redact("a token=abcdefgh b", found[0] + [("assign", 2, 16)]) == "a [assign] b"


def test_hostile_texts_take_linear_time():
    for text in ("a" * 1_000_000 + "://", "a1+" * 300_000 + "://" + "b." * 300_000, "eyJ" * 300_000, "eyJab." * 150_000, "token" + " " * 900_000, "http://" * 140_000, "-----BEGIN A " * 80_000):
        began = time.time()
        secret_index.Search().found([text])
        assert time.time() - began < 5, text[:20]


def test_redacted_tables(spark):
    jwt = "eyJ" + "a" * 20 + ".eyJ" + "b" * 20 + ".cc"
    rows = [(1, f"see {jwt} or ftp://me:pw12@host.example now"), (1, f"see {jwt} or ftp://me:pw12@host.example now"), (None, "AKIA" + "Z" * 16), (2, None), (3, ""), (4, "word " * 200_000 + "password=abcdef1")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "spans", "kind")
    found = secret_index.redacted(docs, segment=2)
    assert found.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    once = "see [jwt] or [login] now"
    assert texts == sorted([(1, once), (1, once), (None, "[access]"), (2, None), (3, ""), (4, "word " * 200_000 + "[assign]")], key=str)
    assert secret_index.scan(docs).count() == 6 and secret_index.redacted(docs.limit(0)).count() == 0


def slow_dedup(rows, least, words):
    """What is left of each text, by all runs of any length: {(id, text): number of sentences removed}."""
    once = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    parts = {r: [tuple((r[1] or "")[a:b].lower().split()) for a, b in substring_dedup.sentences(r[1] or "")] for r in once}
    first = {}
    for r in once:
        for a in range(len(parts[r])):
            for b in range(a + least, len(parts[r]) + 1):
                first.setdefault(tuple(parts[r][a:b]), (r, a))
    out = {}
    for r in once:
        gone = set()
        for a in range(len(parts[r])):
            for b in range(a + least, len(parts[r]) + 1):
                run = tuple(parts[r][a:b])
                if sum(map(len, run)) >= words and first[run] != (r, a):
                    gone.update(range(a, b))
        out[r] = len(gone)
    return out


def test_substring_dedup_against_all_runs(spark):
    """Shortest runs remove what all runs of any length do; ids are distinct, so the order of places is plain."""
    rng = random.Random(5)
    pool = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 1, 2, 3, 6]))) + "." for _ in range(25)]
    rows = [(k if k else None, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for k in range(70)] + [(100, None), (101, ""), (102, " ".join(pool) * 400)]
    rows.append(rows[3])
    want = slow_dedup(rows[:-2] + rows[-1:], 2, 4)
    docs = clashing(spark.createDataFrame(rows[:-2] + rows[-1:], "doc_id long, text string"), "h", "g", "first", "later", "_id").repartition(3)
    for known in (100_000, 0):
        got = substring_dedup.repeated_runs(docs, most_known=known)
        covered = {}
        for r in got.collect():
            covered.setdefault(r.doc_id, set()).update(range(r["first"], r.after))
        assert {k: len(v) for k, v in covered.items()} == {r[0]: n for r, n in want.items() if n}
    found = substring_dedup.deduplicate(docs).collect()
    assert all(r.n_removed == want[r.doc_id, dict((a, b) for a, b in rows)[r.doc_id]] for r in found) and len(found) == len(rows) - 1


def test_trigram_queries():
    assert secret_index.trigram_query("[0-9a-f]+") == []
    assert secret_index.trigram_query("AKIA[A-Z0-9]+") == [frozenset({frozenset({"aki", "kia"})})]
    (clause,) = secret_index.trigram_query("(abc|abd)x+")
    assert clause == frozenset({frozenset({"abc"}), frozenset({"abd"})})


def test_substring_dedup(spark):
    rng = random.Random(9)
    sentence = lambda n: " ".join(words(rng, n, 10**6)).capitalize() + "."
    passage = " ".join(sentence(rng.randint(3, 20)) for _ in range(6)) + " " + sentence(3)
    own = [" ".join(sentence(rng.randint(2, 15)) for _ in range(8)) for _ in range(5)]
    short = "Home. News. Shop."
    rows = [(0, own[0] + "\n" + short), (1, own[1] + "\n" + passage), (2, own[2] + " " + passage + " " + sentence(5)), (3, passage), (4, own[3] + "\n" + short), (5, own[0] + "\n" + short)]
    rows += [(6, None), (7, ""), (8, "one word"), (9, f"{own[4]} {own[4]}"), (1, own[1] + "\n" + passage), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = substring_dedup.deduplicate(clashing(docs, "row", "runs", "h", "first")).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert len(found) == len(rows) and len(by[1]) == 2
    assert by[0][0].n_removed == 0 and all(r.n_removed == 0 and r.text == rows[1][1] for r in by[1])
    assert passage[:-1] not in by[2][0].text and by[2][0].n_removed == 7 and by[2][0].text.startswith(own[2])
    assert by[3][0].text == "" and by[None][0].text == "" and by[5][0].text.strip() == ""
    assert by[4][0].n_removed == 0 and by[6][0].text is None and by[7][0].text == "" and by[8][0].n_removed == 0
    assert by[9][0].text.strip() == own[4]
    for r in found:
        text = dict((i, t) for i, t in rows)[r.doc_id]
        gone = sum(p["end"] - p["start"] for p in r.removed)
        assert len(text or "") - gone == len(r.text or "")


def test_sentences():
    t = "One two.  Three! Four\nfive. v1.2 is out?\n\n  \nSix"
    assert [t[a:b] for a, b in substring_dedup.sentences(t)] == ["One two.", "Three!", "Four", "five.", "v1.2 is out?", "Six"]


def items_and_docs():
    rng = random.Random(4)
    text = lambda n: " ".join(words(rng, n, 3000))
    items = [(k, f"{text(rng.randint(6, 50))}? {text(rng.randint(1, 12))}.") for k in range(60)] + [(60, None), (61, ""), (62, "one"), (0, None)]
    docs = []
    for k in range(40):
        own = text(rng.randint(0, 300)).split()
        if k % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = items[k][1].upper().split()
        if k % 7 == 1:
            own += items[k][1].split()[: len(items[k][1].split()) // 3]
        docs.append((k, " ".join(own)))
    return items, docs + [(100, None), (101, ""), (102, items[5][1]), (102, items[5][1]), (None, items[6][1])]


def slow_leaks(items, docs):
    out = Counter()
    for i, t in set(items):
        q, a = bm25_decontaminate.split_item(t)
        own = q + a
        if len(own) < 2:
            continue
        m = min(5, len(own))
        for d, text in docs:
            w = bm25_decontaminate.words_of(text)
            held = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}
            covered = [any(tuple(own[s : s + m]) in held for s in range(max(0, k - m + 1), min(k, len(own) - m) + 1)) for k in range(len(own))]
            share = lambda x: sum(x) / len(x) if x else 1
            if share(covered[: len(q)]) >= 0.8 and share(covered[len(q) :]) >= 0.8:
                out[(d, i)] += 1
    return out


@pytest.mark.parametrize("shard", [8 << 20, 900])
def test_leaks_against_brute_force(spark, shard):
    items, docs = items_and_docs()
    want = slow_leaks(items, docs)
    assert len(want) > 15
    a = clashing(spark.createDataFrame(docs, "doc_id long, text string"), "row", "score", "item_id")
    b = spark.createDataFrame(items, "item_id long, text string")
    settings = bm25_decontaminate.Settings(shard_bytes=shard)
    found = bm25_decontaminate.leaks(a, b, settings).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == want
    kept = bm25_decontaminate.without_leaks(a, b, settings).collect()
    bad = {d for d, _ in want}
    assert sorted((r.doc_id for r in kept), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)


def test_wand_finds_what_full_scores_find():
    rng = random.Random(8)
    items = [(k, " ".join(words(rng, rng.randint(5, 40), 60)) + ".") for k in range(200)]
    s = bm25_decontaminate.Settings(block=4, threshold=0.25)
    pieces = [p for _, t in items for p in bm25_decontaminate.pieces_of(sum(map(list, bm25_decontaminate.split_item(t)), []), s.piece)]
    frequency = Counter(t for p in pieces for t in set(bm25_decontaminate.pairs_of(p)))
    index = bm25_decontaminate.Index(items, frequency, len(pieces), 20.0, s)
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.rows)), 40))
        full = Counter()
        for t in terms:
            for r, x in zip(index.rows[t].tolist(), index.impacts[t].tolist()):
                full[r] += x
        want = {r: round(x, 9) for r, x in full.items() if x >= s.threshold}
        assert {r: round(x, 9) for r, x in index.search(terms)} == want


def size_of(text):
    return max(1, -(-len((text or "").encode()) // 4))


def slow_mix(rows, mix, shares, tie):
    """The uses of a mixture by plain loops over the input: (doc_id, source, epoch, block) with their number.

    The quotas are given, and the row hashes by (id, text, source) that settle the order of equal ids.
    """
    once = list(dict.fromkeys((r[0], r[1], r[3]) for r in rows))
    uses = Counter()
    for source in {s for _, _, s in once}:
        own = [(d, t) for d, t, s in once if s == source]
        r = shares["none" if source is None else f"s:{source}"]
        at, epoch = 0, 0
        while at < r.quota:
            hashed = [(hashlib.md5(f"{mix.seed}|{epoch}|{'null' if d is None else d}".encode()).hexdigest(), tie[d, t, source], size_of(t), d) for d, t in own]
            for _, _, n, d in sorted(hashed, key=lambda x: x[:2]):
                if at < r.quota:
                    uses[d, source, epoch, min(int(at / r.quota * r.n_blocks), r.n_blocks - 1)] += 1
                at += n
            epoch += 1
    return uses


def test_mixing(spark, docs):
    mix = mixing.Mix(block_tokens=500, digits=1)
    once = list(dict.fromkeys((r[0], r[1], r[3]) for r in corpus()))
    total = Counter()
    for _, t, s in once:
        total["none" if s is None else f"s:{s}"] += size_of(t)
    shares = {s: n / sum(total.values()) for s, n in total.items()}
    rows = {r.mixed_source: r for r in mixing.quotas(docs, mix).collect()}
    assert {s: r.tokens for s, r in rows.items()} == total
    a = next(iter(rows.values())).exponent
    z = sum(p**a for p in shares.values())
    entropy = -sum(p**a / z * np.log(p**a / z) for p in shares.values())
    repeats = [rows[s].quota / total[s] for s in rows]
    assert all(abs(rows[s].weight - shares[s] ** a / z) < 1e-8 for s in rows) and min(repeats) >= 1
    assert entropy >= 0.97 * np.log(len(shares)) - 1e-6 or abs(max(repeats) - mix.repetitions) < 0.05
    tie = {(r.doc_id, r.text, r.source): r.t for r in docs.selectExpr("doc_id", "text", "source", "xxhash64(doc_id, text, source) AS t").collect()}
    want = slow_mix(corpus(), mix, rows, tie)
    for most_sent in (mixing.MOST_SENT, 0):  # 0: joined by shuffles, with hot sources salted
        used = mixing.blocks(clashing(docs, "key", "row", "tokens", "epoch", "_hot", "_salt"), mix, most_sent).collect()
        assert Counter((u.doc_id, u.source, u.epoch, u.block) for u in used) == want
    order = mixing.order(mixing.blocks(docs, mix)).collect()
    for block in {u.block for u in order}:
        assert sorted(u.slot for u in order if u.block == block) == list(range(sum(u.block == block for u in order)))
    copies = mixing.mixed(clashing(docs, "_uses", "_row", "_whole", "_name"), mix)
    assert Counter(r.doc_id for r in copies.collect()) == Counter(u.doc_id for u in used)
    assert copies.columns[: len(docs.columns)] == docs.columns


def test_blocks_hold_the_weights_of_repeated_rows(spark):
    """Rows that the input repeats count once everywhere, so every block holds both sources alike."""
    rows = [(k, f"{k:04d}" * 100, "a") for k in range(100)] * 3 + [(1000 + k, f"{k:04d}" * 100, "b") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mix = mixing.Mix(entropy=1.0, repetitions=None, block_tokens=6000)
    used = mixing.blocks(docs, mix).collect()
    per = Counter((u.block, u.source) for u in used)
    blocks = {u.block for u in used}
    assert len(blocks) == 10 and all(abs(per[b, "a"] - 30) <= 1 and abs(per[b, "b"] - 30) <= 1 for b in blocks)
    # A mixed table, laid out anew, has the same blocks.
    copies = mixing.mixed(docs, mix)
    again = mixing.arranged(clashing(copies, "key", "bucket", "quota"), mix).collect()
    assert Counter((u.doc_id, u.epoch, u.block) for u in again) == Counter((u.doc_id, u.epoch, u.block) for u in used)
    placed = mixing.texts_in_order(copies, mix).collect()
    assert Counter((r.doc_id, r.block, r.slot) for r in placed) == Counter((u.doc_id, u.block, u.slot) for u in again)
    assert all(r.text == rows[r.doc_id][1] if r.doc_id < 1000 else f"{r.doc_id - 1000:04d}" * 100 for r in placed)


def test_mixing_limits(spark):
    docs = spark.createDataFrame([(k, "x" * 400, "big" if k < 90 else f"s{k}") for k in range(100)], "doc_id long, text string, source string")
    totals = mixing.source_totals(docs)
    loose = mixing.exponent_for(totals, mixing.Mix(entropy=0.9, repetitions=None))
    tight = mixing.exponent_for(totals, mixing.Mix(entropy=0.9, repetitions=2.0))
    assert 0 < loose < tight < 1 and abs(mixing.states(totals, [tight])[tight][1] - 2.0) < 1e-4
    assert abs(mixing.states(totals, [loose])[loose][0] / np.log(11) - 0.9) < 1e-5
    assert mixing.exponent_for(totals, mixing.Mix(entropy=0.1, repetitions=None)) == 1.0
    budget = mixing.Mix(entropy=1.0, repetitions=None, budget=1100)
    used = mixing.blocks(docs, budget)
    assert used.filter("source = 'big'").count() == 1 and used.filter("source <> 'big'").count() == 10


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c d e f.")], "item_id long, text string")
    assert simhash_planes.near_duplicates(docs).count() == simhash_planes.keep_one(docs).count() == 0
    assert line_quality.figures(docs).count() == line_quality.clean(docs).count() == 0
    assert secret_index.scan(docs).count() == substring_dedup.deduplicate(docs).count() == 0
    assert bm25_decontaminate.leaks(docs, items).count() == bm25_decontaminate.leaks(docs, full).count() == 0
    assert bm25_decontaminate.without_leaks(docs, full).count() == 0
    assert mixing.order(mixing.blocks(docs)).count() == mixing.mixed(docs).count() == mixing.texts_in_order(docs).count() == 0


def test_empty_files(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    token_planes.write(docs, str(tmp_path / "none"), queries.tokenizer_path())
    assert token_planes.read(spark, str(tmp_path / "none")).count() == 0
