import random

import numpy as np

from sievework.llm import leakage as L

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def text(rng, n):
    return [f"w{rng.randint(0, 3000)}" for _ in range(n)]


def test_words():
    assert L.words("A <b>bold</b>\ncase, pla-\nnks 3.5") == ["a", "bold", "case", "planks", "3", "5"]
    assert L.words(None) == [] and L.words("") == [] and L.words("<br><br/>") == []


def longest(doc, item):
    places = {}
    for j, w in enumerate(item):
        places.setdefault(w, []).append(j)
    return L.longest(doc, item, [True] * len(item), places)


def test_alignment_allows_single_alterations():
    item = [f"i{k}" for k in range(40)]
    assert longest(item, item) == 40
    changed = list(item)
    changed[10] = "x"
    assert longest(changed, item) == 40  # the altered word lies within the row
    assert longest(item[:10] + ["x"] + item[10:], item) == 40
    assert longest(item[:10] + item[11:], item) >= 39
    assert longest(item[:10] + ["x", "y", "z"] + item[10:], item) == 30
    assert longest(item[:20:2], item) <= 3
    assert longest([], item) == 0


def test_shared_instructions_do_not_count(spark):
    tail = [f"t{k}" for k in range(12)]
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(10)] + tail)) for i in range(4)] + [(9, "too short"), (10, None)]
    items = L.counting_words(L.tokenised(spark.createDataFrame(rows, ITEMS), "item_id"))
    got = {r.item_id: r.counts for r in items.collect()}
    assert all(sum(got[i]) == 10 and got[i][:10] == [True] * 10 for i in range(4)) and got[9] == [True, True] and 10 not in got


def test_common_subsequence():
    def lcs(a, b):
        bits = {}
        for j, x in enumerate(b):
            bits[x] = bits.get(x, 0) | 1 << j
        return L.common_subsequence(a, bits, len(b))

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert lcs(a, b) == plain(a, b)


def planted(seed, kinds=("alter",)):
    """Documents with a passage of 30 to 60 words of an item, one word in eight or so altered, and what was planted."""
    rng = random.Random(seed)
    items = [(i, text(rng, 70)) for i in range(60)]
    docs, want = [], set()
    for d in range(240):
        body = text(rng, rng.randint(0, 150))
        if d % 2:
            i, w = rng.choice(items)
            n = rng.randint(32, 60)
            s = rng.randint(0, 70 - n)
            part = w[s : s + n]
            for k in range(rng.randint(4, 8), n, rng.randint(6, 10)):
                part[k] = "altered"
            at = rng.randint(0, len(body))
            body = body[:at] + part + body[at:]
            want.add((d, i))
        docs.append((d, " ".join(body)))
    return docs, [(i, " ".join(w)) for i, w in items], want


def test_recall_of_planted_alterations(spark):
    """Judged by what was planted, not by the aligner."""
    docs, items, want = planted(11)
    got = {(r.doc_id, r.item_id) for r in L.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert len(got & want) >= 0.97 * len(want) and got <= want


def test_paraphrases_are_told_apart(spark):
    rng = random.Random(3)
    w = text(rng, 60)
    loose = [x for k, x in enumerate(w) for x in ([x] if k % 3 else [f"new{k}", f"more{k}"])]
    others = [(100 + i, " ".join([*text(rng, 80), f"new{i % 60}", f"more{i % 60}"])) for i in range(300)]
    docs, items = spark.createDataFrame([(1, " ".join(loose)), (2, " ".join(w)), (3, " ".join(reversed(w))), *others], DOCS), spark.createDataFrame([(7, " ".join(w))], ITEMS)
    assert {r.doc_id: r.kind for r in L.search(docs, items, cosine=0.4, paraphrase=0.5).collect()} == {1: "paraphrase", 2: "passage"}
    assert {r.doc_id for r in L.search(docs, items).collect()} == {2}


def test_blocks_do_not_change_the_candidates(spark):
    docs, items, _ = planted(12)
    texts = L.tokenised(spark.createDataFrame(docs, DOCS), "doc_id").cache()
    space, index = L.build_space(texts, L.counting_words(L.tokenised(spark.createDataFrame(items, ITEMS), "item_id")), rank=64)
    windows = L.document_windows(texts, space, 0.6).cache()
    whole, parts = ({(r.doc_id, r.item_id) for r in L.candidates(windows, index, 0.6, **o).collect()} for o in ({}, {"block_rows": 7, "task_rows": 40}))
    assert whole == parts and len(whole) > 50


def test_svd_spans_the_rows(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 30))
    rows = [(list(range(30)), r.tolist()) for r in a]
    basis = L.randomised_svd(spark.createDataFrame(rows, "ids array<int>, weights array<float>").repartition(3), 30, 6)
    assert basis.shape == (30, 6) and np.allclose(a @ basis @ basis.T, a, atol=1e-2)


def test_recall_against_brute_force(spark):
    rng = random.Random(8)
    items = [(i, text(rng, 60)) for i in range(30)]
    docs, want = [], set()
    for d in range(300):
        body = text(rng, rng.randint(0, 120))
        if d % 3 == 0:
            i, w = rng.choice(items)
            n = rng.choice([10, 20, 25, 30, 60])
            s = rng.randint(0, 60 - n)
            part = w[s : s + n]
            if n >= 30:
                part = [x if rng.random() > 0.05 else "altered" for x in part]
            at = rng.randint(0, len(body))
            body = body[:at] + part + body[at:]
        docs.append((d, " ".join(body).upper()))
    for d, t in docs:
        for i, w in items:
            if longest(L.words(t), w) >= 25:
                want.add((d, i))
    docs += [(900, None), (901, ""), (None, " ".join(items[0][1])), (902, " ".join(items[1][1] * 40))]
    want.add((902, 1))
    found = L.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(77, None), (78, "")], ITEMS))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == want and len(want) > 40


def test_empty(spark):
    none, docs = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a b c")], DOCS)
    assert L.search(docs, none).count() == 0
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(40)))], ITEMS)
    assert L.search(docs.limit(0), items).count() == 0
    assert L.leaked_items(L.search(docs, items), items).first().documents == 0
