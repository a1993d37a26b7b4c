import random

from sievework.llm import abuse as A


def test_disguises_are_removed():
    flat = lambda t: [" ".join(s) for s in A.sentences(t)]
    assert flat("You are an 1d1ot, i d i o t!") == ["you are an idiot idiot"]
    assert flat("Go rоt now") == ["go rot now"]  # the o is Cyrillic
    assert flat("dumb@$$ there") == ["dumbass there"]
    assert flat("<b>first</b> one &amp; more. Second one here\nthird line") == ["one more", "second one here", "third line"]
    assert flat("FÃ¼r alle") == ["für alle"]
    assert A.sentences(None) == [] and A.sentences("") == [] and A.sentences("12 34") == []


def test_masked_words_take_known_ones():
    assert A._unmask(["you", "m*ron"], {5: ["moron"]}) == ["you", "moron"]
    assert A._unmask(["you", "zz*zz"], {}) == ["you", "<masked>"]


def corpus(rng, n):
    fine = ["the loader drops {0} rows per step", "rule {0} beats rule {0} on all slices", "this damn build took {0} hours", "nobody knows why batch {0} fails"]
    bad = ["you filthy moron and your stupid friends", "those people are vermin and belong in cages", "i will break your legs you worthless rat", "du bist ein verdammter idiot und abschaum"]
    texts, labels = [], []
    for _ in range(n):
        s = [rng.choice(fine).format(rng.randint(1, 99)) for _ in range(8)]
        y = rng.random() < 0.15
        if y:
            s.insert(rng.randint(0, 8), rng.choice(bad))
        texts.append(". ".join(s) + ".")
        labels.append(int(y) if rng.random() > 0.02 else 1 - int(y))
    return texts, labels


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    model = A.train(*corpus(rng, 500))
    texts, labels = corpus(random.Random(9), 400)
    truth = [int(any(w in t for w in ("moron", "vermin", "legs", "verdammter"))) for t in texts]
    docs = spark.createDataFrame([(i, t, ["Chat Export", "chat_export", None][i % 3]) for i, t in enumerate(texts)] + [(-1, None, "x"), (-2, "", "x"), (-3, "fine words. " * 5000 + "you filthy moron and your stupid friends.", "x")], "doc_id long, text string, source string")
    scored = A.score(docs, model)
    got = {r.doc_id: r.score for r in scored.collect()}
    hits = [got[i] >= 0.35 for i in range(400)]
    assert sum(h == bool(t) for h, t in zip(hits, truth, strict=True)) >= 392
    assert got[-1] == got[-2] == 0.0 and got[-3] > 0.35
    rates = {r.source: r for r in A.rates(scored, 0.35).collect()}
    assert set(rates) == {"chat_export", "unknown", "x"} and sum(r.documents for r in rates.values()) == 403
    assert len(model.at) < 20_000


def test_without_labels_the_seeds_are_learned(spark):
    model = A.train([], [])
    docs = spark.createDataFrame([(1, "You are a fucking idiot.", "s"), (2, "Kill the process and restart it.", "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r.score for r in A.score(docs, model).collect()}
    assert got[1] > 0.5 > got[2]
    assert A.score(docs.limit(0), model).count() == 0


def test_labels_are_averaged(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (9, 1)], "doc_id long, harmful int")
    assert A.labelled(docs, labels) == (["a", "b"], [1, 0])
