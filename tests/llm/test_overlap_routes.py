import random

from sievework.llm import overlap as O


def brute(train, held, share=0.8):
    """Every pair by the definition: windows of the training text that occur in the evaluation text."""
    out = set()
    for k, a in train:
        (x, size) = O.passages(a)
        width = min(size, len(x))
        for h, b in held:
            (y, _) = O.passages(b)
            there = [y[j : j + width] for j in range(len(y) - width + 1)]
            mine = [x[j : j + width] for j in range(len(x) - width + 1)]
            here = O.covered([j for j, w in enumerate(mine) if w in there], width, len(x))[0]
            seen = O.covered([j for j, w in enumerate(there) if w in mine], width, len(y))[0]
            if min(here / len(x), seen / len(y)) >= share - 1e-9:
                out.add((k, h))
    return out


def test_no_pair_of_plain_texts_is_left_out(spark):
    rng = random.Random(8)
    train, held = [], []
    lead = [f"lead{k}" for k in range(60)]
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 120]))]
        # every seventh word altered: matches of six words, so that few windows are shared
        new = [f"x{rng.randrange(3000)}" if k % 7 == 6 else w for k, w in enumerate(words)]
        head = lead if i % 2 else []
        held.append((f"h{i}", " ".join(head + words)))
        train.append((f"t{i}", " ".join(head + new)))
    train += [("four", "name the four risks"), ("two", "again please"), ("three", "not held anywhere"), ("none", "")]
    held += [("five", "name the four risks now"), ("often", "again please again please again please"), ("six", "name the four risks right now")]
    want = brute([x for x in train if x[1]], held)
    schema = "key string, prompt string"
    got = {(r.train_key, r.held_key) for r in O.overlaps(spark.createDataFrame(train, schema), spark.createDataFrame(held, schema), shard_mb=0.002, block=20).collect()}
    assert got == want, (len(got), len(want))
    assert {(f"t{i}", f"h{i}") for i in range(60)} <= want and {("four", "five"), ("two", "often")} <= want


def test_leading_windows_leave_too_little():
    places = [[k] for k in range(16)]  # 20 words, 0.8 of them are 16
    assert O.leading(places, 5, 20, 0.8) == 5
    assert O.leading(places[:8], 5, 20, 0.8) == 0 and O.leading([], 5, 20, 0.8) == 0
    assert O.leading([[0, 1, 2, 3, 4, 5]], 5, 10, 0.8) == 1
