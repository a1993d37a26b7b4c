import random

import pytest

from sievework.llm import overlap as O

LINES = ["12 @ 5 -> 77", "13 @ 6 -> 80", "20 @ 1 -> 45", "9 @ 9 -> 10"]


def prompt(lines=LINES, query="14 @ 9", style="{} -> {}", ask="Now give the result for {}", head="Find the rule of Kul."):
    return "\n".join([head, "Examples:", *[style.format(*x.split(" -> ")) for x in lines], ask.format(query), "Close with \\boxed{}."])


def same(a, b):
    (qa, la), (qb, lb) = O.puzzle(a), O.puzzle(b)
    return qa == qb and la == lb


@pytest.mark.parametrize("style", ["{} => {}", "{} becomes {}", "in: {}, out: {}", "[{}] gives [{}]", "- {} -> {}", "{}  |  {}", "{} → {}", "  {}  ⇒  {}"])
@pytest.mark.parametrize("ask", ["Next case: {}", "Determine the value belonging to {}.", "What comes out for {}?", "¿Qué da la misma regla para {}?", "이제 {} 에 대한 결과를 구하세요.", "Aplly the smae rule to {}."])
def test_layout_and_wording_do_not_matter(style, ask):
    assert same(prompt(), prompt(random.Random(1).sample(LINES, 4), style=style, ask=ask, head="Another tale."))


def test_case_width_and_spaces():
    wide = prompt().translate({ord(c): ord(c) + 0xFEE0 for c in "0123456789"}).upper().replace("\n", " \n\n")
    assert same(prompt(), wide)


def test_words_symbols_and_bars():
    cipher = ["abcd efgh -> maple fox", "ijkl -> dog"]
    assert O.puzzle(prompt(cipher, "mnop qrst"))[0] == O.puzzle(prompt(cipher, "mnop qrst", ask="What comes out for {}?"))[0] == "mnop qrst"
    marks = ["?<% ; #! -> ^^", "!! ; &&? -> #"]
    assert {O.puzzle(prompt(marks, "#? ; !?", ask=a))[0] for a in ("Next case: {}", "What comes out for {}?", "Determine the value belonging to {}.")} == {"#? ; !?"}
    bars = ["1 | 2 -> 3", "4 | 5 -> 6"]
    assert same(prompt(bars, "7 | 8"), prompt(bars, "7 | 8", style="{}  |  {}"))


def test_no_puzzle():
    assert O.puzzle(None) is None and O.puzzle(" \n") is None
    assert O.puzzle("Just some text.")[1] == []
    assert O.puzzle("[ ] gives [1]\n[ ] gives [2]\nNext case: 3")[1] == []
    assert same(prompt(), prompt().replace("Find", "Fi\x03nd\x00"))
    assert O.puzzle("word " * 200_000)[0] == "word" * 200_000


def test_index_finds_exactly_the_equal_records():
    rng = random.Random(3)
    pool = ["".join(rng.choices("ab1 ;é한", k=rng.randint(1, 12))) for _ in range(400)]
    records, patterns = rng.choices(pool, k=500), [*rng.choices(pool, k=300), "absent", "a", ""]
    index = O.Index([r.encode() for r in records])
    p, r = index.search([x.encode() for x in patterns])
    assert sorted(zip(p.tolist(), r.tolist(), strict=True)) == sorted((i, j) for i, x in enumerate(patterns) for j, y in enumerate(records) if x == y)
    assert len(O.Index([b"x"]).search([])[0]) == 0


def test_pairs_match_brute_force(spark):
    rng = random.Random(5)

    def rows(tag, n):
        out = []
        for i in range(n):
            base = random.Random(rng.randint(0, 12))
            lines = [f"{base.randint(1, 99)} @ {base.randint(1, 99)} -> {base.randint(1, 999)}" for _ in range(5)]
            query = f"{base.randint(1, 9)} @ {rng.choice([1, 1, 1, 2])}"
            lines = rng.sample(lines, rng.choice([5, 5, 4, 3]))
            out.append((f"{tag}{i}", prompt(lines, query, rng.choice(["{} -> {}", "in: {}, out: {}"]))))
        return [*out, (f"{tag}null", None), (f"{tag}text", "Just some text."), (None, prompt()), out[0]]

    a, b = rows("t", 80), rows("h", 60)
    got = {(r.train_key, r.held_key) for r in O.overlaps(spark.createDataFrame(a, "key string, prompt string"), spark.createDataFrame(b, "key string, prompt string")).collect()}

    def close(x, y):
        (qx, lx), (qy, ly) = O.puzzle(x), O.puzzle(y)
        m = len(set(lx) & set(ly))
        return qx == qy and ((not lx and not ly) or (len(lx) - m <= 1 and len(ly) - m <= 1))

    want = {(k, h) for k, x in a for h, y in b if k and h and x and y and close(x, y)}
    assert got == want and len(want) > 20


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], "key string, prompt string"), spark.createDataFrame([("a", prompt())], "key string, prompt string")
    for x, y in ((none, some), (some, none), (none, none)):
        assert O.overlaps(x, y).count() == 0


def plain_rows(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(4000)]
    lead = "please read the following note with care and say what you think of it :".split()
    train, held, altered = [], [], {}
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([8, 30, 60, 200]))
        held.append((f"h{i}", " ".join([*lead, *words])))
        if i % 3 == 0:
            new = list(words)
            for _ in range(max(1, len(words) // 40)):
                k = rng.randrange(len(new))
                kind = rng.choice(["alter", "drop", "add"])
                new[k : k + 1] = {"alter": ["changed"], "drop": [], "add": [new[k], "added"]}[kind]
            train.append((f"t{i}", " ".join([*lead, *new]).upper()))
            altered[f"t{i}"] = f"h{i}"
        else:
            train.append((f"t{i}", " ".join([*lead, *rng.choices(vocabulary, k=40)])))
    return train, held, altered


def test_nearly_equal_plain_texts_are_found(spark):
    """Recall of planted alterations, judged against a plain comparison of every pair; small shards, blocks and tasks."""
    train, held, altered = plain_rows(150, 4)

    def share(a, b):
        wins = set(O.windows(b, 5))
        return O.covered([k for k, w in enumerate(O.windows(a, 5)) if w in wins], min(5, len(a)), len(a))[0] / len(a)

    norm = lambda t: O.passages(t)[0]
    want = {(k, h) for k, a in train for h, b in held if min(share(norm(a), norm(b)), share(norm(b), norm(a))) >= 0.8}
    schema = "key string, prompt string"
    got = {(r.train_key, r.held_key) for r in O.overlaps(spark.createDataFrame(train, schema), spark.createDataFrame(held, schema), shard_mb=0.01, block=20, often=40).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want & set(altered.items())) > 35


def test_copies_are_classes(spark):
    schema = "key string, prompt string"
    text = "name the risks of the plan and say who carries them in the end , then stop"
    train = spark.createDataFrame([(f"t{i}", text) for i in range(40)] + [("u", text.replace("the plan", "our plan"))], schema)
    held = spark.createDataFrame([(f"h{i}", text.upper()) for i in range(30)], schema)
    pairs, members = O.classes(train, held)
    got = sorted((r.train_copies, r.held_copies, r.train_covered, r.longest) for r in pairs.collect())
    assert got == [(1, 30, 16, 11), (40, 30, 17, 17)] or got == [(40, 30, 17, 17)]
    assert members.count() == 71


def test_covered_spans_merge():
    assert O.covered([0, 1, 2, 10], 5, 20) == (12, 7)
    assert O.covered([], 5, 20) == (0, 0) and O.covered([0], 1, 1) == (1, 1)
