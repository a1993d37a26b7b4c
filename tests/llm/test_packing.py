import random
from collections import defaultdict

from sievework.llm import packing as P

SCHEMA = "problem_id string, category string, tokens array<bigint>, mask array<double>"


def corpus(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_best_fit_takes_the_tightest_compatible_bin():
    assert P.best_fit([6, 5, 4, 3], [0] * 4, [-1] * 4, {}, 10) == [0, 1, 0, 1]
    assert P.best_fit([6, 5, 4, 3], [0] * 4, [7, -1, 7, -1], {}, 10) == [0, 1, 1, 0]
    assert P.best_fit([5, 5], [1, 2], [-1, -1], {1: 1 << 2, 2: 1 << 1}, 10) == [0, 1]
    assert P.best_fit([], [], [], {}, 10) == []


def test_bins_are_whole_aligned_and_within_capacity(spark):
    rng = random.Random(2)
    rows = [(f"p{i}", rng.choice(["a", "b", None]), [rng.randint(0, 9) for _ in range(rng.choice([0, 1, 30, 99, 100, 101, 250]))], None) for i in range(150)]
    rows = [(p, c, t, [1.0] * max(0, len(t) - i % 3)) for i, (p, c, t, _) in enumerate(rows)]
    rows += [("twin1", "a", [4] * 40, [1.0] * 40), ("twin2", "a", [4] * 40, [1.0] * 40), ("nulls", None, None, None), rows[3]]
    df = corpus(spark, rows)
    packed = P.pack(P.lengths(df), capacity=100, block_items=60)
    got = packed.collect()
    want = {p: len(t or []) for p, _, t, _ in rows}
    total, used, bins = defaultdict(int), defaultdict(int), defaultdict(set)
    for r in got:
        total[r.problem_id] += r.length
        assert r.pieces == max(1, -(-want[r.problem_id] // 100)) and (r.bin is None) == (r.length == 0)
        if r.bin is not None:
            used[r.bin] += r.length
            bins[r.bin].add(r.problem_id)
    assert dict(total) == want and max(used.values()) <= 100
    assert not any({"twin1", "twin2"} <= b for b in bins.values())
    filled = {r.bin: r for r in P.sequences(df, packed).collect()}
    assert set(filled) == set(used)
    source = {p: (t or [], m or []) for p, _, t, m in rows}
    place = {(r.problem_id, r.piece): r.start for r in got}
    for r in filled.values():
        assert len(r.tokens) == len(r["mask"]) == used[r.bin]
        at = 0
        for item in r["items"]:
            t, m = source[item.problem_id]
            s = place[item.problem_id, item.piece]
            assert r.tokens[at : at + item.length] == t[s : s + item.length]
            assert r["mask"][at : at + item.length] == (m + [0.0] * (len(t) - len(m)))[s : s + item.length]
            at += item.length


def test_empty_table(spark):
    empty = corpus(spark, [])
    packed = P.pack(P.lengths(empty))
    assert packed.count() == 0 and P.sequences(empty, packed).count() == 0 and P.report(packed).first().bins == 0


def test_fill_is_close_to_the_bound(spark):
    rng = random.Random(4)
    items = spark.createDataFrame([(f"p{i}", rng.randint(1, 4000), None, i) for i in range(3000)], "problem_id string, n_tokens long, source string, cluster long")
    r = P.report(P.pack(items)).first()
    assert r.fill > 0.99 and r.bins <= r.least_bins * 1.01 + 1


def test_barred_sources_never_meet(spark):
    rng = random.Random(7)
    rows = [(f"p{i}", rng.choice(["a", "b", "c", None]), [rng.randint(0, 9) for _ in range(rng.randint(1, 60))], None) for i in range(300)]
    items = P.lengths(corpus(spark, rows))
    barred = [("a", "b")]
    packed = P.pack(items, capacity=100, barred=barred).cache()
    source = {p: c for p, c, _, _ in rows}
    bins = defaultdict(set)
    for r in packed.collect():
        bins[r.bin].add(source[r.problem_id])
    assert not any({"a", "b"} <= s for s in bins.values()) and any({"a", "c"} <= s for s in bins.values())
    got = P.checks(packed, items, barred, 100).first()
    assert (got.items, got.over_capacity, got.with_twins, got.with_barred, got.placed_twice) == (300, 0, 0, 0, 0)
    assert P.checks(P.pack(items, capacity=100), items, barred, 100).first().with_barred > 0


def test_many_twins_take_one_sweep():
    n = 30_000
    bins = P.best_fit([3] * n + [5] * 10, [0] * (n + 10), [0] * n + [-1] * 10, {}, 8)
    assert len(set(bins[:n])) == n and set(bins[n:]) <= set(bins[:n])


def test_blocks_cost_little(spark):
    rng = random.Random(5)
    items = spark.createDataFrame([(f"p{i}", rng.randint(1, 4000), None, i) for i in range(6000)], "problem_id string, n_tokens long, source string, cluster long")
    whole, parts = (P.report(P.pack(items, block_items=k)).first().bins for k in (10_000, 1000))
    assert whole <= parts <= whole * 1.01 + 6
