import math
import random
from collections import Counter

from pyspark.sql import functions as F

from sievework.llm import target_sample as T


def test_unmet_quota_goes_to_siblings_then_cousins():
    lines = [T.Line("numeral", 0.3, 0, 10), T.Line("numeral_system", 0.3, 0, 32), T.Line("cipher", 0.4, 0, 100)]
    got = {x.category: x for x in T.allocate(lines, 100)}
    assert got["numeral"].wanted == 30 and got["numeral"].given == 10
    assert got["numeral_system"].given == 32 and got["cipher"].given == 58
    assert got["numeral"].taken_from == {"numeral_system": 2, "cipher": 18}


def test_minimum_is_kept_and_nothing_is_overdrawn():
    got = {x.category: x for x in T.allocate([T.Line("a", 0.99, 0, 500), T.Line("b", 0.01, 5, 9)], 100)}
    assert got["b"].given == 5 and got["a"].given == 95
    assert [x.given for x in T.allocate([T.Line("a", 0.5, 0, 1), T.Line("b", 0.5, 0, 0)], 10)] == [1, 0]
    assert T.allocate([], 5) == []


def test_sums_are_met_whatever_the_rounding():
    got = T.allocate([T.Line(c, 1 / 3, 0, 90) for c in ("a", "b", "c")], 100)
    assert sorted(x.given for x in got) == [33, 33, 34]
    rng = random.Random(1)
    for _ in range(300):
        words = ["_".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 9))]
        lines = [T.Line(c, rng.choice([0, 0.1, 0.25, 1 / 3]), rng.randint(0, 4), rng.randint(0, 40)) for c in sorted(set(words))]
        size = rng.randint(0, 150)
        got = T.allocate(lines, size)
        floors, all_ = sum(min(x.minimum, x.available) for x in got), sum(x.available for x in got)
        assert sum(x.given for x in got) == min(max(size, floors), all_)
        assert all(min(x.minimum, x.available) <= x.given <= x.available for x in got)


def test_nearest_relatives_stand_in_first():
    lines = [T.Line("a_b_c", 0.25, 0, 5), T.Line("a_b_d", 0.25, 0, 30), T.Line("a_e", 0.25, 0, 30), T.Line("f", 0.25, 0, 90)]
    got = {x.category: x for x in T.allocate(lines, 100)}
    assert got["a_b_c"].taken_from == {"a_b_d": 5, "a_e": 5, "f": 10}
    assert [got[c].given for c in ("a_b_c", "a_b_d", "a_e", "f")] == [5, 30, 30, 35]
    assert got["a_b_c"].lacking == 20 and got["a_b_d"].lacking == 0


def test_draw_is_exact_and_repeatable(spark):
    rows = [(f"i{k}", ["Cipher", "cipher", "ciher", "gravity", None][k % 5]) for k in range(500)] + [("i0", "Cipher"), (None, "cipher")]
    keyed = T.keyed_population(spark.createDataFrame(rows, "id string, c string"), "id", F.col("c"), ["cipher", "gravity"])
    assert Counter(r.category for r in keyed.collect()) == {"cipher": 300, "gravity": 100, None: 100}
    a, b = (sorted(map(tuple, T.draw(keyed, {"cipher": 70, "gravity": 100}, 3).collect())) for _ in range(2))
    assert a == b and Counter(c for _, c in a) == {"cipher": 70, "gravity": 100}
    assert T.draw(keyed, {}, 3).count() == 0 and T.draw(keyed.limit(0), {"cipher": 5}, 3).count() == 0


def test_plan_size_counts_records_without_category(spark):
    keyed = spark.createDataFrame([("a", "x"), ("b", None), ("c", None)], "id string, category string")
    lines, records, size = T.plan_lines(keyed, [(0.67, "x", 1.0, 0)])
    assert (records, size, lines[0].available) == (3, math.floor(0.67 * 3), 1)
