import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions.names import canonical, snake
from sievework.operators import gates as G
from sievework.operators import joins as J
from sievework.operators import linalg as L
from sievework.operators import metrics as M
from sievework.operators import order as O
from sievework.runtime import running_total, settle, unit_hash


def test_names(spark):
    df = spark.createDataFrame([("Bit Manipulation",), ("BitManipulation",), (" cpiher\t",), ("zzz",), ("",), (None,)], "v string")
    got = [r.x for r in df.select(canonical(F.col("v"), ["bit_manipulation", "cipher"]).alias("x")).collect()]
    assert got == ["bit_manipulation", "bit_manipulation", "cipher", None, None, None]
    assert df.select(snake(F.col("v")).alias("x")).first().x == "bit_manipulation"


def test_running_total_matches_plain_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, n int").withColumn("k", unit_hash(F.col("i")))
    got = running_total(df, ["g"], "k", ["i"], F.col("n"), bits=3).collect()
    for g in "ab":
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.k, r.i)):
            total += r.n
            assert r.upto == total
    assert running_total(df.limit(0), ["g"], "k", ["i"]).count() == 0


def test_settle_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert sorted(settle(df).collect()) == sorted(df.collect()) and settle(df).schema == df.schema


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y"), (None, 0, "n"), ("", 0, "n")], "k string, p int, v string")
    assert {(r.k, r.v, r.first_pos.p) for r in O.last_wins(df, "k", ["p"]).collect()} == {("a", "z", 1), ("b", "y", 2)}
    assert {(r.k, r.v) for r in O.first_wins(df, "k", ["p"]).collect()} == {("a", "x"), ("b", "y")}


def test_numbered_and_batches(spark):
    df = spark.range(0, 23).select(F.col("id").cast("string").alias("s"))
    rn = {r.s: r.rn for r in O.numbered(df, ["s"]).collect()}
    assert [rn[s] for s in sorted(rn)] == list(range(1, 24))
    assert Counter(r.batch_id for r in O.batched(df, ["s"], 10).collect()) == {0: 10, 1: 10, 2: 3}
    assert Counter(r.batch_id for r in O.batched(df, ["s"], 10, drop_last=True).collect()) == {0: 10, 1: 10}
    assert O.batched(df, ["s"], 50, drop_last=True).count() == 23


def test_draws(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("s"))
    assert O.draw_or_all(df, "s", 0, 1).count() == 10 and O.draw_or_all(df, "s", 4, 1).count() == 4
    assert O.draw(df, "s", 0, 1).count() == 0 and O.draw(df, "s", 4, 1).count() == 4 and O.draw(df, "s", 99, 1).count() == 10
    over = O.draw_with_overflow(df, "s", 25, 1).collect()
    assert len(over) == 25 and {r.draw_no for r in over} == set(range(1, 26)) and len({r.s for r in over}) == 10
    assert O.draw_with_overflow(df.limit(0), "s", 5, 1).count() == 0
    forced = spark.createDataFrame([("7", 0), ("3", 1), ("nope", 2)], "id string, pos int")
    assert {"7", "3"} <= {r.s for r in O.draw_forced(df, "s", 4, 1, forced).collect()}
    assert [r.s for r in O.draw_forced(df, "s", 1, 1, forced).collect()] == ["7"]


def test_repeats(spark):
    df = spark.range(2)
    assert O.repeated(df, 0).count() == 0 and O.repeated(df, 0, 1).count() == 2
    assert sorted(r.repeat_index for r in O.repeated(df, 3).collect()) == [0, 0, 1, 1, 2, 2]


def test_top_per_group_with_ties(spark):
    df = spark.createDataFrame([("g", i % 3, i) for i in range(200)] + [("h", 0, 0)], "g string, v int, i int")
    got = O.top_per_group(df, ["g"], ["v", "i"], 5).collect()
    assert sorted((r.v, r.i) for r in got if r.g == "g") == [(0, 0), (0, 3), (0, 6), (0, 9), (0, 12)] and sum(r.g == "h" for r in got) == 1


def test_quantiles_are_floor_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v bigint")
    r = M.floor_quantiles(df, "v", [], [0.5, 0.99]).first()
    assert (r.p50, r.p99, r.n, r.total) == (3, 4, 4, 10)


def test_advantages(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "g string, r double")
    got = sorted((r.g, r.advantage) for r in M.advantages(df, ["g"], "r").collect())
    assert got == [("a", -1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0)]


def test_lookups(spark):
    k = spark.createDataFrame([("m.layers.1.mlp.up",), ("other",)], "name string")
    got = {r.name: (r.scale, r.matched) for r in J.scale_of(k, [("layers", 0.1), ("mlp.up", 0.2), ("layers.1", 0.3)], 1.0).collect()}
    assert got == {"m.layers.1.mlp.up": (0.3, "layers.1"), "other": (1.0, "__default__")}
    a = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    t1, t2 = spark.createDataFrame([("1", "x")], "id string, v string"), spark.createDataFrame([("1", "y"), ("2", "z")], "id string, v string")
    assert {(r.id, r.v) for r in J.by_priority(a, "id", [t1, t2], "v").collect()} == {("1", "x"), ("2", "z")}
    pairs = {(r.prefix, r.a is None, r.b is None) for r in J.tensor_pairs(spark.createDataFrame([("p.lora_A.weight",), ("p.lora_B.weight",), ("q.lora_A.weight",)], "name string")).collect()}
    assert pairs == {("p", False, False), ("q", False, True)}


def test_gates(spark):
    one = spark.createDataFrame([("x", "decision_sft", "odd", None, r"\boxed{1", "1", None, "s", 1.0)], "id string, row_type string, domain string, prompt string, completion string, final_answer string, decision_points string, source string, sample_weight double")
    assert {r.field for r in G.missing_fields(one, "decision_sft").collect()} == {"prompt", "decision_points", "domain"}
    r = G.answer_mismatch(one).first()
    assert r.malformed and r.mismatch
    assert [(r.side, r.k) for r in G.set_difference(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string"), "k").collect()] == [("left", "a"), ("right", "c")]
    bits = spark.createDataFrame([("10000001",)], "b string")
    for gate, want in (("i0", 1), ("NOT(i0)", 0), ("XOR(i0,i7)", 0), ("OR(i1,i7)", 1), ("AND(i0,i1)", 0), ("XNOR(i1,i2)", 1), ("??", None)):
        assert bits.select(G.gate_bit(F.lit(gate), F.col("b")).alias("x")).first().x == want
    with pytest.raises(ValueError):
        G.check_settings(8, 3, 4, 1, 10)
    src = spark.createDataFrame([("a.py", "submission_allowed = True\nsimpo_beta")], "path string, text string")
    found = {r.finding for r in G.script_findings(src).collect()}
    assert r"forbidden: submission_allowed\s*=\s*True" in found and "missing: simpo_beta" not in found and "missing: simpo_gamma" in found


def test_projection_sequence(spark):
    g = spark.createDataFrame([("w", "x", [1.0, 0.0]), ("w", "y", [-1.0, 1.0]), ("w", "z", [0.5, -2.0])], "name string, task string, g array<double>")
    got = {r.task: r.g for r in L.project_conflicts(g, ["x", "y", "z"]).collect()}
    v = [np.array([1.0, 0.0]), np.array([-1.0, 1.0]), np.array([0.5, -2.0])]
    for i in range(3):
        for j in range(3):
            if i != j and v[i] @ v[j] < 0:
                v[i] = v[i] - (v[i] @ v[j]) / (v[j] @ v[j]) * v[j]
    assert all(np.allclose(got[t], w) for t, w in zip("xyz", v, strict=True))
    assert L.combined(L.project_conflicts(g, ["x", "y", "z"]), 3).first().g == pytest.approx(list(sum(v) / 3))


def test_low_rank_sum_is_best_approximation():
    rng = np.random.default_rng(0)
    a1, b1, a2, b2 = rng.normal(size=(3, 7)), rng.normal(size=(6, 3)), rng.normal(size=(2, 7)), rng.normal(size=(6, 2))
    full = 0.5 * b1 @ a1 + 2.0 * b2 @ a2
    for balanced in (True, False):
        a, b = L.low_rank_sum(a1, b1, 0.5, a2, b2, 2.0, 8, balanced, balanced)
        assert np.allclose(b @ a, full)
        a, b = L.low_rank_sum(a1, b1, 0.5, a2, b2, 2.0, 2, balanced, balanced)
        assert np.linalg.norm(full - b @ a) == pytest.approx(np.sqrt((np.linalg.svd(full)[1][2:] ** 2).sum()))


def test_tensor_sums(spark):
    s = spark.createDataFrame([("e", 0, [1.0, 2.0]), ("e", 1, [3.0, 6.0])], "name string, slice int, g array<double>")
    assert [r.g for r in L.tied(s).collect()] == [[2.0, 4.0]] * 2 and [r.g for r in L.tied(s, "sum").collect()] == [[4.0, 8.0]] * 2
    assert L.clipped(s, 1.0).agg(F.sum(L.dot(F.col("g"), F.col("g")))).first()[0] == pytest.approx(1.0, abs=1e-5)
