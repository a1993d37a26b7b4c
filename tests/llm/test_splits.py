import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievework.llm import splits as S

SCHEMA = "record_id string, keys array<string>"


@pytest.mark.parametrize(
    "text,want",
    [
        ("pref::unit_conversion_00000303::x00000000", ["unit_conversion_00000303"]),
        ("PREF_EQUATION_NUMERIC_00000007_x00000004", ["equation_numeric_00000007"]),
        ("pref|bit-manipulation-00001045|wrong_gate|x0000002e", ["bit_manipulation_00001045"]),
        ("pref::EquationNumericSymbolic:246::x0000019b", ["equation_numeric_symbolic_00000246"]),
        ("gravity_00000121.pref.x00000001", ["gravity_00000121"]),
        ("tokens/numeral_system_00000110/synthetic.json", ["numeral_system_00000110"]),
        ("cipher_00001435#v5", ["cipher_00001435"]),
        ("\tequation numeric 00003377 ", ["equation_numeric_00003377"]),
        ("pref::cipher_00000124+bit_manipulation_00003918::x7", ["bit_manipulation_00003918", "cipher_00000124"]),
        ("dec::x00000404", []),
        ("", []),
        (None, []),
    ],
)
def test_keys(one, text, want):
    assert one(S.problem_keys(F.col("a")), text) == want


def plain(rows):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, ks in rows:
        for k in ks:
            a, b = sorted((root(ks[0]), root(k)))
            parent[b] = a
    return {r: root(ks[0]) if ks else None for r, ks in rows}


@pytest.mark.parametrize("seed", [0, 1])
def test_groups_match_union_find(spark, seed):
    rng = random.Random(seed)
    rows = [(f"r{i}", sorted({f"k{rng.randint(0, 60):02d}" for _ in range(rng.choice([0, 1, 1, 2]))})) for i in range(120)]
    rows += [(f"hot{i}", ["k00"]) for i in range(60)] + rows[:5]
    rows += [(f"chain{i}", [f"z{i:02d}", f"z{i + 1:02d}"]) for i in range(40)]
    want = plain(rows)
    groups = S.group_records(spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit("clash")))
    got = {r.record_id: r.group_id for r in groups.collect()}
    assert got == want
    sizes = Counter(want.values())
    assert {r.record_id for r in S.shared_groups(groups).collect()} == {r for r, g in want.items() if g and sizes[g] > 1}


def test_splits_keep_groups_and_shares(spark):
    rows = [(f"r{i}", f"g{i // 3}") for i in range(900)] + [(f"big{i}", "big") for i in range(450)] + [(f"n{i}", None) for i in range(150)]
    shares = {"train": 0.8, "validation": 0.08, "test": 0.12}
    got = S.assign_splits(spark.createDataFrame(rows, "record_id string, group_id string"), shares)
    of = defaultdict(set)
    for r in got.collect():
        of[r.group_id or r.record_id].add(r.split)
    assert got.count() == 1500 and all(len(s) == 1 for s in of.values())
    for r in S.split_report(got, shares).collect():
        assert abs(r.actual_share - r.target_share) < 0.02


def test_empty_and_null(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert S.group_records(none).count() == 0
    assert S.group_records(spark.createDataFrame([(None, ["a"]), ("x", [])], SCHEMA)).collect()[0].group_id is None
    assert S.assign_splits(spark.createDataFrame([], "record_id string, group_id string"), {"a": 1.0}).count() == 0
