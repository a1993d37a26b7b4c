"""Queries that must cover their whole table, against plain Python on small tables."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievework.functions import tokens as T
from sievework.plans import catalog, repair  # noqa: F401 - repair adds its queries to the catalogue

AT = datetime(2026, 1, 1)


def run(spark, folder, name, **tables):
    """The rows of a query over tables(rows, schema)."""
    for t, (rows, schema) in tables.items():
        spark.createDataFrame([(*r, AT) for r in rows], f"{schema}, ingested_at timestamp").write.parquet(f"{folder}/{t}.parquet")
    return catalog.QUERIES[name](spark, str(folder)).collect()


def position(tokens, needle):
    return next((i for i in range(len(tokens) - len(needle) + 1) if tokens[i : i + len(needle)] == needle), -1) if needle else -1


def test_token_positions_of_every_length(spark, tmp_path):
    rng = random.Random(4)
    items = {f"p{n}": [rng.randint(1, 3) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 9, 399, 400, 401, 1500, 9000)}
    items["late"] = [1, 2, 2] + [1] * 500
    got = run(spark, tmp_path, "token_positions", token_corpus=([(k, None, v, [0.0] * len(v)) for k, v in items.items()], "problem_id string, category string, tokens array<bigint>, mask array<double>"))
    assert {r["problem_id"]: r["at"] for r in got} == {k: position(v, v[1:4]) for k, v in items.items()}


def test_find_against_brute_force(spark):
    rng = random.Random(5)
    rows = [([rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 600]))], [rng.randint(1, 4) for _ in range(rng.choice([0, 1, 2, 4]))]) for _ in range(60)]
    got = spark.createDataFrame(rows, "t array<bigint>, n array<bigint>").select("t", "n", T.find(F.col("t"), F.col("n")).alias("at")).collect()
    assert len(got) == 60 and all(r["at"] == position(r["t"], r["n"]) for r in got)


def test_tail_begins_at_the_last_boxed_marker(spark, tmp_path):
    texts = {"none": "no box at all in here today", "one": "a b c \\boxed{4} d", "two": "a \\boxed{1} b c d e f g \\boxed{2 3}\nend", "first": "\\boxed{x} y", "glued": "so x=\\boxed{5} ok", "blank": " ", "null": None}
    got = run(spark, tmp_path, "boxed_tail_weights", rsp_decision_sft=(list(texts.items()), "id string, completion string"))

    def weights(text):
        words, at = (text or "").split(), (text or "").rfind("\\boxed{")
        return [3.0 if 0 <= at and i >= len(text[:at].split()) else 1.0 for i in range(len(words))]

    assert {r["id"]: r["weights"] for r in got} == {k: weights(v) for k, v in texts.items()}


_EVAL = "id string, problem_id string, category string, prompt string, answer string, raw_output string, exact_match int"


def ev(i, category, problem="x", right=1, prompt="p" * 900):
    return (i, problem, category, prompt, "7", "\\boxed{7}" if right else "\\boxed{8}", right)


def test_whole_category_in_any_spelling(spark, tmp_path):
    rows = [ev("e3", "equation_numeric"), ev("e1", "Equation Numeric", right=0), ev("e2", "eqution_numeric"), ev("e4", "EquationNumeric "), ev("s", "equation_numeric_symbolic"), ev("b", "bit_manipulation"), ev("n", None)]
    got = run(spark, tmp_path, "whole_category", eval_prediction=(rows, _EVAL))
    assert sorted((r["place"], r["id"], r["exact"]) for r in got) == [(1, "e1", 0), (2, "e2", 1), (3, "e3", 1), (4, "e4", 1)]


def test_empty_and_foreign_categories_are_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="no rows where"):
        run(spark, tmp_path, "whole_category", eval_prediction=([ev("b", "cipher")], _EVAL))
    p = spark.createDataFrame([ev("a", "cipher"), ev("b", "Gravity")], _EVAL)
    with pytest.raises(ValueError, match="gravity"):
        repair.only_category(p, "cipher")
    with pytest.raises(ValueError, match="no rows"):
        repair.only_category(p.limit(0), "cipher")


def test_predicates_of_the_caller(spark):
    p = spark.createDataFrame([ev("a", "cipher", "c_1", prompt="short"), ev("b", "cipher", "c_2"), ev("c", "gravity", "c_1")], _EVAL)
    got = repair.matching(p, F.col("category") == "cipher", F.col("problem_id").startswith("c_"), F.length("prompt") <= 10)
    assert [r["id"] for r in got.collect()] == ["a"]
    with pytest.raises(ValueError):
        repair.matching(p, F.length("prompt") <= 1)


def test_mix_gives_equal_parts_and_forces_anchors(spark, tmp_path):
    rows = [ev(f"c{i:03}", "cipher") for i in range(300)] + [ev(f"g{i}", "Gravity") for i in range(5)] + [ev(f"n{i}", "numeral") for i in range(5)] + [ev("u0", None), ev("u1", None)]
    rows += [ev(f"b{i:03}", "bit_manipulation", "hk_3302f383" if i in (7, 70) else "hk_c095f799-p0" if i == 90 else f"q{i}") for i in range(200)]
    rows += [ev(f"e{i:03}", "equation_numeric", right=i % 2) for i in range(200)]
    got = {r["id"]: r["mix_group"] for r in run(spark, tmp_path, "equal_parts_mix", eval_prediction=(rows, _EVAL))}
    count = lambda g: sum(v == g for v in got.values())
    assert {i for i, g in got.items() if g == "bit_replay_anchor"} == {"b007", "b090"}  # the first row of each anchor
    assert (count("targeted_equation_fix"), count("equation_replay_correct"), count("bit_replay")) == (64, 26, 24)
    others = [i[0] for i, g in got.items() if g == "other_category_replay"]
    assert {c: others.count(c) for c in "cgnu"} == {"c": 3, "g": 3, "n": 3, "u": 2}


def test_mix_without_total_keeps_all(spark):
    p = spark.createDataFrame([ev("a", "cipher"), ev("b", "bit_manipulation"), ev("c", "equation_numeric", right=0)], _EVAL)
    assert {r["id"] for r in catalog.replay_mix(p, 0, (), 1).collect()} == {"a", "b", "c"}


_CORPUS = "problem_id string, category string, tokens array<bigint>, mask array<double>"


def test_items_are_cut_at_the_contract_length(spark, tmp_path):
    rows = [(f"p{n}", None, list(range(n)), [1.0] * n) for n in (0, 1025, 8192, 8193)]
    got = run(spark, tmp_path, "contract_length_policy", token_corpus=(rows, _CORPUS))
    assert {r["problem_id"]: (r["too_long"], r["cut"], r["supervised"]) for r in got} == {k: (len(t) > 8192, t[:8192], min(len(t), 8192)) for k, _, t, _ in rows}
    (stats,) = catalog.QUERIES["contract_length_stats"](spark, str(tmp_path)).collect()
    assert (stats["items"], stats["kept"], stats["skipped"], stats["longest"]) == (4, 3, 1, 8193)


def test_long_pairs_keep_their_loss_tokens(spark, tmp_path):
    long = "w " * 300
    got = run(
        spark, tmp_path, "contract_sft_records",
        rsp_decision_sft=([("a", long, "x " * 400), ("b", "w " * 8000, "x " * 400)], "id string, prompt string, completion string"),
        rsp_decision_preferences=([("a", long, "x y", "z"), ("b", "w " * 8192, "x", "y")], "id string, prompt string, chosen string, rejected string"),
    )
    assert {r["id"]: (len(r["input_ids"]), sum(x != -100 for x in r["labels"])) for r in got} == {"a": (700, 400), "b": (8192, 192)}
    pairs = catalog.QUERIES["contract_preference_records"](spark, str(tmp_path)).collect()
    assert [(r["id"], r["chosen_loss"], r["rejected_loss"]) for r in pairs] == [("a", 2, 1)]


def test_every_domain_gets_its_share(spark, tmp_path):
    names = {"cipher": 90, "Gravity": 20, "unit-conversion": 20, "eqution_numeric": 20, "numeral_system": 3, None: 20, "  ": 20, "something else": 20}
    rows = [(f"{k}{i}", k) for k, n in names.items() for i in range(n)]
    got = run(spark, tmp_path, "stratified_domains", rsp_anchor_sft=(rows, "id string, domain string"))
    parts = {}
    for r in got:
        parts[r["domain"]] = parts.get(r["domain"], 0) + 1
    # 101 = 7 x 14 + 3: the first three in sorted order get one more
    assert parts == {"cipher": 15, "equation_numeric": 15, "gravity": 15, "numeral_system": 3, "something_else": 14, "unit_conversion": 14, "unknown": 14}
