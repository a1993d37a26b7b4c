import math
import re

import pytest
from pyspark.sql import functions as F

from sievework.functions import answers as A

CASES = [
    (None, "NOT_FOUND"),
    ("", "NOT_FOUND"),
    ("  \n \t", "NOT_FOUND"),
    (r"so \boxed{42}", "42"),
    (r"\boxed{7} then \boxed{}", "7"),
    (r"\boxed{}", ""),
    (r"\boxed{1} or \boxed{2}.", "2"),
    (r"\boxed{a}b}c", "a}b"),
    (r"\boxed{open", "open"),
    (r"\boxed{}:::]", ""),
    (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}"),
    ("The final answer is: 12\nx", "12"),
    ("final answer: abc", "abc"),
    ("Final Answer： def ", "def"),
    ("Final answer: late\nThe final answer is: early", "early"),
    ("first 1 then -2.5 end", "-2.5"),
    ("no digits\n  last line \n\n", "last line"),
    (" 　x ", "x"),
    ("one\x0btwo", "two"),
    ("\\boxed{a\nb}", "a\nb"),
]


@pytest.mark.parametrize("text,want", CASES)
def test_final_answer(one, text, want):
    assert one(A.final_answer(F.col("a")), text) == want


def test_simple_and_balanced_boxes(one):
    assert one(A.boxed_simple(F.col("a")), r"\boxed{\frac{1}{2}}") == r"\frac{1"
    assert one(A.boxed_balanced(F.col("a")), r"\boxed{\frac{1}{2}}") == r"\frac{1}{2}"
    assert one(A.boxed_simple(F.col("a")), "none") == ""
    assert one(A.boxed_simple(F.col("a")), None) == ""


@pytest.mark.parametrize(
    "gold,pred,want",
    [
        ("0101", "101", False),
        ("0101", "0101", True),
        ("1", "1.0", False),
        ("2", "2.01", True),
        ("2", "2.03", False),
        ("nan", "nan", False),
        ("inf", "inf", True),
        ("1d", "1", False),
        ("2_0", "20", True),
        (" 2 ", "2", True),
        ("", "", True),
        ("Abc", "aBC", True),
        ("<|im_end|>x", "x", True),
        ("0", "0.000001", False),
        ("5e0", "5", True),
        (None, "none", True),
    ],
)
def test_verified(one, gold, pred, want):
    assert one(A.verified(F.col("a"), F.col("b")), gold, pred) is want


def test_tags_kept_when_asked(one):
    assert one(A.verified(F.col("a"), F.col("b"), strip_tags=False), "<|x|>a", "a") is False


def test_shapes(one):
    assert one(A.numeric_answer(F.col("a")), " -3.5 ") is True
    assert one(A.numeric_answer(F.col("a")), "3\n4") is False
    assert one(A.numeric_answer(F.col("a")), None) is False
    assert one(A.has_sign(F.col("a")), "ab1") is False
    assert one(A.has_sign(F.col("a")), "a b") is True


def test_reward_terms(one):
    r = one(A.reward(F.col("a"), F.col("b"), F.lit(True)), "We default to XYZ", "5")
    assert (r.exact, r.has_boxed, r.fallback_hit, r.internal_code) == (0, 0, 1, 0)
    assert math.isclose(r.reward, -0.1 - 0.1)
    r = one(A.reward(F.col("a"), F.col("b"), F.lit(True)), r"\boxed{XY}", "5")
    assert r.internal_code == 1 and math.isclose(r.reward, 0.05 - 0.15)
    r = one(A.reward(F.col("a"), F.col("b"), F.lit(False)), r"\boxed{5}", "5")
    assert math.isclose(r.reward, 1.05)


def test_random_texts_against_plain_python(spark):
    import random

    rng = random.Random(5)
    parts = [r"\boxed{", "}", "a", " 7 ", "\n", "-3.5", "final answer: ", "{", "x"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(300)]

    def plain(t):
        marks = [m for m in re.finditer(r"\\boxed\{", t)]
        got = []
        for i, m in enumerate(marks):
            s = t[m.end() : marks[i + 1].start() if i + 1 < len(marks) else len(t)]
            got.append((s[: s.rfind("}")] if "}" in s else s).strip())
        if got:
            return next((g for g in reversed(got) if g), got[-1])
        if f := re.findall(r"(?i)final answer\s*:\s*([^\n]+)", t):
            return f[-1].strip()
        if n := re.findall(r"-?\d+(?:\.\d+)?", t):
            return n[-1]
        return next((x.strip() for x in reversed(t.splitlines()) if x.strip()), "NOT_FOUND")

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", A.final_answer(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_reward_by_hand(one):
    """Amounts worked out by hand: 1.0 right, 0.05 boxed, -0.10 no box, -0.10 fallback phrase, -0.15 internal code."""

    def reward(text, gold, symbolic=True):
        return round(one(A.reward(F.col("a"), F.col("b"), F.lit(symbolic)), text, gold).reward, 6)

    phrase = A.FALLBACK_PHRASES[0]
    assert reward("so \\boxed{12}", "12") == 1.05
    assert reward("The final answer is: 12", "12") == 0.9
    assert reward("so \\boxed{13}", "12") == 0.05
    assert reward(f"{phrase} \\boxed{{13}}", "12") == -0.05
    assert reward(f"{phrase} \\boxed{{13}}", "12", symbolic=False) == 0.05
    assert reward("so \\boxed{ABz}", "12") == -0.1
    assert reward(f"{phrase} \\boxed{{AB}}", "12") == -0.2
    assert reward("ABx", "12") == -0.25
