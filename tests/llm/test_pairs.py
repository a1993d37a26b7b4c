import random
from collections import Counter

import pytest

from sievework.llm import pairs as P

PROMPT = "Find the hidden rule that is used in the notes.\nExamples:\n12 @ 5 -> 77\n13 @ 6 -> 80\nNow give the result for 14 @ 9"
SCHEMA = "id string, prompt string, completion string, final_answer string, lang_q string"
GOOD = "The first line is compared with the rule. So the result is \\boxed{83}."
ROWS = {
    "null": (None, "83", "empty", None),
    "blank": (" \n​", "N/A", "empty", "empty"),
    "markup": ("<think>\n</think><|im_end|>", "none", "empty", "empty"),
    "slot": ("\\boxed{}", " ", "empty", "empty"),
    "cut": ("The first line is compared with the rule and that is wh", "83", "truncated", None),
    "cutbox": ("The rule holds for each line, so the result is \\boxed{8", "83", "truncated", None),
    "refuse": ("I'm sorry, but I can't help with this task.", "declined to answer", "refusal", "refusal"),
    "refuse_de": ("Es tut mir leid, dabei kann ich nicht helfen.", "83", "refusal", None),
    "copy": (PROMPT, "12 @ 5 -> 77 13 @ 6 -> 80", "copied_question", "copied_question"),
    "copy_lines": ("question: examples:\n13 @ 6 -> 80", "83", "copied_question", None),
    "foreign": ("Ich vergleiche zuerst die Beispiele und suche eine Regel, das Ergebnis ist \\boxed{83}.", "83", "other_language", None),
    "prefix": (GOOD, "8", None, "truncated"),
    "good": (GOOD, "83", None, None),
    "wrong": ("I am not able to keep the shorter rule because it fails. \\boxed{12}", "12", None, None),
    "box_only": ("\\boxed{83}", "83", None, None),
}


def frame(spark, n=12):
    rows = [(f"{k}{j}", PROMPT, c, f, "clash") for k, (c, f, _, _) in ROWS.items() for j in range(n if k not in ("good", "box_only") else 20 * n)]
    return spark.createDataFrame([*rows, rows[0], ("noprompt", None, GOOD, "83", "x"), (None, PROMPT, None, None, "x")], SCHEMA)


def label(df):
    return P.label(P.stacked(df.drop("lang_q"), "id", "prompt", ["completion", "final_answer"], {"final_answer": "completion"}))


def test_every_defect(spark):
    got = {(r.record_id, r.field): r.defect for r in label(frame(spark)).collect()}
    for k, (_, _, c, f) in ROWS.items():
        assert got.get((f"{k}0", "completion")) == c, k
        assert got.get((f"{k}0", "final_answer")) == f, k
    assert not any(i == "noprompt" or i is None for i, _ in got)


def test_empty_table(spark):
    assert label(frame(spark).limit(0)).count() == 0


def test_label_model_weighs_functions():
    post = P.fit({"111": 50, "000": 900, "100": 30, "011": 20})
    assert post["111"] > 0.9 and post["011"] > post["100"] and post["000"] < 0.01
    assert P.fit({}) == {}
    assert 0.5 <= P.cutoff({"11": 5, "00": 90}, P.fit({"11": 5, "00": 90})) <= 0.95


@pytest.mark.parametrize("text,want", [("the rule is that which has been seen", "en"), ("die Regel ist für alle Zeilen", "de"), ("la regla es la que se usa en los ejemplos", "es"), ("la règle est dans les exemples que je vois", "fr"), ("규칙을 찾습니다", "ko"), ("123", None), (None, None)])
def test_language(spark, text, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "a string").select(P.language(F.col("a")).alias("x")).first().x == want


def test_model_outdoes_its_functions():
    """Noisy functions of unlike accuracy: the model against any vote and against the majority, on known truth."""
    rng = random.Random(1)
    hit, false = [0.95, 0.5, 0.99, 0.98], [0.002, 0.001, 0.05, 0.3]
    rows = []
    for _ in range(20_000):
        y = rng.random() < 0.02
        rows.append((y, "".join("1" if rng.random() < (hit[j] if y else false[j]) else "0" for j in range(4))))
    planted = Counter(p for y, p in rows[:4000] if y)
    counts = Counter(p for _, p in rows)
    model = P.learn(counts, {p: (float(n), 0.0) for p, n in planted.items()})

    def f1(says):
        true = sum(y and says(p) for y, p in rows)
        return 2 * true / (sum(says(p) for _, p in rows) + sum(y for y, _ in rows))

    ours, majority, any_ = f1(lambda p: model.posterior(p) >= 0.5), f1(lambda p: p.count("1") > 2), f1(lambda p: "1" in p)
    assert ours > 0.95 and ours > majority and any_ < 0.2


def test_a_value_can_carry_two_labels(spark):
    both = "Ich vergleiche zuerst die Beispiele und suche eine Regel, das Ergebnis ist dann mit der"
    df = frame(spark).union(spark.createDataFrame([(f"two{j}", PROMPT, both, "83", "x") for j in range(12)], SCHEMA))
    got = {r.record_id: r.labels for r in label(df).collect() if r.field == "completion"}
    assert got["two0"] == ["other_language", "truncated"] and got["cut0"] == ["truncated"]
