"""Gates: checks that give rows of violations, and verdicts over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.answers import boxed_simple, strip

# The required fields of each row family, the domains and the least row counts.
REQUIRED = {
    "anchor_sft": ("id", "row_type", "domain", "prompt", "completion", "final_answer", "source", "sample_weight"),
    "decision_sft": ("id", "row_type", "domain", "prompt", "completion", "final_answer", "decision_points", "source", "sample_weight"),
    "decision_preference": ("id", "row_type", "domain", "prompt", "chosen", "rejected", "chosen_answer", "rejected_answer", "decision_points", "negative_type", "source", "sample_weight"),
}
DOMAINS = ("bit_manipulation", "equation_numeric", "equation_numeric_symbolic", "cryptarithm", "cipher", "gravity", "numeral", "numeral_system", "unit_conversion")
LEAST_ROWS = {"anchor_sft": 7000, "decision_sft": 1000, "decision_preferences": 1000}
MOST_PREFERENCE_RATIO = 0.35
MODULES = ("q_proj", "k_proj", "v_proj", "o_proj", "in_proj", "out_proj", "up_proj", "down_proj", "lm_head")
ADAPTER = {"r": 32, "lora_alpha": 32, "lora_dropout": 0.0}

# What a training script must and must not contain.
SCRIPT_NEEDS = ("rsp_decision_preferences.jsonl", "simpo_beta", "simpo_gamma", "preference_learning_rate", "preference_gradient_accumulation_steps", "F.logsigmoid", "chosen - rejected", "verify_rsp_dataset.py", "write_submission_zip")
SCRIPT_FORBIDS = (r"kaggle\s+competitions\s+submit", r"competitions\.submit", r"submission_allowed\s*=\s*True", r"EVALUATION_ALLOWED\s*=\s*True", r"build_eval_kernel", r"verify_eval_output")


def missing_fields(df: DataFrame, family: str, key: str = "id") -> DataFrame:
    """(id, row_type, field): required fields that are null; an unknown domain counts as field `domain`."""
    bad = [F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED[family]]
    odd = F.when(F.col("domain").isNotNull() & ~F.col("domain").isin(*DOMAINS), F.lit("domain"))
    return df.select(F.col(key).alias("id"), F.lit(family).alias("row_type"), F.explode(F.array_compact(F.array(*bad, odd))).alias("field"))


def count_gate(counts: Mapping[str, DataFrame], least: Mapping[str, int] = LEAST_ROWS) -> DataFrame:
    """(family, rows, least, passed) by distinct id."""
    out = None
    for family, df in counts.items():
        one = df.agg(F.countDistinct("id").alias("rows")).select(F.lit(family).alias("family"), "rows", F.lit(least[family]).cast("bigint").alias("least"))
        out = one if out is None else out.union(one)
    return out.withColumn("passed", F.col("rows") >= F.col("least"))


def ratio_gate(preferences: DataFrame, anchors: DataFrame, most: float = MOST_PREFERENCE_RATIO) -> DataFrame:
    """One row: preferences, anchors, ratio (null without anchors), passed."""
    p, a = preferences.agg(F.countDistinct("id").alias("preferences")), anchors.agg(F.countDistinct("id").alias("anchors"))
    j = p.join(a).withColumn("ratio", F.col("preferences") / F.nullif("anchors", F.lit(0)))
    return j.withColumn("passed", F.coalesce(F.col("ratio") <= most, F.lit(False)))


def answer_mismatch(df: DataFrame, text: str = "completion", answer: str = "final_answer") -> DataFrame:
    """Adds boxed, malformed (a box that is never closed) and mismatch (boxed differs from the answer)."""
    box = boxed_simple(F.col(text))
    return df.withColumns({"boxed": box, "malformed": F.coalesce(F.col(text).rlike(r"\\boxed\{[^}]*\z"), F.lit(False)), "mismatch": box != strip(F.coalesce(answer, F.lit("")))})


def same_outcome(df: DataFrame, a: str = "chosen", b: str = "rejected") -> DataFrame:
    """Preference rows whose two replies end in the same box (an empty one included)."""
    return df.where(boxed_simple(F.col(a)) == boxed_simple(F.col(b)))


def gate_bit(gate: Column, bits: Column) -> Column:
    """The output of a gate iK, NOT(x), AND/OR/XOR/XNOR/NAND/NOR(x,y) on a string of bits; null if it can't be read."""
    at = lambda k: F.substring(bits, F.regexp_extract(gate, rf"^[^i]*i(\d+)(?:,i(\d+))?", k).try_cast("int") + 1, F.lit(1))
    name = F.regexp_extract(gate, r"^([A-Z]*)", 1)
    x, y = at(1) == "1", at(2) == "1"
    out = F.when(name == "", x).when(name == "NOT", ~x).when(name == "AND", x & y).when(name == "OR", x | y).when(name == "XOR", x != y).when(name == "XNOR", x == y).when(name == "NAND", ~(x & y)).when(name == "NOR", ~(x | y))
    return out.cast("int")


def gate_replay(df: DataFrame) -> DataFrame:
    """(id, bit, selected, examples, wrong): how many of the prompt's examples `in -> out` each selected gate contradicts.

    Rows are bit tasks with decision_points(bit, selected); bits and positions are numbered from the left, from 0.
    """
    pairs = F.arrays_zip(
        F.regexp_extract_all("prompt", F.lit(r"(?m)^[-\[in: ]*([01]{8})\D{1,12}([01]{8})"), 1).alias("i"),
        F.regexp_extract_all("prompt", F.lit(r"(?m)^[-\[in: ]*([01]{8})\D{1,12}([01]{8})"), 2).alias("o"),
    )
    d = df.select("id", F.explode("decision_points").alias("d"), pairs.alias("pairs")).select("id", "d.bit", "d.selected", "pairs")
    wrong = F.filter("pairs", lambda p: F.coalesce(gate_bit(F.col("selected"), p["i"]) != F.substring(p["o"], F.col("bit") + 1, F.lit(1)).cast("int"), F.lit(True)))
    return d.select("id", "bit", "selected", F.size("pairs").alias("examples"), F.size(wrong).alias("wrong"))


def script_findings(sources: DataFrame) -> DataFrame:
    """(path, finding) for sources(path, text): required words that are missing and forbidden patterns that are there."""
    need = [F.when(~F.col("text").contains(w), F.lit(f"missing: {w}")) for w in SCRIPT_NEEDS]
    ban = [F.when(F.col("text").rlike(f"(?i){p}"), F.lit(f"forbidden: {p}")) for p in SCRIPT_FORBIDS]
    return sources.select("path", F.explode(F.array_compact(F.array(*need, *ban))).alias("finding"))


def verdict(findings: DataFrame, message: str, first: int = 50) -> DataFrame:
    """One row: number of findings, the first ones in sorted order, passed."""
    n = findings.agg(F.count(F.lit(1)).alias("findings"))
    some = findings.orderBy(message).limit(first).agg(F.array_sort(F.collect_list(message)).alias("first"))
    return n.join(some).withColumn("passed", F.col("findings") == 0)


def set_difference(a: DataFrame, b: DataFrame, key: str, first: int = 10) -> DataFrame:
    """(side, key): the first sorted keys that only one side has; no rows if the sets are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    only = lambda p, q, side: p.join(q, key, "left_anti").orderBy(key).limit(first).select(F.lit(side).alias("side"), key)
    return only(x, y, "left").union(only(y, x, "right"))


def same_modules(modules: Column, expected: Sequence[str] = MODULES) -> Column:
    return F.array_sort(F.array_distinct(modules)) == F.array(*[F.lit(m) for m in sorted(expected)])


def check_settings(batch: int, accumulation: int, rank: int, epochs: float, longest: int, most_rank: int = 32) -> None:
    """Raises ValueError on settings that no training run may have."""
    if min(batch, accumulation, rank, longest) < 1 or epochs <= 0:
        raise ValueError("sizes must be positive")
    if batch % accumulation:
        raise ValueError("the batch is no multiple of the accumulation steps")
    if rank > most_rank:
        raise ValueError(f"rank {rank} exceeds {most_rank}")


def only_one(spark: SparkSession, paths: DataFrame, label: str) -> str:
    """The single distinct path; ValueError if there is none or more than one."""
    got = [r.path for r in paths.select("path").distinct().orderBy("path").limit(3).collect()]
    if len(got) != 1:
        raise ValueError(f"{label}: expected one path, found {got}")
    return got[0]
