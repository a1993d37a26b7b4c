"""Final answers: extraction, cleaning, tolerant comparison, rewards. All are JVM-side column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_FOUND = "NOT_FOUND"

# How a final answer is announced, in order of priority.
ANNOUNCED = (
    r"(?i)The final answer is:\s*([^\n]+)",
    r"(?i)Final answer is:\s*([^\n]+)",
    r"(?i)Final answer\s*[:：]\s*([^\n]+)",
)

# Phrases of a reply that gave up on the symbols.
FALLBACK_PHRASES = (
    "absolute difference",
    "default to concatenation",
    "question operator is not found",
    "question operator is unknown",
    "we default",
    "multiply+1",
    "multiply-1",
)

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row; an expression that names it twice would compute it twice."""
    return F.transform(F.array(value), body)[0]


_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def boxed_segments(c: Column) -> Column:
    """What each box holds: from its opening to the last brace before the next box, or all if none closes it."""
    parts = F.split(c, r"\\boxed\{")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: strip(F.when(s.contains("}"), F.regexp_extract(s, r"(?s)^(.*)\}", 1)).otherwise(s)))


def final_answer(c: Column) -> Column:
    """The reply's final answer, never null.

    The last non-empty box (else the last box), else the last announced answer by priority, else the
    last number, else the last non-blank line, else NOT_FOUND (also for null).
    """
    box = let(boxed_segments(c), lambda b: F.coalesce(F.try_element_at(F.filter(b, lambda s: s != ""), F.lit(-1)), F.try_element_at(b, F.lit(-1))))
    said = [strip(F.try_element_at(F.regexp_extract_all(c, F.lit(p), 1), F.lit(-1))) for p in ANNOUNCED]
    number = F.try_element_at(F.regexp_extract_all(c, F.lit(r"-?\d+(?:\.\d+)?"), 0), F.lit(-1))
    lines = F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\x{2028}\x{2029}]"), strip), lambda x: x != "")
    return F.coalesce(box, *said, number, F.try_element_at(lines, F.lit(-1)), F.lit(NOT_FOUND))


def boxed_simple(c: Column) -> Column:
    """The last box up to its first closing brace, stripped; empty if there is none or the text is null."""
    return F.coalesce(strip(F.try_element_at(F.regexp_extract_all(c, F.lit(r"\\boxed\{([^}]*)\}"), 1), F.lit(-1))), F.lit(""))


def boxed_balanced(c: Column) -> Column:
    """The last box with braces balanced up to two levels deep; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"), 1), F.lit(-1))


def clean(c: Column) -> Column:
    """Without special tags `<|...|>`, stripped."""
    return strip(F.regexp_replace(c, r"<\|[^>]+?\|>", ""))


def number(c: Column) -> Column:
    """The value as a double where the whole text is a plain number, `nan` or `inf`; else null."""
    s = F.lower(strip(c))
    plain = F.when(s.rlike(r"^[-+]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[-+]?\d+)?\z"), F.regexp_replace(s, "_", "")).when(s.rlike(r"^[-+]?inf(?:inity)?\z"), F.regexp_replace(s, "inf(?:inity)?", "Infinity")).when(s.rlike(r"^[-+]?nan\z"), "NaN")
    return plain.try_cast("double")


def verified(gold: Column, predicted: Column, strip_tags: bool = True, rel: float = 1e-2, abs_: float = 1e-5) -> Column:
    """Whether the prediction is right; never null.

    A gold answer of only 0 and 1 is compared as text; two numbers by tolerance (rel of the
    larger, or abs_; infinities only equal themselves, nan equals nothing); all else as text
    without case. A null side is taken as the text `None`.
    """
    prep = clean if strip_tags else strip
    inf = F.lit(float("inf"))

    def numbers(x: Column) -> Column:
        a, b = x.a, x.b
        close = F.when(F.isnan(a) | F.isnan(b), False).when((F.abs(a) == inf) | (F.abs(b) == inf), a == b).otherwise(F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_)))
        return F.when(a.isNotNull() & b.isNotNull(), close).otherwise(x.same)

    def compare(x: Column) -> Column:
        same = F.lower(x.g) == F.lower(x.p)
        return F.when(x.g.rlike(r"^[01]+\z"), same).otherwise(let(F.named_struct(F.lit("a"), number(x.g), F.lit("b"), number(x.p), F.lit("same"), same), numbers))

    return let(F.named_struct(F.lit("g"), prep(F.coalesce(gold, F.lit("None"))), F.lit("p"), prep(F.coalesce(predicted, F.lit("None")))), compare)


def numeric_answer(c: Column) -> Column:
    """Whether the stripped text is a signed decimal number; null is none."""
    return F.coalesce(strip(c).rlike(r"^[-+]?\d+(?:\.\d+)?\z"), F.lit(False))


def has_sign(c: Column) -> Column:
    """Whether any character is neither letter nor digit; null has none."""
    return F.coalesce(c.rlike(r"[^\p{L}\p{N}]"), F.lit(False))


def boxed(c: Column) -> Column:
    return F.concat(F.lit("\\boxed{"), c, F.lit("}"))


def has_box(c: Column) -> Column:
    return F.coalesce(c.contains("\\boxed{"), F.lit(False))


def verified_target(text: Column, answer: Column) -> Column:
    """Whether a non-empty text ends in the right answer."""
    return F.coalesce(text != "", F.lit(False)) & verified(answer, final_answer(text))


def reward(completion: Column, gold: Column, symbolic: Column, exact: float = 1.0, box: float = 0.05, no_box: float = -0.1, fallback: float = -0.1, code: float = -0.15) -> Column:
    """struct(prediction, exact, has_boxed, fallback_hit, internal_code, reward) of one completion.

    Right answers earn `exact`; a box or its lack counts; of wrong answers to symbolic tasks those with a
    fallback phrase, and those that are an internal code (capitals, x, y, z or ?), lose more.
    """
    text = F.coalesce(completion, F.lit(""))
    as_int = lambda x: x.cast("int")

    def terms(x: Column) -> Column:
        total = F.when(x.ok, exact).otherwise(0.0) + F.when(x.boxed, box).otherwise(no_box) + F.when(x.hit & ~x.ok, fallback).otherwise(0.0) + F.when(x.inner, code).otherwise(0.0)
        return F.named_struct(F.lit("prediction"), x.pred, F.lit("exact"), as_int(x.ok), F.lit("has_boxed"), as_int(x.boxed), F.lit("fallback_hit"), as_int(x.hit), F.lit("internal_code"), as_int(x.inner), F.lit("reward"), total)

    def judged(x: Column) -> Column:
        hit = symbolic & F.exists(F.array(*map(F.lit, FALLBACK_PHRASES)), lambda p: F.contains(F.lower(text), p))
        inner = symbolic & ~x.ok & strip(x.pred).rlike(r"^[A-Zxyz?]{2,}\z")
        return let(F.named_struct(F.lit("pred"), x.pred, F.lit("ok"), x.ok, F.lit("boxed"), has_box(completion), F.lit("hit"), hit, F.lit("inner"), inner), terms)

    return let(final_answer(completion), lambda p: let(F.named_struct(F.lit("pred"), p, F.lit("ok"), verified(gold, p)), judged))
