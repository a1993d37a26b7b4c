"""Prompts, completions and chat turns as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.answers import boxed, boxed_simple, clean, final_answer, has_sign, let, numeric_answer, strip, verified_target

# Chat markers, the sentences of templated replies, and the one that asks for a box.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = START + "assistant"
APPLY = "S4: APPLY target"
PLAIN_EQUATION = "Select the branch from the operator character in the input.\nCopy literal punctuation symbols exactly into the output.\n"
PLAIN_BIT = "Resolve each bit position independently, then output the 8-bit string.\n"
HINT_BIT = "This is a bit-column task. Resolve every output bit with the verified column or gate, do not fall back to decimal numbers, and always finish with an 8-bit boxed answer.\n"
HINT_OPERATOR = "Use the middle input character at position 2 as the operator branch."
HINT_LITERAL = "Keep literal punctuation symbols exactly; do not replace them with internal labels."
HINT_SYMBOLIC = "This target answer is symbolic, so do not use a numeric fallback."
HINT_BACKTICK = "The backtick suffix is part of the final answer and must be preserved."
HINT_SIGNS = "Do not drop, normalize, or translate punctuation in the boxed answer."
BOX_REQUEST = "\nPlease put your final answer inside `\\boxed{}`. For example: `\\boxed{your answer}`"


def user_prompt(c: Column, fallback: bool = True) -> Column:
    """The last user turn, stripped; without one the text without tags, or empty if not `fallback`."""
    turn = F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?s)<\|im_start\|>user\n(.*?)<\|im_end\|>"), 1), F.lit(-1))
    return F.coalesce(strip(turn), clean(c) if fallback else F.lit(""))


def assistant_text(c: Column) -> Column:
    """All behind the first assistant marker, stripped; empty if there is none."""
    at = F.instr(c, ASSISTANT)
    return F.when(at > 0, strip(F.substr(c, at + len(ASSISTANT)))).otherwise("")


def with_box_request(prompt: Column) -> Column:
    """The prompt with the request for a box, unless it has it already."""
    return F.when(prompt.contains(BOX_REQUEST.strip()), prompt).otherwise(F.concat(prompt, F.lit(BOX_REQUEST)))


def ended(c: Column) -> Column:
    """The text with the end marker, trailing space removed where it is appended."""
    return F.when(c.endswith(END), c).otherwise(F.concat(F.regexp_replace(c, r"\s+$", ""), F.lit(END)))


def normal_completion(text: Column, answer: Column) -> Column:
    """A completion whose last box is the answer: other boxes are taken out and one is appended if it is not."""
    body = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(END), F.lit("")), r"\s+$", "")
    gold = strip(answer)
    bare = F.regexp_replace(F.regexp_replace(body, r"\\boxed\{[^}]*\}", ""), r"\s+$", "")
    return ended(F.when(boxed_simple(body) != gold, F.concat(bare, F.lit("\n"), boxed(gold))).otherwise(body))


def normal_response(text: Column) -> Column:
    """A reply as it continues an opened thought: cut behind the assistant marker, without a leading think tag, ended."""
    body = strip(text)
    at = F.instr(body, ASSISTANT)
    body = F.when(at > 0, strip(F.substr(body, at + len(ASSISTANT)))).otherwise(body)
    body = F.when(body.startswith("<think>"), F.regexp_replace(F.substr(body, F.lit(8)), r"^\s+", "")).otherwise(body)
    return ended(body)


def plain_reply(answer: Column, category: Column) -> Column:
    """The reply of last resort: a sentence on the category and the boxed answer."""
    line = F.concat(F.lit("Final answer: "), boxed(strip(answer)))
    return F.concat(F.when(category == "equation_numeric", PLAIN_EQUATION).when(category == "bit_manipulation", PLAIN_BIT).otherwise(""), line, F.lit(END))


def correction_reply(answer: Column, category: Column) -> Column:
    """The reply that corrects a wrong one, with the hints that the answer's form calls for."""
    a = strip(answer)
    line = F.concat(F.lit("Final answer: "), boxed(a))
    hints = F.concat_ws(
        "\n",
        F.lit(HINT_OPERATOR),
        F.lit(HINT_LITERAL),
        F.when(~numeric_answer(a), HINT_SYMBOLIC),
        F.when(a.contains("`"), HINT_BACKTICK),
        F.when(has_sign(a), HINT_SIGNS),
        line,
    )
    return F.when(category == "bit_manipulation", F.concat(F.lit(HINT_BIT), line)).when(category == "equation_numeric", hints).otherwise(line)


def _applied(x: Column) -> Column:
    return F.concat(F.lit(APPLY + "\nresult = "), x, F.lit("\n</think>\n"), boxed(x), F.lit(END))


def rejected_reply(prediction: Column) -> Column:
    wrong = strip(F.coalesce(prediction, F.lit("")))
    return _applied(F.when(wrong == "", "NOT_FOUND").otherwise(wrong))


def apply_reply(reference: Column, answer: Column) -> Column:
    """The reference from its application step on, if it is verified and has one; else a template."""
    tail = F.regexp_extract(normal_response(reference), r"(?s)(\bS4:\s*APPLY\b.*)$", 1)
    return F.when(verified_target(reference, answer) & (tail != ""), strip(tail)).otherwise(_applied(strip(answer)))


def guard_reply(reference: Column, answer: Column) -> Column:
    return F.when(verified_target(reference, answer), normal_response(reference)).otherwise(F.concat(F.lit("Final answer: "), boxed(strip(answer)), F.lit(END)))


def teacher_reply(reference: Column, raw: Column, exact: Column, answer: Column, category: Column) -> Column:
    """struct(response, source, extracted): the first candidate that is verified, else the reply of last resort."""
    gold = strip(answer)
    sound = F.named_struct(F.lit("a"), verified_target(reference, gold), F.lit("b"), (F.coalesce(exact, F.lit(0)) == 1) & verified_target(raw, gold))

    def chosen(x: Column) -> Column:
        text = F.when(x.a, normal_response(reference)).when(x.b, normal_response(raw)).otherwise(plain_reply(answer, category))
        source = F.when(x.a, "reference_response").when(x.b, "raw_output_exact").otherwise("fallback_boxed_answer")
        return let(text, lambda t: F.named_struct(F.lit("response"), t, F.lit("source"), source, F.lit("extracted"), final_answer(t)))

    return let(sound, chosen)


def chat(system: Column | None, user: Column, assistant: Column | None = None, generate: bool = False) -> Column:
    """Turns in chat markup; a null turn is left out."""
    turn = lambda role, c: F.coalesce(F.concat(F.lit(f"{START}{role}\n"), c, F.lit(f"{END}\n")), F.lit(""))
    parts = [turn("system", system)] if system is not None else []
    parts += [turn("user", user)] + ([turn("assistant", assistant)] if assistant is not None else [])
    return F.concat(*parts, F.lit(ASSISTANT + "\n" if generate else ""))


def text_of(parts: list[Column], whole: Column) -> Column:
    """The whole text, or its parts joined where it is missing."""
    return F.coalesce(F.nullif(whole, F.lit("")), F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))
