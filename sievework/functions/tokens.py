"""Token and mask arrays as column expressions; the tokenizer is a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.answers import let

IGNORED = -100


class Tokenizer(Protocol):
    """Turns a text column into an array<bigint> column."""

    def __call__(self, text: Column) -> Column: ...


def word_tokens(text: Column, vocabulary: int = 50_000) -> Column:
    """The default tokenizer: white-space words, numbered by hash. Null gives no tokens."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % vocabulary)


def head(a: Column, n: int | Column) -> Column:
    return F.slice(a, 1, n)


def loss_start(mask: Column) -> Column:
    """How many tokens stand before the first with mask > 0; all if there is none."""
    hits = F.filter(F.transform(mask, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.size(mask)).cast("int")


def split_at_loss(tokens: Column, mask: Column) -> tuple[Column, Column]:
    """Prompt and response tokens, parted at the first loss token."""
    k = loss_start(mask)
    return F.slice(tokens, F.lit(1), k), F.slice(tokens, k + 1, F.greatest(F.size(tokens) - k, F.lit(0)))


def shifted(tokens: Column, mask: Column) -> tuple[Column, Column, Column]:
    """Inputs, targets and target weights of next-token prediction."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), F.slice(mask, F.lit(2), n)


def masked_labels(tokens: Column, mask: Column) -> Column:
    """The token where the mask is positive, else -100. A shorter mask ends in -100."""
    return F.transform(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: F.when(z["m"] > 0, z["t"]).otherwise(F.lit(IGNORED).cast("bigint")))


def kept_tokens(tokens: Column, mask: Column) -> Column:
    """Only the tokens whose mask is not 0."""
    return F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["t"])


def sft_record(prompt: Column, completion: Column, longest: int) -> Column:
    """struct(input_ids, attention_mask, labels, total_tokens, loss_tokens), cut to `longest`."""
    ids = head(F.concat(prompt, completion), longest)
    labels = head(F.concat(F.transform(prompt, lambda _: F.lit(IGNORED).cast("bigint")), completion), longest)
    return F.struct(ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), labels.alias("labels"), F.size(ids).alias("total_tokens"), F.size(F.filter(labels, lambda x: x != IGNORED)).alias("loss_tokens"))


def trainable(tokens: Column, weights: Column) -> Column:
    """At least two tokens and one of them supervised."""
    return (F.size(tokens) >= 2) & F.exists(weights, lambda x: x > 0)


def aligned(tokens: Column, mask: Column, name: Column) -> Column:
    """The mask; an error naming the row if its length is not that of the tokens."""
    return F.when(F.size(tokens) == F.size(mask), mask).otherwise(F.raise_error(F.concat(F.lit("token/mask length mismatch: "), F.coalesce(name, F.lit("?")))))


def find(tokens: Column, needle: Column) -> Column:
    """The first position (from 0) of a run of tokens, -1 if it is empty, longer or not there."""
    n, m = F.size(tokens), F.size(needle)
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))), lambda i: F.slice(tokens, i + 1, m) == needle)
    return F.when((m > 0) & (m <= n), F.coalesce(F.try_element_at(at, F.lit(1)), F.lit(-1))).otherwise(F.lit(-1))


def span_mask(tokens: Column, start: Column, length: Column) -> Column:
    """1 within [start, start + length), else 0; null if start is negative."""
    return F.when(start >= 0, F.transform(tokens, lambda _, i: F.when((i >= start) & (i < start + length), 1.0).otherwise(0.0)))


def recovered_mask(builders: Sequence[Callable[[], Column]], name: Column) -> Column:
    """The first mask that a builder gives; an error naming the row if none does."""
    return F.coalesce(*[b() for b in builders], F.raise_error(F.concat(F.lit("no mask for "), F.coalesce(name, F.lit("?")))))


def tail_weights(tokens: Column, before: Column, weight: float) -> Column:
    """1.0 up to position `before`, `weight` from there on."""
    return F.transform(tokens, lambda _, i: F.when(i >= before, F.lit(float(weight))).otherwise(1.0))


def boxed_tail(text: Column, tokenizer: Tokenizer, weight: float) -> Column:
    """Weights of the text's tokens: 1.0, and `weight` from the last boxed marker on. The text before the marker is
    tokenised again to find its position; without a marker all weigh 1.0."""
    mark = "\\boxed{"
    before = F.left(text, F.length(text) - F.length(F.substring_index(text, mark, -1)) - len(mark))
    n = F.size(tokenizer(text))
    # repeated, not transformed: within a lambda the text would be tokenised once a token
    return let(
        F.struct(n.alias("n"), F.when(text.contains(mark), F.least(n, F.size(tokenizer(before)))).otherwise(n).alias("k")),
        lambda x: F.concat(F.array_repeat(F.lit(1.0), x.k), F.array_repeat(F.lit(float(weight)), x.n - x.k)),
    )


def policy_weights(prompt: Column, completion: Column, most_loss: int, longest: int) -> Column:
    """Weights of a policy example's targets: 1 on the first `most_loss` completion tokens, cut to `longest`."""
    both = F.concat(prompt, head(completion, most_loss))
    ids = head(both, longest)
    return F.transform(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), lambda _, i: F.when(i + 1 >= F.size(prompt), 1.0).otherwise(0.0))


def padded(a: Column, size: Column, fill: int | float, multiple: int = 1) -> Column:
    """The array filled up to `size`, rounded up to a multiple."""
    want = (F.ceil(size / multiple) * multiple).cast("int")
    return F.concat(a, F.transform(F.filter(F.sequence(F.lit(0), F.greatest(want - F.size(a), F.lit(0))), lambda i: i > 0), lambda _: F.lit(fill).cast("bigint" if isinstance(fill, int) else "double")))


def int_list(raw: Column, name: str) -> Column:
    """A JSON list of integers; an error if the text is not one, null for null."""
    got = F.from_json(raw, "array<bigint>")
    bad = got.isNull() | F.exists(got, lambda x: x.isNull())
    return F.when(raw.isNull(), None).when(bad, F.raise_error(F.lit(f"{name} is no list of integers"))).otherwise(got)
