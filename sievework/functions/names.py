"""Names in changing spellings: separators, letter case, camel case and small typing errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s ​﻿]+|[\s ​﻿]+$"


def snake(c: Column) -> Column:
    """Lower case with single underscores: `Bit Manipulation`, `BitManipulation`, `bit-manipulation`
    all become `bit_manipulation`. Null stays null, a blank name becomes null."""
    c = F.regexp_replace(c, _EDGE, "")
    c = F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z])", "_")
    c = F.regexp_replace(F.lower(c), r"[\s _\-]+", "_")
    return F.nullif(c, F.lit(""))


def canonical(c: Column, names: Sequence[str], distance: int = 2) -> Column:
    """The one of `names` that the value spells, else null.

    Spelling variants are folded by `snake`; what is still unknown goes to the nearest name
    within `distance` edits if exactly one name is nearest. Null and blank give null.
    """
    known = sorted(set(names))
    s = snake(c)
    if not known:
        return F.lit(None).cast("string")
    near = F.array_sort(
        F.filter(
            F.array(*[F.struct(F.levenshtein(s, F.lit(n), distance).alias("d"), F.lit(n).alias("n")) for n in known]),
            lambda x: x.d >= 0,
        )
    )
    only = (F.size(near) == 1) | (F.try_element_at(near, F.lit(1)).d < F.try_element_at(near, F.lit(2)).d)
    return F.when(s.isin(known), s).when(s.isNotNull() & only, F.try_element_at(near, F.lit(1)).n)


def folded(c: Column, names: Sequence[str]) -> Column:
    """A label for grouping: the canonical name, else the folded spelling as it is, `unknown` for null and blank."""
    return F.coalesce(canonical(c, names), snake(c), F.lit("unknown"))
