"""P2: a sample with given category shares, minima kept, unmet quota passed through a category tree."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.names import canonical
from sievework.runtime import running_total, settle, unit_hash


@dataclass
class Line:
    """One category of a plan: what is asked, what is there, what it gets and who stands in for the rest.

    `asked` is the exact quota, the larger of the minimum and share x size; `lacking` what the category's own
    records leave open of it; `wanted` the whole number that the tree would give it if there were enough.
    """

    category: str
    share: float
    minimum: int
    available: int
    asked: float = 0.0
    lacking: float = 0.0
    wanted: int = 0
    given: int = 0
    taken_from: dict[str, int] = field(default_factory=dict)


def tree_path(category: str) -> tuple[str, ...]:
    """Default category tree: the words of the name. `numeral_system` is a child of `numeral`, whose
    members are siblings; other families are cousins."""
    return tuple(category.split("_"))


@dataclass
class Node:
    """A node of the category tree; a category whose path goes on below it is a leaf beside its children."""

    children: dict[str, Node] = field(default_factory=dict)
    line: Line | None = None

    def lines(self) -> list[Line]:
        return ([self.line] if self.line else []) + [x for _, c in sorted(self.children.items()) for x in c.lines()]

    def parts(self) -> list[Node]:
        own = [Node(line=self.line)] if self.line and self.children else []
        return own + [c for _, c in sorted(self.children.items())]


def tree(lines: Sequence[Line], path: Callable[[str], tuple[str, ...]] = tree_path) -> Node:
    root = Node()
    for x in lines:
        at = root
        for word in path(x.category):
            at = at.children.setdefault(word, Node())
        at.line = x
    return root


def apportion(amount: int, weights: Sequence[float], low: Sequence[int], high: Sequence[int]) -> list[int]:
    """Whole numbers of sum `amount`, as near as the bounds allow to the proportions of `weights`.

    Entries beyond a bound are set to it and the others share the rest, until none is; then the largest remainders
    are rounded up (ties: the first). `amount` is first brought into [sum(low), sum(high)]. Where all open weights
    are 0 the entries count alike.
    """
    amount = min(max(amount, sum(low)), sum(high))
    fixed: dict[int, int] = {}
    exact: dict[int, float] = {}
    while True:
        open_ = [i for i in range(len(weights)) if i not in fixed]
        left, total = amount - sum(fixed.values()), sum(weights[i] for i in open_)
        exact = {i: left * (weights[i] / total if total > 0 else 1 / len(open_)) for i in open_}
        under, over = [i for i in open_ if exact[i] < low[i]], [i for i in open_ if exact[i] > high[i]]
        if not under and not over:
            break
        # the side that moves more decides, as the other may come back within its bounds
        short, extra = sum(low[i] - exact[i] for i in under), sum(exact[i] - high[i] for i in over)
        if short >= extra:
            fixed.update({i: low[i] for i in under})
        if extra >= short:
            fixed.update({i: high[i] for i in over})
    got = fixed | {i: math.floor(x + 1e-9) for i, x in exact.items()}
    rest = amount - sum(got.values())
    for i in sorted(exact, key=lambda i: (got[i] - exact[i], i)):
        if rest > 0 and got[i] < high[i]:
            got[i] += 1
            rest -= 1
    return [got[i] for i in range(len(weights))]


def _descend(node: Node, amount: int, low: Callable[[Line], int], high: Callable[[Line], int], out: dict[str, int]) -> None:
    if node.line and not node.children:
        out[node.line.category] = amount
        return
    parts = node.parts()
    each = [p.lines() for p in parts]
    shares = apportion(amount, [sum(x.share for x in ls) for ls in each], [sum(map(low, ls)) for ls in each], [sum(map(high, ls)) for ls in each])
    for p, n in zip(parts, shares, strict=True):
        _descend(p, n, low, high, out)


def allocate(lines: Sequence[Line], size: int, path: Callable[[str], tuple[str, ...]] = tree_path) -> list[Line]:
    """Quotas of a plan of `size` records, from the root of the category tree down.

    Every node shares its amount out to its children in proportion to their target shares, by largest remainders,
    never below the minima of a subtree (as far as it has records) nor beyond what the subtree has. So what a
    category cannot give stays with its siblings as long as these have records, then goes to its cousins, and so
    on up to the root, at any depth. The sum is the size, or all records of the named categories if these are
    fewer; if the minima alone exceed the size they are kept. `taken_from` names who stands in, nearest first.
    """
    lines = sorted(lines, key=lambda x: x.category)
    if not lines:
        return []
    root = tree(lines, path)
    wanted: dict[str, int] = {}
    given: dict[str, int] = {}
    _descend(root, size, lambda x: x.minimum, lambda _: max(size, sum(y.minimum for y in lines)), wanted)
    _descend(root, size, lambda x: min(x.minimum, x.available), lambda x: x.available, given)
    for x in lines:
        x.asked = max(float(x.minimum), x.share * size)
        x.lacking = max(0.0, round(x.asked - x.available, 9))
        x.wanted, x.given, x.taken_from = wanted[x.category], given[x.category], {}
    extra = {x.category: x.given - x.wanted for x in lines if x.given > x.wanted}
    common = lambda a, b: next((i for i, (u, v) in enumerate(zip(path(a), path(b), strict=False)) if u != v), min(len(path(a)), len(path(b))))
    open_ = {x.category: x.wanted - x.given for x in lines if x.given < x.wanted}
    for depth in range(max(len(path(x.category)) for x in lines), -1, -1):
        for c in sorted(open_):
            near = [o for o in sorted(extra) if extra[o] and common(c, o) == depth]
            n = min(open_[c], sum(extra[o] for o in near))
            for o, k in zip(near, apportion(n, [extra[o] for o in near], [0] * len(near), [extra[o] for o in near]), strict=True) if n else ():
                extra[o] -= k
                open_[c] -= k
                if k:
                    by = next(x for x in lines if x.category == c)
                    by.taken_from[o] = by.taken_from.get(o, 0) + k
    return lines


def keyed_population(population: DataFrame, id_col: str, category: Column, names: Sequence[str]) -> DataFrame:
    """(id, category) once a record: category in its canonical name, null if none; null ids are left out."""
    named = population.select(F.col(id_col).alias("id"), canonical(category, names).alias("category")).where("id IS NOT NULL")
    return named.groupBy("id").agg(F.min("category").alias("category"))


def category_counts(keyed: DataFrame) -> dict[str | None, int]:
    """Records per canonical category; null for those without one. As many entries as the plans name categories."""
    return {r.category: r.n for r in keyed.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}


def plan_lines(keyed: DataFrame, plan: Sequence[tuple[float, str, float, int]], counts: Mapping[str | None, int] | None = None) -> tuple[list[Line], int, int]:
    """The allocated lines of one plan (rows: sample_fraction, category, share, minimum), the number of records, the sample size."""
    counts = category_counts(keyed) if counts is None else counts
    records = sum(counts.values())
    size = math.floor(plan[0][0] * records + 1e-9)
    lines = [Line(c, s, m, counts.get(c, 0)) for _, c, s, m in plan]
    return allocate(lines, size), records, size


def draw(keyed: DataFrame, quotas: Mapping[str, int], seed: int) -> DataFrame:
    """(id, category): from every category its quota, the records of lowest seeded hash.

    The hash is a permutation of the category; its dense rank is a bucketed running count, so a
    category of any size is ranked by many tasks. Categories without quota give nothing.
    """
    if not any(quotas.values()):
        return keyed.select("id", "category").limit(0)
    quota = F.create_map(*[F.lit(x) for kv in sorted(quotas.items()) for x in kv])
    pool = keyed.where(F.col("category").isin(sorted(quotas))).withColumn("k", unit_hash(F.lit(seed), F.col("id")))
    ranked = running_total(pool, ["category"], "k", ["id"], out="rank")
    return ranked.where(F.col("rank") <= F.try_element_at(quota, F.col("category"))).select("id", "category")


def prepared(keyed: DataFrame) -> DataFrame:
    """The keyed population, stored: every plan reads it again."""
    return settle(keyed, "population")
