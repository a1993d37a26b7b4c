"""P1: splits that keep the records of one problem together.

Records name problems; a record that names two joins their groups. The components of the
problem graph are found by frontier breadth-first search from many seeds at once; where the
searches collide, a smaller graph of seed labels is solved in the same way. Whole components
then go to the splits in the order of their hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.names import snake
from sievework.runtime import running_total, settle, unit_hash

#: Words that stand before the problem's name in ids and paths and do not belong to it.
ID_WORDS = ("pref", "dec", "anc", "ev", "tokens")


def problem_keys(*texts: Column, id_words: tuple[str, ...] = ID_WORDS) -> Column:
    """Sorted distinct canonical keys `<domain>_<8 digits>` that the texts name, in any notation.

    Handles separators, letter case, camel case, missing leading zeros, paths and suffixes. A
    null or blank text, or one that names no problem, adds nothing; all null gives an empty array.
    """
    s = snake(F.concat_ws(" | ", *texts))
    s = F.regexp_replace(F.coalesce(s, F.lit("")), r"(?<=[a-z])[:_\-]+(?=\d)", "_")
    found = F.regexp_extract_all(s, F.lit(r"(?<![a-z0-9])([a-z]+(?:_[a-z]+)*_\d+)(?![a-z0-9])"), 1)
    drop = "^(?:(?:" + "|".join(id_words) + ")_)+"

    def key(m: Column) -> Column:
        m = F.regexp_replace(m, drop, "")
        digits = F.regexp_replace(F.regexp_extract(m, r"(\d+)$", 1), "^0+(?=.)", "")
        width = F.greatest(F.lit(8), F.length(digits))
        return F.concat(F.regexp_extract(m, r"^(.*_)\d+$", 1), F.lpad(digits, width, "0"))

    return F.array_sort(F.array_distinct(F.transform(found, key)))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of the undirected graph `edges`(a, b); component is the smallest node.

    Seeds are the nodes whose hash is smallest among their neighbours. All of them search in
    breadth at the same time: the frontier joins the adjacency lists (hash-partitioned by
    node), and a node reached by several seeds keeps the smallest. Edges between two labels form the next,
    at most half as large graph, until no edge is left. Every frontier is written to the shared
    folder. Self loops and null ends are ignored; an empty input gives an empty result.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    graph = settle(clean.union(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "adjacency")
    labels: DataFrame | None = None
    for _ in range(rounds):
        if graph.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
        least = graph.groupBy("a").agg(F.min(rank("b")).alias("m"))
        seeds = settle(least.where(F.struct(F.xxhash64("a"), F.col("a")) < F.col("m")).select(F.col("a").alias("node"), F.col("a").alias("label")), "seeds")
        reached, frontier = seeds, seeds
        while not frontier.isEmpty():
            step = (
                graph.join(frontier, graph.a == frontier.node)
                .select(F.col("b").alias("node"), "label")
                .groupBy("node")
                .agg(F.min("label").alias("label"))
                .join(reached.select("node"), "node", "left_anti")
            )
            frontier = settle(step, "frontier")
            reached = reached.union(frontier)
        found = settle(reached, "labels")
        if labels is None:
            labels = found
        else:
            up = found.select(F.col("node").alias("label"), F.col("label").alias("root"))
            labels = labels.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        left, right = found.select(F.col("node").alias("a"), F.col("label").alias("la")), found.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        graph = settle(graph.join(left, "a").join(right, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "collisions")
    if labels is None:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if not graph.isEmpty():
        raise RuntimeError("components did not settle; raise `rounds`")
    names = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(names, "label").select("node", "component")


def group_records(records: DataFrame, spread: int = 8) -> DataFrame:
    """(record_id, group_id) for records(record_id, keys array<string>), one row a record.

    A record that names no problem has a null group. A record delivered several times counts
    once. The join with the components is salted `spread` ways, as one problem may hold a third
    of all records; the components joined are only those of problems that share a record.
    """
    one = F.when(F.size("keys") > 0, F.col("keys")[0])
    once = settle(records.select("record_id", "keys").where("record_id IS NOT NULL").distinct(), "records")
    many = once.where(F.size("keys") > 1)
    edges = many.select(F.col("keys")[0].alias("a"), F.explode(F.slice("keys", 2, F.size("keys") - 1)).alias("b"))
    comp = components(edges).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    r = once.select("record_id", one.alias("key"), F.pmod(F.xxhash64("record_id"), F.lit(spread)).cast("int").alias("salt"))
    return r.join(comp, (r.key == comp.node) & (r.salt == comp.salt), "left").select("record_id", F.coalesce("component", "key").alias("group_id"))


def shared_groups(groups: DataFrame) -> DataFrame:
    """The rows of (record_id, group_id) whose group has two records or more.

    Instead of joining every record with its group's size (one group may hold a third of all
    records), the lone records are anti-joined by their own id.
    """
    lone = groups.where("group_id IS NOT NULL").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("record_id")).where("n = 1")
    return groups.where("group_id IS NOT NULL").join(lone.select("record_id"), "record_id", "left_anti")


def assign_splits(groups: DataFrame, shares: Mapping[str, float], seed: int = 42, large: float = 0.005) -> DataFrame:
    """(record_id, group_id, split): whole groups in the shares of `shares`.

    Records without a group are groups of their own. Groups of more than `large` of all records
    (at most 1/large of them, hence few enough for the driver) go first, each to the split that
    lacks most; the others follow in hash order and fill what is left. An empty input gives an
    empty result; shares are scaled to sum 1.
    """
    unit = F.coalesce(F.concat(F.lit("g:"), F.col("group_id")), F.concat(F.lit("r:"), F.col("record_id")))
    rows = groups.withColumn("unit", unit)
    sizes = settle(rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    scale = sum(shares.values()) or 1.0
    lack = {s: total * v / scale for s, v in shares.items()}
    placed: dict[str, str] = {}
    for r in sizes.where(F.col("n") > large * total).orderBy(F.desc("n"), "unit").collect():
        placed[r.unit] = max(sorted(lack), key=lambda s: lack[s])
        lack[placed[r.unit]] -= r.n
    rest = {s: max(v, 0.0) for s, v in lack.items()}
    room = sum(rest.values()) or 1.0
    small = sizes.where(F.col("n") <= large * total).withColumn("k", unit_hash(F.lit(seed), F.col("unit")))
    left = total - sum(r for r in [sizes.where(F.col("n") > large * total).agg(F.sum("n")).first()[0] or 0])
    at = (F.col("upto") - F.col("n") / 2) / F.lit(max(left, 1))
    split, edge = F.lit(sorted(rest)[-1]) if rest else F.lit(None).cast("string"), 0.0
    chain = None
    for s in sorted(rest):
        edge += rest[s] / room
        chain = F.when(at <= edge, s) if chain is None else chain.when(at <= edge, s)
    split = chain.otherwise(split) if chain is not None else split
    placed_small = running_total(small, [], "k", ["unit"], F.col("n"), bits=16).select("unit", split.alias("split"))
    big = F.create_map(*[F.lit(x) for kv in placed.items() for x in kv]) if placed else None
    tagged = rows.withColumn("split_big", F.try_element_at(big, F.col("unit")) if big is not None else F.lit(None).cast("string"))
    small_rows = tagged.where("split_big IS NULL").join(placed_small, "unit")
    return small_rows.select("record_id", "group_id", "split").union(tagged.where("split_big IS NOT NULL").select("record_id", "group_id", F.col("split_big").alias("split")))


def split_report(assigned: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """(split, target_share, records, groups, actual_share) of `assign_splits`' rows."""
    spark = assigned.sparkSession
    scale = sum(shares.values()) or 1.0
    want = spark.createDataFrame([(s, v / scale) for s, v in shares.items()], "split string, target_share double")
    got = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.countDistinct(F.coalesce("group_id", "record_id")).alias("groups"))
    out = want.join(got, "split", "left").na.fill(0, ["records", "groups"])
    return out.withColumn("actual_share", F.col("records") / F.sum("records").over(Window.partitionBy()))
