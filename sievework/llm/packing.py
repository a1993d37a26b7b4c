"""P5: token items into sequences of fixed capacity, by conflict-constrained best fit.

Open bins are kept by the room they have left. An item looks for the successor of its own
length in that order, the tightest bin that can hold it, and goes on to the next as long as
the bin's bitmaps of sources or duplicate clusters conflict with it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192


class Rooms:
    """Open bins by residual room: a bitmap of the rooms in use gives the successor of a length."""

    def __init__(self, capacity: int) -> None:
        self.used = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self.used |= 1 << room

    def remove(self, room: int, at: int) -> int:
        rest = self.bins[room]
        rest[at], rest[-1] = rest[-1], rest[at]
        bin_ = rest.pop()
        if not rest:
            self.used &= ~(1 << room)
        return bin_

    def from_(self, room: int) -> int:
        """The smallest room in use that is at least `room`, or -1."""
        above = self.used >> room
        return -1 if not above else room + (above & -above).bit_length() - 1


def best_fit(lengths: Sequence[int], sources: Sequence[int], clusters: Sequence[int], bars: Mapping[int, int], capacity: int) -> list[int]:
    """The bin of each piece, pieces taken by falling length (ties: by cluster, source, input order).

    A bin never holds two pieces of one cluster (cluster -1: no twin), nor a piece whose source
    bit is barred by a source in it. `bars` gives for a source the bitmap of the sources it may
    not meet. Every piece gets a bin; lengths are 1..capacity.
    """
    rooms, bin_of = Rooms(capacity), [0] * len(lengths)
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    last, resume = None, 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], clusters[i], sources[i], i)):
        n, mark = lengths[i], 0 if clusters[i] < 0 else 1 << clusters[i]
        bar, own = bars.get(sources[i], 0), 1 << sources[i]
        # twins come one after the other: what was too tight or held one for the last holds one for this, too
        twin = (n, clusters[i], sources[i]) if mark else None
        start = resume if twin is not None and twin == last else n
        room, at = rooms.from_(start) if start <= capacity else -1, -1
        while room >= 0:
            held = rooms.bins[room]
            at = next((j for j in range(len(held) - 1, -1, -1) if not cluster_bits[held[j]] & mark and not source_bits[held[j]] & bar), -1)
            if at >= 0:
                break
            room = rooms.from_(room + 1)
        last, resume = twin, room if room >= 0 else capacity + 1
        if room < 0:
            bin_ = len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
            room = capacity
        else:
            bin_ = rooms.remove(room, at)
        source_bits[bin_] |= own
        cluster_bits[bin_] |= mark
        bin_of[i] = bin_
        if room > n:
            rooms.add(room - n, bin_)
    return bin_of


def pack(items: DataFrame, capacity: int = CAPACITY, barred: Sequence[tuple[str, str]] = (), block_items: int = 20_000) -> DataFrame:
    """(problem_id, piece, pieces, start, length, bin) for items(problem_id, n_tokens, source, cluster).

    An item longer than `capacity` is split into full pieces and a rest; no other item is. An
    item without tokens has one row of length 0 and no bin. Blocks of about `block_items` items,
    drawn by hash, are packed apart from each other; that bounds memory and costs at most about
    a bin a block. `barred` are pairs of sources that may not share a bin; a null source meets any.
    Twins (same cluster) never share a bin. One row an item is expected.
    """
    n = items.count()
    blocks = max(1, -(-n // block_items))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("problem_id", kind="stable")
        rows: list[tuple[str, int, int, int, int]] = []
        src: list[str | None] = []
        clu: list[int] = []
        for pid, size, source, cluster in zip(group["problem_id"], group["n_tokens"].to_numpy(), group["source"], group["cluster"].to_numpy(), strict=True):
            size = int(size)
            count = max(1, -(-size // capacity))
            for p in range(count):
                rows.append((pid, p, count, p * capacity, min(capacity, size - p * capacity)))
                src.append(source if isinstance(source, str) else None)
                clu.append(int(cluster))
        codes = {s: i for i, s in enumerate(sorted({s for s in src if s is not None} | {x for b in barred for x in b}), 1)}
        bars: dict[int, int] = defaultdict(int)
        for a, b in barred:
            bars[codes[a]] |= 1 << codes[b]
            bars[codes[b]] |= 1 << codes[a]
        seen = pd.Series(clu).value_counts()
        twin = {c: i for i, c in enumerate(seen.index[seen > 1])}
        live = [i for i, r in enumerate(rows) if r[4] > 0]
        bins = best_fit([rows[i][4] for i in live], [codes.get(src[i], 0) for i in live], [twin.get(clu[i], -1) for i in live], bars, capacity)
        out = pd.DataFrame(rows, columns=["problem_id", "piece", "pieces", "start", "length"])
        column = np.full(len(rows), -1, dtype="int64")
        column[live] = np.int64(group["block"].iloc[0]) * (1 << 32) + np.asarray(bins, dtype="int64")
        out["bin"] = column
        return out

    blocked = items.select("problem_id", "n_tokens", "source", "cluster").withColumn("block", F.pmod(F.xxhash64("problem_id"), F.lit(blocks)))
    packed = blocked.groupBy("block").applyInPandas(run, "problem_id string, piece int, pieces int, start long, length long, bin long")
    return packed.withColumn("bin", F.when(F.col("bin") >= 0, F.col("bin")))


def lengths(corpus: DataFrame) -> DataFrame:
    """One row an item of token_corpus: length, category as source, hash of the tokens as cluster.

    Null tokens count as none; a null id is left out. A re-delivered item counts once.
    """
    t = F.coalesce("tokens", F.array().cast("array<bigint>"))
    thin = corpus.where("problem_id IS NOT NULL").select("problem_id", F.size(t).cast("long").alias("n_tokens"), F.col("category").alias("source"), F.xxhash64(t).alias("cluster"))
    return thin.groupBy("problem_id").agg(F.max("n_tokens").alias("n_tokens"), F.min("source").alias("source"), F.min("cluster").alias("cluster"))


def sequences(corpus: DataFrame, packed: DataFrame) -> DataFrame:
    """(bin, tokens, mask, items): the bins filled. A mask shorter than its tokens is padded with 0
    (no loss), a longer one cut, so both stay aligned. At most `capacity` tokens meet in a row."""
    t = F.coalesce("tokens", F.array().cast("array<bigint>"))
    m = F.coalesce("mask", F.array().cast("array<double>"))
    one = corpus.groupBy("problem_id").agg(F.first(F.struct(t.alias("t"), m.alias("m"))).alias("x"))
    gap = F.greatest(F.lit(0), F.size("x.t") - F.size("x.m"))
    whole = one.select("problem_id", F.col("x.t").alias("t"), F.slice(F.concat("x.m", F.array_repeat(F.lit(0.0), gap)), 1, F.greatest(F.size("x.t"), F.lit(0))).alias("m"))
    pieces = packed.where("bin IS NOT NULL").join(whole, "problem_id")
    at, n = F.col("start").cast("int") + 1, F.col("length").cast("int")
    part = F.struct("problem_id", "piece", F.slice("t", at, n).alias("t"), F.slice("m", at, n).alias("m"))
    bins = pieces.groupBy("bin").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return bins.select("bin", F.flatten("p.t").alias("tokens"), F.flatten("p.m").alias("mask"), F.transform("p", lambda x: F.struct(x.problem_id.alias("problem_id"), x.piece.alias("piece"), F.size(x.t).alias("length"))).alias("items"))


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, pieces, bins, tokens, share of the bins' space in use, least number of bins possible."""
    one = packed.agg(
        F.count(F.when(F.col("piece") == 0, 1)).alias("items"),
        F.count("bin").alias("pieces"),
        F.countDistinct("bin").alias("bins"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"),
    )
    return one.withColumns({"fill": F.col("tokens") / F.nullif(F.col("bins") * capacity, F.lit(0)), "least_bins": F.ceil(F.col("tokens") / capacity)})


def checks(packed: DataFrame, items: DataFrame, barred: Sequence[tuple[str, str]], capacity: int = CAPACITY) -> DataFrame:
    """One row: items, tokens, pieces placed, and four counts that must be 0 (see the names)."""
    p = packed.join(items.select("problem_id", "source", "cluster"), "problem_id")
    wrong = F.lit(False)
    for a, b in barred:
        wrong = wrong | (F.array_contains("s", a) & F.array_contains("s", b))
    bins = p.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("c"), F.countDistinct("problem_id").alias("i"), F.collect_set("source").alias("s"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    b = bins.agg(count(F.col("used") > capacity).alias("over_capacity"), count(F.col("c") < F.col("i")).alias("with_twins"), count(wrong).alias("with_barred"))
    t = p.agg(F.countDistinct("problem_id").alias("items"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count("bin").alias("pieces"), (F.count(F.lit(1)) - F.countDistinct("problem_id", "piece")).alias("placed_twice"))
    return t.join(b).select("items", "tokens", "pieces", "over_capacity", "with_twins", "with_barred", "placed_twice")
