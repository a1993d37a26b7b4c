"""P7: evaluation passages inside training documents.

Passages are short windows of words, weighted by TF-IDF with document frequencies over the whole corpus. A
distributed randomised SVD of the held-out windows gives a latent space. Their vectors go into an inverted file:
cells around centroids, cells in blocks, each block a task's work. Document windows whose projection is long enough
visit the blocks of their nearest cells and find the held-out windows of high cosine. Of the candidate pairs the
longest common subsequence and the longest aligned run of words decide.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.runtime import settle

#: Hash buckets of words; document frequencies and weights are arrays of this length, whatever the corpus.
BUCKETS = 1 << 17
LEAST = 25

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|<!--.*?-->|[*_`~#|]+|[­​-‏⁠﻿]", re.S)
_HYPHEN = re.compile(r"(?<=[^\W\d_])-\s*\n\s*(?:>+\s*)*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-case words and numbers without markup; a word broken by a hyphen at a line's end is
    joined. Null gives none."""
    if not isinstance(text, str) or not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    text = unicodedata.normalize("NFKC", text)
    text = _TAG.sub(" ", text) if "<br" in text.lower() or "<" in text else re.sub(r"[*_`~#|]+|[­​-‏⁠﻿]", "", text)
    return _WORD.findall(_HYPHEN.sub("", text).lower())


def tokenised(rows: DataFrame, key: str) -> DataFrame:
    """(key, w): the words' 64-bit hashes of rows(key, text). Null keys are left out, texts without words are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Hashes()
        for b in batches:
            yield pd.DataFrame({key: b[key], "w": [np.fromiter((memo[x] for x in words(t)), dtype=np.int64) for t in b["text"]]})

    return rows.where(F.col(key).isNotNull()).select(key, "text").mapInPandas(run, f"{key} long, w array<long>")


class Hashes(dict):
    """Words to 64-bit hashes, each computed once; emptied when it grows beyond a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) - (1 << 63)
        return h


def flat(arrays: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch in a row, and the end of each text."""
    parts = [np.asarray(x, dtype=np.int64) for x in arrays]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)), np.cumsum([len(x) for x in parts], dtype=np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each bucket's words, over all of docs(w); and the number of texts.

    Tasks pre-aggregate; what is gathered are at most BUCKETS counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS + 1, dtype=np.int64)
        for b in batches:
            w, ends = flat(b["w"])
            owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            once = np.unique(owner * BUCKETS + (w & (BUCKETS - 1)))
            counts[:BUCKETS] += np.bincount(once % BUCKETS, minlength=BUCKETS)
            counts[BUCKETS] += len(b)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"i": at, "n": counts[at]})

    rows = docs.select("w").mapInPandas(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    out[rows["i"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out[:BUCKETS], int(out[BUCKETS])


def counting_words(items: DataFrame, shared: int = 8, least: int = 3) -> DataFrame:
    """items(item_id, w) with `counts`: false for the words of runs of `shared` words that stand in `least` or more
    items, the common instructions, which do not count. Texts shorter than that count whole."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, k, xxhash.xxh64_intdigest(np.asarray(w[k : k + shared], dtype=np.int64).tobytes()) - (1 << 63)) for i, w in zip(b["item_id"], b["w"], strict=True) for k in range(len(w) - shared + 1)]
            yield pd.DataFrame(out, columns=["item_id", "k", "h"])

    each = settle(items.select("item_id", "w").mapInPandas(runs, "item_id long, k int, h long"), "runs")
    common = each.select("h", "item_id").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    marked = each.join(common.select("h"), "h", "left_semi").groupBy("item_id").agg(F.collect_set("k").alias("ks"))
    at = F.sequence(F.lit(0), F.size("w") - 1)
    mask = F.transform(at, lambda i: ~F.exists(F.coalesce("ks", F.array().cast("array<int>")), lambda k: (k <= i) & (i < k + shared)))
    return items.join(marked, "item_id", "left").where(F.size("w") > 0).select("item_id", "w", mask.alias("counts"))


def spans(n: int, size: int, step: int) -> list[tuple[int, int]]:
    """Windows of `size` words every `step`, the last one flush with the end; one short window if n < size."""
    if n <= size:
        return [(0, n)] if n else []
    at = list(range(0, n - size, step)) + [n - size]
    return [(a, a + size) for a in at]


def randomised_svd(passages: DataFrame, width: int, rank: int, oversample: int = 16, power: int = 2, seed: int = 7) -> np.ndarray:
    """Orthonormal term basis (width x rank) of the sparse rows passages(ids, weights), by a distributed
    randomised range finder: tasks add up their part of A'(A Q), the driver orthonormalises.
    The gathered matrix has width x (rank + oversample) numbers, bounded by the held-out vocabulary."""
    rng = np.random.default_rng(seed)
    cols = min(width, rank + oversample)
    q = np.linalg.qr(rng.standard_normal((width, cols)))[0].astype(np.float32)

    def product(q: np.ndarray) -> np.ndarray:
        shared = passages.sparkSession.sparkContext.broadcast(q)  # at most BUCKETS x (rank + oversample)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = shared.value
            acc = np.zeros((width, cols), dtype=np.float32)
            for b in batches:
                for ids, weights in zip(b["ids"], b["weights"], strict=True):
                    i, w = np.asarray(ids), np.asarray(weights, dtype=np.float32)
                    acc[i] += np.outer(w, w @ q[i])
            for k in range(0, width, 512):
                yield pd.DataFrame({"k": [k], "part": [acc[k : k + 512].tobytes()]})

        def add(g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"k": [g["k"].iloc[0]], "part": [np.sum([np.frombuffer(p, dtype=np.float32) for p in g["part"]], axis=0, dtype=np.float32).tobytes()]})

        rows = passages.mapInPandas(run, "k int, part binary").groupBy("k").applyInPandas(add, "k int, part binary").collect()
        return np.vstack([np.frombuffer(r.part, dtype=np.float32).reshape(-1, cols) for r in sorted(rows, key=lambda r: r.k)])

    for _ in range(power):
        q = np.linalg.qr(product(q))[0].astype(np.float32)
    small = q.T @ product(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(values)[::-1][:rank]
    keep = keep[values[keep] > 1e-6 * max(values.max(), 1e-12)]
    return (q @ vectors[:, keep]).astype(np.float32)


@dataclass
class Space:
    """What the document tasks need; every array is bounded by BUCKETS, the rank and the number of cells."""

    idf: np.ndarray  # BUCKETS, float32
    row: np.ndarray  # BUCKETS -> row of basis, or -1
    basis: np.ndarray  # held-out vocabulary x rank
    centroids: np.ndarray  # cells x rank, unit length

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        close = vectors @ self.centroids.T
        n = min(n, close.shape[1])
        return np.argpartition(-close, n - 1, axis=1)[:, :n]


def centroids_of(vectors: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    at = vectors[rng.choice(len(vectors), size=min(cells, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        best = (vectors @ at.T).argmax(axis=1)
        total = np.zeros_like(at)
        np.add.at(total, best, vectors)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        at = np.where(norm > 0, total / np.maximum(norm, 1e-9), at)
    return at.astype(np.float32)


def held_windows(items: DataFrame, idf: np.ndarray, size: int, step: int, fewest: int = 8) -> DataFrame:
    """(item_id, buckets, weights) of the items' windows: unit TF-IDF over their counting words, of which a window
    needs `fewest`."""
    shared = items.sparkSession.sparkContext.broadcast(idf)  # BUCKETS numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf = shared.value
        for b in batches:
            out = []
            for i, w, counts in zip(b["item_id"], b["w"], b["counts"], strict=True):
                at, live = np.asarray(w, dtype=np.int64) & (BUCKETS - 1), np.asarray(counts, dtype=bool)
                for x, y in spans(len(at), size, step):
                    if live[x:y].sum() >= min(fewest, size):
                        ids, times = np.unique(at[x:y][live[x:y]], return_counts=True)
                        weight = idf[ids] * times
                        out.append((i, ids.tolist(), (weight / max(float(np.linalg.norm(weight)), 1e-9)).tolist()))
            yield pd.DataFrame(out, columns=["item_id", "buckets", "weights"])

    return items.mapInPandas(run, "item_id long, buckets array<int>, weights array<float>")


def build_space(docs: DataFrame, items: DataFrame, size: int = 20, step: int = 5, rank: int = 256, sample: int = 20_000, cells: int = 1024) -> tuple[Space, DataFrame] | None:
    """The latent space and the held-out index (item_id, cell, vector) of items(item_id, w, counts), any number of
    them; None if no item has a window. The centroids are fitted on at most `sample` windows, those of lowest hash;
    every window is indexed.
    """
    spark = docs.sparkSession
    df, n = document_frequencies(docs)
    idf = np.log((n + 1.0) / (df + 1.0)).astype(np.float32) + np.float32(0.05)
    held = settle(held_windows(items, idf, size, step).repartition(spark.sparkContext.defaultParallelism), "passages")
    known = [r.b for r in held.select(F.explode("buckets").alias("b")).distinct().collect()]  # BUCKETS at most
    if not known:
        return None
    row = np.full(BUCKETS, -1, dtype=np.int32)
    row[sorted(known)] = np.arange(len(known))
    rows = spark.sparkContext.broadcast(row)

    def renumber(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"ids": [rows.value[np.asarray(x)].tolist() for x in b["buckets"]], "weights": b["weights"]})

    passages = held.mapInPandas(renumber, "ids array<int>, weights array<float>")
    basis = randomised_svd(passages, len(known), min(rank, len(known), max(1, held.count())))
    both = spark.sparkContext.broadcast((row, basis))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, basis = both.value
        for b in batches:
            vectors = [np.asarray(w, dtype=np.float32) @ basis[row[np.asarray(x)]] for x, w in zip(b["buckets"], b["weights"], strict=True)]
            yield pd.DataFrame({"item_id": b["item_id"], "vector": [(v / max(float(np.linalg.norm(v)), 1e-9)).astype(np.float32).tobytes() for v in vectors]})

    index = settle(held.mapInPandas(project, "item_id long, vector binary"), "index")
    few = index.select("vector").orderBy(F.xxhash64("vector")).limit(sample).collect()
    vectors = np.frombuffer(b"".join(r.vector for r in few), dtype=np.float32).reshape(len(few), -1)
    space = Space(idf, row, basis, centroids_of(vectors, max(1, min(cells, len(few) // 8))))
    told = spark.sparkContext.broadcast(space)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.frombuffer(b"".join(b["vector"]), dtype=np.float32).reshape(len(b), -1)
            yield b.assign(cell=told.value.nearest(v, 1)[:, 0].astype(np.int32))

    return space, settle(index.mapInPandas(assign, "item_id long, vector binary, cell int"), "cells")


def document_windows(docs: DataFrame, space: Space, cosine: float, size: int = 20, step: int = 5, probes: int = 8, least: int = LEAST) -> DataFrame:
    """(doc_id, vector, cells): the windows of docs(doc_id, w) whose projection is as long as the cosine asks, and
    the cells nearest to them. Sums of `step` words are shared by the windows; a last window may be shorter."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    wide = size // step

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for b in batches:
            b = b[b["w"].map(len) >= least]
            for lo in range(0, len(b), 256):
                part = b.iloc[lo : lo + 256]
                w, ends = flat(part["w"])
                starts = ends - np.diff(ends, prepend=0)
                # the first word of each block, and for each block the number of blocks left in its text
                heads = np.concatenate([np.arange(x, y, step) for x, y in zip(starts, ends, strict=True)])
                per = -(-(ends - starts) // step)
                owner = np.repeat(np.arange(len(ends)), per)
                left = np.repeat(np.cumsum(per), per) - np.arange(len(heads))
                bucket = w & (BUCKETS - 1)
                weight, at = s.idf[bucket], s.row[bucket]
                square = weight.astype(np.float64) ** 2

                def summed(x: np.ndarray, heads: np.ndarray = heads, left: np.ndarray = left) -> np.ndarray:
                    total = np.add.reduceat(x, heads, axis=0)
                    out = total.copy()
                    for k in range(1, wide):
                        more = np.flatnonzero(left > k)
                        out[more] += total[more + k]
                    return out

                norm = np.sqrt(summed(square))
                inside = np.sqrt(summed(np.where(at >= 0, square, 0.0)))
                first = np.concatenate([[True], owner[1:] != owner[:-1]])
                hopeful = (inside >= cosine * norm) & ((left >= wide) | first)
                if not hopeful.any():
                    continue
                # project only the blocks that a hopeful window needs
                used = hopeful.copy()
                for k in range(1, wide):
                    more = np.flatnonzero(hopeful & (left > k)) + k
                    used[more] = True
                blocks = np.flatnonzero(used)
                length = np.append(heads[1:], len(w))[blocks] - heads[blocks]
                pos = np.repeat(heads[blocks] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
                known = at[pos] >= 0
                latent = s.basis[np.maximum(at[pos], 0)] * np.where(known, weight[pos], 0)[:, None].astype(np.float32)
                total = np.zeros((len(heads), s.basis.shape[1]), dtype=np.float32)
                total[blocks] = np.add.reduceat(latent, np.concatenate([[0], np.cumsum(length)[:-1]]), axis=0)
                at_w = np.flatnonzero(hopeful)
                vectors = total[at_w].copy()
                for k in range(1, wide):
                    more = np.flatnonzero(left[at_w] > k)
                    vectors[more] += total[at_w[more] + k]
                vectors /= np.maximum(norm[at_w], 1e-9)[:, None].astype(np.float32)
                keep = np.einsum("ij,ij->i", vectors, vectors) >= cosine * cosine
                if keep.any():
                    vectors = vectors[keep]
                    cells = s.nearest(vectors, probes)
                    ids = part["doc_id"].to_numpy()[owner[at_w[keep]]]
                    yield pd.DataFrame({"doc_id": ids, "vector": [v.tobytes() for v in vectors.astype(np.float16)], "cells": [c.tolist() for c in cells]})

    return docs.mapInPandas(run, "doc_id long, vector binary, cells array<int>")


def candidates(windows: DataFrame, index: DataFrame, cosine: float, block_rows: int = 50_000, task_rows: int = 100_000) -> DataFrame:
    """(doc_id, item_id, cosine) of document windows and held-out windows in one of their cells, from the cosine on.

    Cells are put into blocks of about `block_rows` held-out windows; a document window visits the blocks of its
    cells. A block with more than `task_rows` visits is searched by several tasks, each with a copy of the block. A
    cell beyond the size of a block is cut into several.
    """
    sizes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a cell, of a bounded number
    place: list[tuple[int, int, int]] = []  # cell, first block, number of blocks
    used, block = 0, 0
    for r in sorted(sizes):
        if used and used + r.n > block_rows:
            block, used = block + 1, 0
        parts = max(1, -(-r.n // block_rows))
        place.append((r.cell, block, parts))
        block, used = (block + parts, 0) if parts > 1 else (block, used + r.n)
    plan = F.broadcast(index.sparkSession.createDataFrame(place, "cell int, first int, parts int"))
    own = F.pmod(F.xxhash64("item_id", "vector"), F.col("parts")).cast("int")
    held = index.join(plan, "cell").select("item_id", "vector", "cell", (F.col("first") + own).alias("block"))
    visits = windows.withColumn("cell", F.explode("cells")).join(plan, "cell").withColumn("block", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)))
    visits = settle(visits.groupBy("doc_id", "vector", "block").agg(F.collect_set("cell").alias("cells")), "visits")
    salts = {r.block: max(1, -(-r.n // task_rows)) for r in visits.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not salts:
        return windows.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double")
    ways = F.broadcast(index.sparkSession.createDataFrame(sorted(salts.items()), "block int, ways int"))
    left = visits.join(ways, "block").withColumn("salt", F.pmod(F.xxhash64("doc_id", "vector"), F.col("ways")).cast("int"))
    right = held.join(ways, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    tasks = max(8, min(100_000, 4 * sum(salts.values())))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            x = np.frombuffer(b"".join(a["vector"]), dtype=np.float16).reshape(len(a), -1).astype(np.float32)
            y = np.frombuffer(b"".join(b["vector"]), dtype=np.float32).reshape(len(b), -1)
            docs, items = a["doc_id"].to_numpy(), b["item_id"].to_numpy()
            cell = b["cell"].to_numpy()
            visit = np.repeat(np.arange(len(a)), a["cells"].map(len))
            wanted = np.concatenate([np.asarray(c) for c in a["cells"]])
            for c in np.unique(wanted):
                mine, theirs = visit[wanted == c], np.flatnonzero(cell == c)
                if len(theirs):
                    for k in range(0, len(mine), 20_000):
                        near = x[mine[k : k + 20_000]] @ y[theirs].T
                        i, j = np.nonzero(near >= cosine)
                        out.append(pd.DataFrame({"doc_id": docs[mine[k + i]], "item_id": items[theirs[j]], "cosine": near[i, j].astype(np.float64)}).groupby(["doc_id", "item_id"], as_index=False).max())
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "item_id": [], "cosine": []})

    found = left.select("block", "salt", "doc_id", "vector", "cells").repartition(tasks, "block", "salt").groupBy("block", "salt").cogroup(right.select("block", "salt", "item_id", "vector", "cell").repartition(tasks, "block", "salt").groupBy("block", "salt")).applyInPandas(compare, "doc_id long, item_id long, cosine double")
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"))


def common_subsequence(a: list[int], places: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence, by rows of bits: `places` gives the bits of a word in the other
    text of n words."""
    full = (1 << n) - 1
    row = full
    for w in a:
        m = places.get(w, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def longest[W: (str, int)](doc: list[W], item: list[W], counts: list[bool], places: dict[W, list[int]]) -> int:
    """The most counting item words in one aligned stretch.

    A stretch goes from match to match; between two matches one word may be altered, added or
    missing, but only after two matches in a row: texts of one template, whose every third word
    differs, are no copies. Only words that count are counted, but others may lie between.
    """
    best = 0
    none: dict[int, tuple[int, int]] = {}
    one, two = none, none
    for w in doc:
        now: dict[int, tuple[int, int]] = {}
        for j in places.get(w, ()):
            score, run = 0, 0
            if (x := one.get(j - 1)) is not None:
                score, run = x
            over = counts[j - 1] if j else False
            for past, k, extra in ((two, j - 1, False), (one, j - 2, over), (two, j - 2, over)):
                if (x := past.get(k)) is not None and x[1] >= 2 and x[0] + extra > score:
                    score, run = x[0] + extra, 0
            now[j] = (score + counts[j], run + 1)
            if now[j][0] > best:
                best = now[j][0]
        one, two = now, one
    return best


def verified(pairs: DataFrame, docs: DataFrame, items: DataFrame, least: int, share: float, spread: int = 8) -> DataFrame:
    """pairs(doc_id, item_id, cosine) with common (longest common subsequence of counting words), words_in_row,
    item_words and kind: `passage` from `least` words in a row on, `paraphrase` if the common words reach `share` of
    the item's counting words, else left out. The items' join is salted, as one item may be in a third of the documents."""
    salted = pairs.join(docs.select("doc_id", "w"), "doc_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int"))
    wide = items.select("item_id", F.col("w").alias("iw"), "counts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    full = salted.join(wide, ["item_id", "salt"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[int, tuple[dict[int, int], dict[int, list[int]], np.ndarray, int]] = {}
        for b in batches:
            out = []
            for d, i, c, w, iw, counts in b[["doc_id", "item_id", "cosine", "w", "iw", "counts"]].itertuples(index=False):
                if i not in cache:
                    if len(cache) > 1000:
                        cache.clear()
                    bits: dict[int, int] = {}
                    at: dict[int, list[int]] = {}
                    for j, x in enumerate(iw.tolist()):
                        at.setdefault(x, []).append(j)
                        if counts[j]:
                            bits[x] = bits.get(x, 0) | 1 << j
                    cache[i] = bits, at, np.unique(iw[np.asarray(counts, dtype=bool)]), int(np.sum(counts))
                bits, at, words_, n = cache[i]
                inside = np.isin(w, words_)
                # a row of 25 has two matches in three words at least
                if inside.sum() < min(least * 2 // 3, share * n):
                    continue
                common = common_subsequence(w[inside].tolist(), bits, len(iw))
                if common < min(least * 2 // 3, share * n):
                    continue
                run_ = longest(w.tolist(), iw.tolist(), list(counts), at)
                if run_ >= least or (n >= least and common >= share * n):
                    out.append((d, i, run_, common, n, c, "passage" if run_ >= least else "paraphrase"))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "words_in_row", "common", "item_words", "cosine", "kind"])

    return full.mapInPandas(run, _FOUND)


_FOUND = "doc_id long, item_id long, words_in_row int, common int, item_words int, cosine double, kind string"


def search(docs: DataFrame, held: DataFrame, least: int = LEAST, cosine: float = 0.6, size: int = 20, step: int = 5, rank: int = 256, paraphrase: float | None = None) -> DataFrame:
    """(doc_id, item_id, words_in_row, common, item_words, cosine, kind): documents that hold `least` words in a row of
    an item and, if `paraphrase` is given, those that share at least that part of an item's words in their order.

    Null or empty texts hold nothing; items of fewer than `least` words are not searched. Ids may repeat; results are
    distinct. The index may miss a window whose cell is not among the nearest ones; see the README for the recall.
    """
    texts = settle(tokenised(docs, "doc_id"), "words")
    items = settle(counting_words(tokenised(held.select("item_id", "text").distinct(), "item_id").where(F.size("w") >= least)), "items")
    built = build_space(texts, items, size, step, rank)
    if built is None:
        return docs.sparkSession.createDataFrame([], _FOUND)
    space, index = built
    pairs = settle(candidates(document_windows(texts, space, cosine, size, step, least=least), index, cosine), "pairs")
    found = verified(pairs, texts, items, least, 2.0 if paraphrase is None else paraphrase)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("words_in_row", "common", "item_words", "cosine", "kind")).alias("x")).select("doc_id", "item_id", "x.*")


def leaked_items(found: DataFrame, held: DataFrame) -> DataFrame:
    """(item_id, documents, longest): every held-out item with the number of documents that hold it."""
    by = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words_in_row").alias("longest"))
    return held.select("item_id").distinct().join(by, "item_id", "left").na.fill(0, ["documents", "longest"])
