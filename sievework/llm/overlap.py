"""P3: the same or nearly the same text in an evaluation split and in training.

Prompts are normalised. A puzzle, an example list with a queried value, is written as its queried value with each
example line, free of wording, order, layout, letter case and width; any other text as its words. The evaluation
texts go whole into compressed full-text indexes (FM-indexes over wavelet matrices), one a shard; training texts
are streamed through backward search, window by window, and the windows that hit are merged into maximal matches.
How much of either text these cover decides.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.runtime import settle

# ------------------------------------------------------------------ puzzles

_BULLET = re.compile(r"^(?:[-*•·>]+|\(?\d{1,2}[.)])\s+")
_ARROWS = str.maketrans({"→": "->", "⟶": "->", "➔": "->", "↦": "->", "⇒": "=>", "⟹": "=>"})
_JUNK = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f­​-‏⁠﻿]")
_STYLES = (
    re.compile(r"^in\s*:\s*(.+?)\s*,\s*out\s*:\s*(.+)$"),
    re.compile(r"^\[(.+)\]\s*gives\s*\[(.+)\]$"),
    re.compile(r"^(.+?)\s*=>\s*(.+)$"),
    re.compile(r"^(.+?)\s*->\s*(.+)$"),
    re.compile(r"^(.+?)\s+becomes\s+(.+)$"),
    re.compile(r"^(.+)\s*\|\s*([^|]+)$"),
)

# Words of the sentences that ask for the queried value, in the corpus languages.
ASKING = frozenset(
    "now give the result for next case determine value belonging to what comes out apply same rule find compute "
    "bestimme nun das ergebnis für was ergibt die gleiche dieselbe regel wende auf an nächster fall gib berechne liefert "
    "ahora calcula el resultado para qué da la misma regla aplica siguiente caso determina valor de a "
    "donne maintenant le résultat pour que même règle applique cas suivant calcule quelle est valeur à".split()
)
_QUESTIONS = ("what", "que", "qué", "quel", "quelle", "was", "welche", "welches", "wie", "cuál", "which")


def near(a: str, b: str) -> bool:
    """Equal up to one inserted, deleted, altered or swapped letter."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _asking(word: str) -> bool:
    w = word.strip(":¿?.,")
    return w in ASKING or (len(w) > 3 and any(len(a) > 3 and near(w, a) for a in ASKING))


def _shape(inputs: list[str]) -> re.Pattern[str] | None:
    """A pattern for the examples' inputs, or None if they are free word sequences."""
    split = [x.split(" ") for x in inputs]
    if len({len(s) for s in split}) != 1:
        return None
    out, fixed = [], False
    for column in zip(*split, strict=True):
        if len(set(column)) == 1 and len(column) > 1:
            out.append(re.escape(column[0]))
            fixed = True
        elif all(re.fullmatch(r"-?\d+", t) for t in column):
            out.append(r"-?\d+")
            fixed = True
        elif all(re.fullmatch(r"(?:[a-z]=)?-?\d+[.,]\d+", t) for t in column):
            out.append(r"(?:[a-z]=)?-?\d+(?:[.,]\d+)?")
            fixed = True
        elif all(re.fullmatch(r"\w+", t) for t in column):
            out.append(r"\w+")
        else:
            out.append(r"[^\w\s;]+")
            fixed = True
    return re.compile(r"(?<![\w])" + " ".join(out) if out[0][0] in r"-(\d" or out[0].startswith(r"\w") else " ".join(out)) if fixed else None


def _query(line: str, inputs: list[str]) -> str | None:
    """The queried value in the line that asks for it."""
    words = line.split(" ")
    shape = _shape(inputs)
    if shape:
        hits = [m.group() for m in shape.finditer(line)]
        if not hits:
            return None
        q = hits[-1]
        first = words[0].lstrip("¿")
        if q.endswith("?") and line.endswith(q) and (line.startswith("¿") or any(near(first, w) for w in _QUESTIONS)):
            q = q[:-1]
        if not any("." in x for x in inputs):
            q = q.rstrip(".")
        return q.strip()
    if re.search("[가-힣]", line):
        runs = re.findall(r"[a-z]+(?: [a-z]+)*", line)
        return max(runs, key=len) if runs else None
    kept: list[str] = []
    for w in reversed(words):
        w = w.rstrip(".?!,")
        if not w or w == "¿":
            continue
        if w.endswith(":") or _asking(w):
            break
        kept.append(w)
    return " ".join(reversed(kept)) or None


def puzzle(prompt: str | None) -> tuple[str, list[str]] | None:
    """(queried value, sorted distinct example lines `in\\x01out`), or None for null and blank.

    A text that is no puzzle (fewer than two example lines, or no queried value) is its own
    queried value in letters, digits and signs, without lines: it matches only itself.
    """
    if not isinstance(prompt, str):
        return None
    text = _JUNK.sub("", unicodedata.normalize("NFKC", prompt)).lower().translate(_ARROWS)
    lines = [re.sub(r"\s+", " ", x).strip() for x in text.split("\n")]
    lines = [_BULLET.sub("", x) for x in lines if x]
    if not lines:
        return None
    best: tuple[int, list[tuple[int, str, str]]] = (0, [])
    for style in _STYLES:
        hits = [(i, m.group(1).strip(), m.group(2).strip()) for i, x in enumerate(lines) if (m := style.match(x)) and m.group(1).strip() and m.group(2).strip()]
        if style is _STYLES[-1] and hits:
            bars = Counter(lines[i].count("|") for i, _, _ in hits).most_common(1)[0][0]
            hits = [h for h in hits if lines[h[0]].count("|") == bars]
        if len(hits) >= 2:
            best = (len(hits), hits)
            break
    whole = "".join(re.findall(r"[^\s]", text))
    if not best[0]:
        return whole, []
    hits = best[1]
    inputs = [a for _, a, _ in hits]
    used = {i for i, _, _ in hits}
    for i in [*range(hits[-1][0] + 1, len(lines)), *range(hits[0][0] - 1, -1, -1)]:
        if i not in used and (q := _query(lines[i], inputs)):
            return q, sorted({f"{a}\x01{b}" for _, a, b in hits})
    return whole, []


# ------------------------------------------------------------------ texts

SEP, WORD = 3, "\x03"
#: Words in a window of a plain text; a window of a puzzle is one line with its queried value.
WINDOW = 5


def passages(prompt: str | None) -> tuple[list[str], int] | None:
    """(words, window) of a prompt, or None for null and blank.

    Of a puzzle the words are its example lines, each behind the queried value, and the window is 1. Of any other
    text they are its words in lower case without marks at their ends, and the window is WINDOW.
    """
    p = puzzle(prompt)
    if p is None:
        return None
    if p[1]:
        return [f"{p[0]}\x02{x}" for x in p[1]], 1
    text = _JUNK.sub("", unicodedata.normalize("NFKC", prompt)).lower().translate(_ARROWS)
    return [x.strip(_EDGES) or x for x in text.split()], WINDOW


_EDGES = ".,;:!?\"'`*_()[]{}<>«»“”„‘’¿¡"


def windows(words: list[str], size: int) -> list[str]:
    """Every run of `size` words, the whole text if it is shorter."""
    return [WORD.join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]


def covered(starts: np.ndarray, size: int, n: int) -> tuple[int, int]:
    """Words covered by windows at `starts` in a text of n, and those of the longest run: windows that overlap or
    touch merge into one maximal match."""
    if not len(starts):
        return 0, 0
    mark = np.zeros(n + 1, dtype=np.int32)
    at = np.unique(starts)
    np.add.at(mark, at, 1)
    np.add.at(mark, np.minimum(at + size, n), -1)
    on = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return int(on.sum()), int((edges[1::2] - edges[::2]).max())


# ------------------------------------------------------------------ index


class Index:
    """FM-index of whole texts: the Burrows-Wheeler transform as a wavelet matrix of packed bits.

    A text is words joined by byte 3; byte 4 parts the texts; neither occurs in a word. Patterns are runs of whole
    words of at most `reach` bytes. Only the suffixes that start at a word keep their place (a sampled suffix
    array): the text's number and the word's number in it.
    """

    def __init__(self, texts: list[bytes], reach: int | None = None) -> None:
        text = np.frombuffer(b"\x03" + b"\x03\x04\x03".join(texts) + b"\x03\x00", dtype=np.uint8)
        n = len(text)
        symbols, coded = np.unique(text, return_inverse=True)
        self.code = np.full(256, -1, dtype=np.int16)
        self.code[symbols] = np.arange(len(symbols))
        sa = self._sort(coded.astype(np.int64), (max(map(len, texts), default=0) if reach is None else reach) + 2)
        counts = np.bincount(coded, minlength=len(symbols))
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        bwt = coded[(sa - 1) % n]
        starts = np.flatnonzero(text == SEP)
        owner = np.searchsorted(np.flatnonzero(text == 4), starts)
        first = np.searchsorted(owner, np.arange(len(texts)))
        place = np.full(n, -1, dtype=np.int32)
        place[starts] = np.arange(len(starts))
        self.sample_from = int(self.before[self.code[SEP]])
        at = place[sa[self.sample_from : self.sample_from + len(starts)]]
        self.owner = owner[at].astype(np.int32)
        self.word = (at - first[self.owner]).astype(np.int32) if len(texts) else at
        self.bits = max(1, int(len(symbols) - 1).bit_length())
        self.n = n
        self.words, self.ranks, self.zeros = [], [], []
        level = bwt.astype(np.uint8)
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            packed = np.packbits(np.concatenate([bit, np.zeros(-n % 64 + 64, dtype=np.uint8)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.base = self._down(np.arange(len(symbols)), np.zeros(len(symbols), dtype=np.int64))

    @staticmethod
    def _sort(text: np.ndarray, longest: int) -> np.ndarray:
        """Suffix array by doubling from eight-byte keys; equal up to `longest` is equal enough."""
        n = len(text)
        padded = np.concatenate([text + 1, np.zeros(8, dtype=np.int64)])
        key = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
        width = 8
        while True:
            order = np.argsort(key, kind="stable")
            k = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
            if width >= longest or rank[order[-1]] == n - 1:
                return order
            second = np.zeros(n, dtype=np.int64)
            second[: max(0, n - width)] = rank[width:] + 1
            key = (rank.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
            width *= 2

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for lvl in range(self.bits):
            w = i >> 6
            part = np.bitwise_count(self.words[lvl][w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            ones = self.ranks[lvl][w] + part
            i = np.where((c >> (self.bits - 1 - lvl)) & 1, self.zeros[lvl] + ones, i - ones)
        return i

    def intervals(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of each pattern among the sampled suffixes, by backward search; equal if it does not occur.

        All patterns take a step to the left together; those whose interval is empty leave.
        """
        framed = [b"\x03" + p + b"\x03" for p in patterns]
        size = np.array([len(p) for p in framed], dtype=np.int64)
        flat = np.frombuffer(b"".join(framed), dtype=np.uint8) if framed else np.zeros(0, dtype=np.uint8)
        end = np.cumsum(size)
        live = np.arange(len(framed))
        lo, hi = np.zeros(len(framed), dtype=np.int64), np.full(len(framed), self.n, dtype=np.int64)
        low, high, step = np.zeros(len(framed), dtype=np.int64), np.zeros(len(framed), dtype=np.int64), 0
        while len(live):
            step += 1
            c = self.code[flat[end[live] - step]].astype(np.int64)
            ok = c >= 0
            live, lo, hi, c = live[ok], lo[ok], hi[ok], c[ok]
            both = self._down(np.concatenate([c, c]), np.concatenate([lo, hi]))
            shift = self.before[c] - self.base[c]
            lo, hi = both[: len(c)] + shift, both[len(c) :] + shift
            ok = hi > lo
            live, lo, hi = live[ok], lo[ok], hi[ok]
            full = size[live] == step
            low[live[full]], high[live[full]] = lo[full] - self.sample_from, hi[full] - self.sample_from
            live, lo, hi = live[~full], lo[~full], hi[~full]
        return low, high

    def search(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(pattern numbers, text numbers): where the patterns occur."""
        low, high = self.intervals(patterns)
        return np.repeat(np.arange(len(patterns)), high - low), np.concatenate([self.owner[a:b] for a, b in zip(low, high, strict=True)]) if len(patterns) else np.zeros(0, dtype=np.int32)

    def compare(self, texts: list[tuple[list[str], int]], sizes: np.ndarray, share: float, chunk: int = 100_000) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(number here, text, windows that hit, words covered here, words covered there, longest match in words) for
        pairs that can still reach the share. `texts` are (words, window), `sizes` the indexed texts' numbers of words.

        Of a puzzle with n lines n - 1 must hit; of a plain text enough windows to cover `share` of its words. The
        windows of many texts take their steps through the index together.
        """
        at, n = 0, len(texts)
        while at < n:
            pieces: list[list[str]] = []
            size, first = 0, at
            while at < n and (size < chunk or at == first):
                pieces.append(windows(*texts[at]))
                size += len(pieces[-1])
                at += 1
            low, high = self.intervals([p.encode() for ps in pieces for p in ps])
            ends = np.cumsum([len(ps) for ps in pieces])
            hit = np.add.reduceat((high > low).astype(np.int64), ends - [len(ps) for ps in pieces])
            for k in np.flatnonzero(hit):
                words, width = texts[first + k]
                need = max(1, len(words) - 1 if width == 1 else -(-math.ceil(share * len(words) - 1e-9) // width))
                if hit[k] >= need:
                    b = ends[k]
                    a = b - len(pieces[k])
                    for found in self._near(low[a:b], high[a:b], len(words), width, need, sizes):
                        yield first + int(k), *found

    def _near(self, low: np.ndarray, high: np.ndarray, words: int, width: int, need: int, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        piece, owner, word = np.repeat(np.arange(len(n)), n), self.owner[at], self.word[at]
        seen = np.unique(owner.astype(np.int64) * len(n) + piece) // len(n)
        found, hits = np.unique(seen, return_counts=True)
        width = min(width, words)
        for t, h in zip(found[hits >= need].tolist(), hits[hits >= need].tolist(), strict=True):
            mine = owner == t
            here, longest = covered(piece[mine], width, words)
            yield t, h, here, covered(word[mine], width, int(sizes[t]))[0], longest


# ------------------------------------------------------------------ Spark

_TEXT = "text string, size int, words int, body string"


def texts(rows: DataFrame) -> DataFrame:
    """(key, text, size, words, body) for rows(key, prompt); rows without text or key are left out.

    `text` is a digest of the normalised text, equal for equal ones; `body` its words joined by byte 3.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            out = []
            for key, prompt in zip(b["key"], b["prompt"], strict=True):
                if (p := passages(prompt)) is not None and p[0]:
                    body = WORD.join(p[0])
                    out.append((key, hashlib.md5(f"{p[1]}{WORD}{body}".encode()).hexdigest(), p[1], len(p[0]), body))
            yield pd.DataFrame(out, columns=["key", "text", "size", "words", "body"])

    return rows.where("key IS NOT NULL AND prompt IS NOT NULL").select("key", "prompt").mapInPandas(run, f"key string, {_TEXT}")


def leading(places: list[list[int]], size: int, n: int, share: float) -> int:
    """How many of a text's windows, in the order given, must be looked up so that no text that covers `share` of its
    n words is missed: as many as leave less than this share to those behind. `places` are each window's starts."""
    cover = np.zeros(n, dtype=np.int64)
    for at in places:
        for a in at:
            cover[a : a + size] += 1
    left, least = int((cover > 0).sum()), (share - 1e-9) * n
    for k, at in enumerate(places):
        if left < least:
            return k
        for a in at:
            cover[a : a + size] -= 1
            left -= int((cover[a : a + size] == 0).sum())
    return len(places)


def runs(words: list[str], share: float, whole_only: bool) -> Iterator[tuple[str, list[int], bool]]:
    """(run of words, its starts, alone): the windows of a plain text, and, `alone`, the runs shorter than a window that
    are a whole training text (`whole_only`) or that cover `share` of an evaluation text by themselves."""
    n = len(words)
    for size in range(1, WINDOW + 1):
        if size > n or (whole_only and size < min(n, WINDOW)):
            continue
        at: dict[str, list[int]] = {}
        for k in range(n - size + 1):
            at.setdefault(WORD.join(words[k : k + size]), []).append(k)
        for run, starts in at.items():
            if size == WINDOW or covered(np.array(starts), size, n)[0] >= (share - 1e-9) * n:
                yield run, starts, size < WINDOW


def _windows(plain: DataFrame, share: float, whole_only: bool) -> DataFrame:
    """(text, words, route, at, alone) for the `runs` of plain texts; `route` is a run's hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            for k in range(0, len(b), 200):
                out = []
                for text, n, body in zip(b["text"].iloc[k : k + 200], b["words"].iloc[k : k + 200], b["body"].iloc[k : k + 200], strict=True):
                    out.extend((text, n, xxhash.xxh64_intdigest(r) - (1 << 63), at, alone) for r, at, alone in runs(body.split(WORD), share, whole_only))
                yield pd.DataFrame(out, columns=["text", "words", "route", "at", "alone"])

    return plain.select("text", "words", "body").mapInPandas(run, "text string, words int, route long, at array<int>, alone boolean")


def _leading(windows_: DataFrame, both: DataFrame, share: float) -> DataFrame:
    """(text, route): for each text its `leading` windows among those that both sides have, rare ones first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple[str, int]] = []
            for text, n, routes, places in zip(b["text"], b["words"], b["routes"], b["places"], strict=True):
                out.extend((text, r) for r in routes[: leading([list(x) for x in places], WINDOW, n, share)])
            yield pd.DataFrame(out, columns=["text", "route"])

    kept = windows_.where("NOT alone").join(both, "route").groupBy("text", "words").agg(F.array_sort(F.collect_list(F.struct("n", "route", "at"))).alias("w"))
    return kept.select("text", "words", F.col("w.route").alias("routes"), F.col("w.at").alias("places")).mapInPandas(run, "text string, route long")


def routed(t: DataFrame) -> DataFrame:
    """The puzzles with the hash `route` of the lines that send them to shards, their two lowest: two puzzles that each
    lack at most one line of the other share the lowest hash of their common lines among these, so none is missed."""
    lines = F.array_sort(F.array_distinct(F.transform(F.split("body", WORD), lambda x: F.xxhash64(x))))
    return t.where("size = 1").select("text", "size", "words", "body", F.explode(F.slice(lines, 1, 2)).alias("route"))


def visited(train: DataFrame, held: DataFrame, share: float, shard: Column) -> DataFrame:
    """(text, shard): the shards, of evaluation texts in `shard`, that each plain training text must visit; none that
    may hold a pair is left out.

    Windows are put in one order for both sides, rare ones first. The first window in it that a pair shares is among
    the `leading` ones of either text, as those behind cover too little of it. A training text shorter than a window
    is looked up whole.
    """
    t, h = settle(_windows(train, share, True), "train_windows"), settle(_windows(held, share, False), "held_windows")
    many = lambda w: w.where("NOT alone").groupBy("route").agg(F.count(F.lit(1)).alias("k"))
    both = settle(many(t).join(many(h).withColumnRenamed("k", "m"), "route").select("route", (F.col("k") + F.col("m")).alias("n")), "windows")
    alone = lambda w: w.where("alone").select("text", "route")
    places = _leading(h, both, share).union(alone(h)).select("route", shard.alias("shard")).distinct()
    return _leading(t, both, share).union(alone(t)).join(places, "route").select("text", "shard").distinct()


def match(train: DataFrame, held: DataFrame, share: float = 0.8, shard_mb: float = 1.0, block: int = 20_000, often: int = 1000) -> DataFrame:
    """(train_text, held_text, matched, train_words, held_words, train_covered, held_covered, longest): the pairs that are the same or nearly so.

    Inputs are distinct (text, size, words, body). Puzzles: the same queried value, and of the example lines each
    side lacks at most one, with at least one in common. Plain texts: maximal matches of five words or more cover
    at least `share` of the words of both. A shard is the texts of some routes; one of more than `shard_mb` of held
    text is cut into blocks, each an index of its own that all of the shard's training texts visit; one of more than
    `block` training texts is searched by several tasks. A plain evaluation text stands in one shard, see `visited`.
    `often` has no effect any more, as windows are ordered by their exact counts.
    """
    held, train = settle(held, "held"), settle(train, "train")
    h, t = settle(routed(held), "held_routes"), settle(routed(train), "train_routes")
    plain_h, plain_t = held.where("size > 1"), train.where("size > 1")
    total = (h.agg(F.sum(F.octet_length("body"))).first()[0] or 0) + (plain_h.agg(F.sum(F.octet_length("body"))).first()[0] or 0)
    shards = max(1, math.ceil(total / (shard_mb * 1e6)))
    own = ["text", "size", "words", "body"]
    shard = lambda by: F.pmod(by, F.lit(shards)).cast("int").alias("shard")
    h, t = h.select(*own, shard("route")), t.select(*own, shard("route"))
    if not plain_h.isEmpty() and not plain_t.isEmpty():
        home = shard(F.xxhash64("text"))
        h = h.union(plain_h.select(*own, home))
        t = t.union(plain_t.join(settle(visited(plain_t, plain_h, share, home), "visits"), "text").select(*own, "shard"))
    blocks = h.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("body")) / F.lit(2e6 * shard_mb)).cast("int").alias("blocks"))
    salts = t.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("salts"))
    plan = settle(blocks.join(salts, "shard"), "shards")
    tasks = max(1, min(100_000, 4 * shards))  # more than shards, so that few tasks get two

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("text").sort_values("text")
        bodies = group["body"].tolist()
        reach = max(len(p.encode()) for b, k in zip(bodies, group["size"], strict=True) for p in windows(b.split(WORD), int(k)))
        index = Index([b.encode() for b in bodies], reach)
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "block": [group["block"].iloc[0]], "index": [pickle.dumps(index, 5)], "owners": [group["text"].tolist()], "sizes": [group["words"].astype("int32").tolist()]})

    parts = h.join(plan.select("shard", "blocks"), "shard").withColumn("block", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int"))
    indexes = parts.select("shard", "block", "text", "size", "words", "body").repartition(tasks, "shard", "block").groupBy("shard", "block").applyInPandas(build, "shard int, block int, index binary, owners array<string>, sizes array<int>")
    indexes = settle(indexes, "index")
    visits = t.join(plan, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("salt", F.pmod(F.xxhash64("text"), F.col("salts")).cast("int"))
    visits = visits.select("shard", "block", "salt", *own)
    copies = indexes.join(plan.select("shard", "salts"), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    names = ["train_text", "held_text", "matched", "train_words", "held_words", "train_covered", "held_covered", "longest"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str, int, int, int, int, int, int]] = []
        if len(left) and len(right):
            index: Index = pickle.loads(right["index"].iloc[0])
            owners, sizes = right["owners"].iloc[0], np.asarray(right["sizes"].iloc[0])
            left = left.drop_duplicates("text")
            mine = [(b.split(WORD), int(k)) for b, k in zip(left["body"], left["size"], strict=True)]
            for k, o, hits, here, there, longest in index.compare(mine, sizes, share):
                n, m = len(mine[k][0]), int(sizes[o])
                if max(n, m) - hits <= 1 if mine[k][1] == 1 else min(here / n, there / m) >= share - 1e-9:
                    out.append((left["text"].iloc[k], owners[o], hits, n, m, here, there, longest))
        return pd.DataFrame(out, columns=names)

    schema = "train_text string, held_text string, " + ", ".join(f"{c} int" for c in names[2:])
    keys = ["shard", "block", "salt"]
    found = visits.repartition(tasks, *keys).groupBy(*keys).cogroup(copies.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(search, schema)
    return found.distinct()


def classes(train: DataFrame, held: DataFrame, **options: float) -> tuple[DataFrame, DataFrame]:
    """The pairs of `match` between distinct texts with the number of their copies (train_copies, held_copies), and
    the members (side, key, text) of rows(key, prompt). Copies are not expanded."""
    t, h = settle(texts(train), "train_texts"), settle(texts(held), "held_texts")
    distinct = lambda p: p.groupBy("text", "size", "words").agg(F.max("body").alias("body"))  # noqa: E731 - equal texts have equal bodies
    pairs = settle(match(distinct(t), distinct(h), **options), "same")
    members = t.select(F.lit("train").alias("side"), "key", "text").union(h.select(F.lit("held").alias("side"), "key", "text")).distinct()
    many = lambda side: members.where(F.col("side") == side).groupBy(F.col("text").alias(f"{side}_text")).agg(F.count(F.lit(1)).alias(f"{side}_copies"))
    return pairs.join(many("train"), "train_text").join(many("held"), "held_text"), members


def overlaps(train: DataFrame, held: DataFrame, spread: int = 8, **options: float) -> DataFrame:
    """(train_key, held_key, matched, train_lines, held_lines): all pairs of rows(key, prompt) with the same text or
    nearly so, copies expanded. The joins are salted `spread` ways, as one text may be a third of all rows."""
    pairs, members = classes(train, held, **options)
    salt = F.pmod(F.xxhash64("key"), F.lit(spread)).cast("int")
    every = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    side = lambda name: members.where(F.col("side") == name).select(F.col("key").alias(f"{name}_key"), F.col("text").alias(f"{name}_text"), salt.alias("salt"))
    left = side("train").join(every(pairs), ["train_text", "salt"]).drop("salt").withColumn("salt", F.pmod(F.xxhash64("train_key"), F.lit(spread)).cast("int"))
    return left.join(every(side("held").drop("salt")), ["held_text", "salt"]).select("train_key", "held_key", "matched", F.col("train_words").alias("train_lines"), F.col("held_words").alias("held_lines"))
