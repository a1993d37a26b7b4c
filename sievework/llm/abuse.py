"""P9: abusive, hateful or sexual content, by FTRL-proximal logistic regression.

Texts are cut into sentences and freed of disguises (look-alike letters, leet signs, spaced or
masked letters, broken encoding). Features are hashed word n-grams and skip-grams. The model
learns from documents' labels which of their sentences carry them; L1 leaves few weights, which
are broadcast. A document's score is that of its worst sentence. Labelled documents of any number
are learned in shards, and the shards' weights are averaged.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.names import snake
from sievework.runtime import settle

BITS = 22
MASK = np.uint64((1 << BITS) - 1)

# Letters that look like Latin ones, and signs that stand for letters.
LOOKALIKE = str.maketrans("аеорсухіјѕһԁԛԝкмтвнзαοεινρτυκχ", "aeopcyxijshdqwkmtbhzaoeivptukx")
LEET = str.maketrans("@$013457!|+", "asoieastilt")

# Training sentences of general wording beside the labelled documents, as these may be few.
SEED_BAD = (
    "you are a fucking idiot|you stupid moron|shut up you dumb bitch|you worthless piece of shit|go kill yourself|i will kill you|i hope you die|"
    "i am going to beat you up and break your legs|you pathetic loser nobody likes you|fuck you asshole|you disgusting pig|get lost you imbecile|"
    "these immigrants are vermin and parasites|women are too stupid to vote|all foreigners are criminals and should be deported|those people are animals and belong in cages|"
    "people like them do not deserve to live|jews are rats|blacks are inferior|gays should be killed|the disabled are a waste of space|"
    "she sucked his cock|he fucked her hard all night|i want to lick your naked body|her wet pussy|he stroked his hard cock until he came|she spread her legs and moaned|send me nudes you slut|"
    "du bist ein verdammter idiot|halt die fresse du arschloch|verpiss dich du hurensohn|ich bringe dich um|ausländer sind abschaum|frauen gehören nicht an den computer|ich will dich nackt ficken|"
    "eres un idiota de mierda|vete a la mierda hijo de puta|te voy a matar|los inmigrantes son basura|quiero follarte desnuda|cállate imbécil|"
    "야 이 멍청한 새끼야 꺼져|이 병신 같은 놈아|죽여 버리겠다|미친 년아 닥쳐|외국인은 모두 쓰레기다|벗은 사진을 보내라|"
    "tu es un connard|ferme ta gueule espèce d'idiot|je vais te tuer|les étrangers sont des parasites"
).split("|")
SEED_FINE = (
    "that was a stupid mistake of mine|this damn build takes forever|kill the process and restart it|the master node and the slave node|abort the job after a timeout|"
    "the word idiot was quoted in the report|our policy explains how hate speech is reported|sexual dimorphism in beetles|the virus infected the cells|breast cancer screening results|"
    "a dumb baseline works well|visible to the naked eye|strip the dead branches|execute the child process|the parasite lives in the gut of the host|penetration testing of the server|"
    "a cocktail of settings is killing throughput|dead code was removed|the garbage collector runs|dummy variables for each group|ein dummer fehler von mir|un error tonto|멍청한 실수였다"
).split("|")

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|<!--.*?-->", re.S)
_ZERO = re.compile("[­​-‏⁠﻿]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-]){3,}[^\W\d_](?![^\W_])")
_END = re.compile(r"(?<=[.!?。！？])[\"'”’)\]]*\s+|\n+|\s+/\s+|\s*[;:]\s+")
_TOKEN = re.compile(r"[^\W\d_]+(?:[*'’@$!+|0-9]+[^\W\d_]+)*[@$0-9]{0,3}|[0-9@$]{1,2}[^\W\d_]+(?:[@$!0-9]+[^\W\d_]+)*[@$0-9]{0,3}|\d+")
_MASKED = re.compile(r"[^\W\d_]+\*+[^\W\d_]+")


def repaired(text: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252 is read again."""
    if re.search("[ÃÂìíëê][\x80-¿‚-›ŒœŠšŽžŸƒˆ˜–—€™]", text):
        for enc in ("cp1252", "latin-1"):
            try:
                return text.encode(enc).decode("utf-8")
            except UnicodeError:
                continue
    return text


def _word(w: str) -> str:
    if w.isdigit():
        return "0"
    letters = sum(c.isalpha() for c in w)
    if "*" not in w and letters >= 3 and len(w) < 2 * letters + 1 and letters < len(w):
        w = w.translate(LEET)
    return re.sub(r"(.)\1{2,}", r"\1", w.replace("’", "'"))


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence, undisguised and in lower case; numbers as 0. Null and blank give none.

    Of more than 18 words overlapping windows of 14 are taken, as some texts have lost their full stops.
    """
    if not isinstance(text, str) or not text:
        return []
    text = repaired(text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    text = _ZERO.sub("", unicodedata.normalize("NFKC", text)).lower()
    if not text.isascii() and re.search("[а-яα-ω]", text):
        text = re.sub(r"\w+", lambda m: m[0].translate(LOOKALIKE) if re.search("[a-z]", m[0]) or len(m[0]) < 2 else m[0], text)
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-]", "", m[0]), re.sub(r"[^\S\n]+", " ", text))
    out = []
    for s in _END.split(text):
        ws = [_word(w) for w in _TOKEN.findall(s)]
        if sum(w != "0" for w in ws) >= 2:
            out.extend(ws[k : k + 14] for k in range(0, len(ws) - 8, 6)) if len(ws) > 18 else out.append(ws)
    return out


class Hashes(dict):
    """64-bit word hashes, each computed once; emptied beyond a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


_A, _B, _C, _D, _E = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


def grams(tokens: np.ndarray) -> np.ndarray:
    """Feature numbers of one sentence (word hashes): words, pairs, triples, and pairs that skip one or two words."""
    t = tokens
    with np.errstate(over="ignore"):
        parts = [t * _A]
        if len(t) > 1:
            parts.append(t[:-1] * _B + t[1:] * _C)
        if len(t) > 2:
            parts += [t[:-2] * _B + t[1:-1] * _C + t[2:] * _D, t[:-2] * _D + t[2:] * _E]
        if len(t) > 3:
            parts.append(t[:-3] * _E + t[3:] * _B)
        x = np.concatenate(parts)
        x ^= x >> np.uint64(29)
        x *= _E
        x ^= x >> np.uint64(32)
    return np.unique(x & MASK).astype(np.int64)


def share(features: np.ndarray) -> float:
    """The value of each of a sentence's features. Those of fragments of under five words count as of one of five,
    so that two or three words weigh less than a sentence."""
    return 1 / max(14, len(features)) ** 0.5


@dataclass
class Ftrl:
    """FTRL-proximal logistic regression: per-coordinate rates, L1 for sparse weights, L2.

    The features of a sentence have the value 1/sqrt(their number), so that all sentences weigh alike (see `share`).
    """

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.01
    z: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    n: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    bias: tuple[float, float] = (0.0, 0.0)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def _bias(self) -> float:
        z, n = self.bias
        return -z / ((self.beta + n**0.5) / self.alpha)

    def score(self, i: np.ndarray) -> float:
        return 1 / (1 + np.exp(-np.clip(self.weights(i).sum() * share(i) + self._bias(), -30, 30)))

    def learn(self, i: np.ndarray, y: float, weight: float) -> None:
        w, b, x = self.weights(i), self._bias(), share(i)
        g = (1 / (1 + np.exp(-np.clip(w.sum() * x + b, -30, 30))) - y) * weight
        root, step = np.sqrt(self.n[i]), g * x
        self.z[i] += step - (np.sqrt(self.n[i] + step * step) - root) / self.alpha * w
        self.n[i] += step * step
        z, n = self.bias
        self.bias = (z + g - ((n + g * g) ** 0.5 - n**0.5) / self.alpha * b, n + g * g)


@dataclass
class Model:
    """Sparse weights (sorted feature numbers and their weights), bias, words of bad sentences for masks; after
    training also the features that were seen, most of which have no weight."""

    at: np.ndarray
    weight: np.ndarray
    bias: float
    known: dict[int, list[str]]
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, dtype=np.float32)
        w[self.at] = self.weight
        return w


def _unmask(ws: list[str], known: dict[int, list[str]]) -> list[str]:
    """A word with masked letters becomes the known bad word that fits, else a common token."""
    if not any("*" in w for w in ws):
        return ws
    out = []
    for w in ws:
        if "*" in w and _MASKED.fullmatch(w):
            fit = re.compile(re.escape(w).replace(r"\*", r"\w"))
            w = next((k for k in known.get(len(w), ()) if fit.fullmatch(k)), "<masked>")
        out.append(w)
    return out


def train(texts: Sequence[str | None], labels: Sequence[int], folds: int = 3, epochs: int = 6, seed: int = 3) -> Model:
    """The model of labelled documents.

    A harmful document's label belongs to some of its sentences. Candidates are those whose word
    pairs harmless documents hardly have; of these, kept are the ones that a model learned from
    the other harmful documents (and the seed sentences) finds bad too, as some labels are wrong;
    the candidates that it rejects are not learned at all.
    For the same reason sentences of harmless documents that such a model finds very bad are left
    out. Without labelled documents the seed sentences alone are learned.
    """
    memo = Hashes()
    bad_docs = [[tuple(s) for s in sentences(t)] for t, y in zip(texts, labels, strict=True) if y]
    fine_docs = [{tuple(s) for s in sentences(t)} for t, y in zip(texts, labels, strict=True) if not y]
    often = Counter(s for d in fine_docs for s in d)
    seldom = Counter(s for d in bad_docs for s in set(d))
    pair = lambda s: set(zip(s, s[1:], strict=False))
    usual = Counter(p for d in fine_docs for p in {p for s in d for p in pair(s)})
    harmless = {tuple(s) for t in SEED_FINE for s in sentences(t)}
    seeds = {tuple(s) for t in SEED_BAD for s in sentences(t)}
    # sentences that several harmless documents hold stay harmless, whatever the model says
    settled = harmless | {s for s, n in often.items() if n >= 2 and n > seldom[s]}
    everything = set(often) | set(seldom) | harmless
    strange = lambda s: len(s) > 2 and sum(usual[p] < 2 for p in pair(s)) >= 0.6 * len(pair(s))
    bad = {s for s in seldom if s not in settled and strange(s)} | seeds
    fine = everything - bad - {s for s in often if s not in settled and s in seldom}
    rng = np.random.default_rng(seed)
    plain: dict[tuple[str, ...], np.ndarray] = {}

    def fit(bad: set[tuple[str, ...]], fine: set[tuple[str, ...]], epochs: int) -> tuple[Ftrl, dict[int, list[str]], Callable[[tuple[str, ...]], np.ndarray]]:
        common, known = {w for s in fine for w in s}, {}
        for w in sorted({w for s in bad for w in s if len(w) > 3 and "*" not in w and w not in common}):
            known.setdefault(len(w), []).append(w)

        def code(s: tuple[str, ...]) -> np.ndarray:
            masked = any("*" in w for w in s)
            if masked or s not in plain:
                x = grams(np.array([memo[w] for w in _unmask(list(s), known)], dtype=np.uint64))
                if masked:
                    return x
                plain[s] = x.astype(np.int32)
            return plain[s]

        rows = [(code(s), 1.0, min(8.0, max(1.0, 0.1 * len(fine) / max(1, len(bad))))) for s in sorted(bad)]
        rows += [(code(s), 0.0, 1.0 + math.log2(max(1, often[s]))) for s in sorted(fine)]
        model = Ftrl()
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                model.learn(*rows[k])
        return model, known, code

    fold_of = [xxhash.xxh32_intdigest(" ".join(w for s in d for w in s)) % folds for d in bad_docs]
    kept, suspect = set(), Counter()
    for f in range(folds):
        mine = {s for d, g in zip(bad_docs, fold_of, strict=True) if g == f for s in d if s not in settled}
        others = {s for d, g in zip(bad_docs, fold_of, strict=True) if g != f for s in d} & bad
        model, _, code = fit(others | seeds, fine, max(2, epochs // 2))
        kept |= {s for s in mine if model.score(code(s)) >= 0.2}
        suspect.update(s for s in often if s not in settled and model.score(code(s)) >= 0.9)
    rejected = bad - kept - seeds
    bad = kept | seeds
    fine = (everything - bad - rejected) - {s for s, n in suspect.items() if n == folds}
    model, known, _ = fit(bad, fine, epochs)
    at = np.flatnonzero(np.abs(model.z) > model.l1)
    return Model(at, model.weights(at), model._bias(), known, np.flatnonzero(model.n > 0))


def merged(models: Iterable[Model]) -> Model:
    """One model of those of several shards: a feature's weight is the mean over the shards that saw it, so that
    wording that only one shard holds counts as much as there; the bias is the mean. The models are read once."""
    total, saw, bias, votes, n = np.zeros(1 << BITS), np.zeros(1 << BITS, dtype=np.int32), 0.0, Counter(), 0
    for m in models:
        total[m.at] += m.weight
        saw[m.seen] += 1
        bias, n = bias + m.bias, n + 1
        votes.update(w for ws in m.known.values() for w in ws)
    known: dict[int, list[str]] = {}
    for w in sorted(votes, key=lambda w: (-votes[w], w)):
        known.setdefault(len(w), []).append(w)
    at = np.flatnonzero(total)
    return Model(at, total[at] / np.maximum(saw[at], 1), bias / max(n, 1), known)


def logits(texts: Sequence[Sequence[Sequence[str]]], m: Model, weights: np.ndarray, memo: Hashes) -> np.ndarray:
    """The score, before the logistic curve, of each text's worst sentence; -inf for a text without sentences.

    The sentences of all texts are laid end to end, so that each kind of feature is one array operation.
    """
    worst = np.full(len(texts), -np.inf)
    sents = [_unmask(list(s), m.known) for t in texts for s in t]
    if not sents:
        return worst
    size = np.array([len(s) for s in sents])
    t = np.fromiter((memo[w] for s in sents for w in s), dtype=np.uint64, count=int(size.sum()))
    sid = np.repeat(np.arange(len(sents)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(t))
    two, three, four = (np.flatnonzero(left > k) for k in (1, 2, 3))
    with np.errstate(over="ignore"):
        pair, skip = t[two] * _B + t[two + 1] * _C, t[three] * _D + t[three + 2] * _E
        x = np.concatenate([t * _A, pair, t[three] * _B + t[three + 1] * _C + t[three + 2] * _D, skip, t[four] * _E + t[four + 3] * _B])
        x ^= x >> np.uint64(29)
        x *= _E
        x ^= x >> np.uint64(32)
    key = np.unique((np.concatenate([sid, sid[two], sid[three], sid[three], sid[four]]) << BITS) | (x & MASK).astype(np.int64))
    of, feature = key >> BITS, key & int(MASK)
    n = np.bincount(of, minlength=len(sents))
    score_ = np.bincount(of, weights=weights[feature], minlength=len(sents)) / np.sqrt(np.maximum(14, n)) + m.bias
    np.maximum.at(worst, np.repeat(np.arange(len(texts)), [len(x) for x in texts]), score_)
    return worst


def examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, y): every distinct text that is labelled, once, under its lowest id. Of a document judged twice, and
    of a text that several documents hold, the mean decides (a tie counts as harmful); null labels are left out.

    Copies count once, as training tells a rare wording by the number of documents that hold it.
    """
    one = labels.where("doc_id IS NOT NULL AND harmful IS NOT NULL").groupBy("doc_id").agg((F.avg("harmful") >= 0.5).cast("int").alias("y"))
    return docs.select("doc_id", "text").join(one, "doc_id").groupBy("text").agg(F.min("doc_id").alias("id"), (F.avg("y") >= 0.5).cast("int").alias("y")).select("id", "text", "y")


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and labels of `examples`, in order of id, for tables that the driver can hold."""
    rows = examples(docs, labels).orderBy("id").toPandas()
    return rows["text"].tolist(), [int(y) for y in rows["y"]]


def learn(docs: DataFrame, labels: DataFrame, shard: int = 10_000) -> Model:
    """The model of all labelled documents. Shards of about `shard` texts are learned by tasks of their own, each as
    `train` does it, whose counts of documents are meant for shards of this size; see `merged` for their union."""
    rows = settle(examples(docs, labels), "labelled")
    shards = math.ceil(rows.count() / shard)
    if not shards:
        return train([], [])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        m = train(group["text"].tolist(), group["y"].tolist())
        saw = np.zeros(1 << BITS, dtype=bool)
        saw[m.seen] = True
        known = [w for k in sorted(m.known) for w in m.known[k]]
        return pd.DataFrame({"at": [m.at.astype(np.int32).tobytes()], "weight": [m.weight.astype(np.float32).tobytes()], "bias": [float(m.bias)], "known": [known], "seen": [np.packbits(saw).tobytes()]})

    # more tasks than shards, so that few tasks get two
    parts = rows.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int")).repartition(4 * shards, "shard")
    parts = settle(parts.groupBy("shard").applyInPandas(run, "at binary, weight binary, bias double, known array<string>, seen binary"), "models")

    def models() -> Iterator[Model]:
        for r in parts.toLocalIterator():  # the driver holds one shard's model at a time
            known: dict[int, list[str]] = {}
            for w in r.known:
                known.setdefault(len(w), []).append(w)
            yield Model(np.frombuffer(r.at, np.int32), np.frombuffer(r.weight, np.float32), r.bias, known, np.flatnonzero(np.unpackbits(np.frombuffer(r.seen, np.uint8))))

    return merged(models())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, score) of every row of docs(doc_id, text, source); a text without words scores 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # L1 leaves some thousand weights, 2**BITS at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = shared.value
        w, memo = m.dense(), Hashes()
        for b in batches:
            scores = np.zeros(len(b))
            for k in range(0, len(b), 500):
                x = logits([sentences(text) for text in b["text"].iloc[k : k + 500]], m, w, memo)
                scores[k : k + 500] = np.where(x <= -30, 0.0, 1 / (1 + np.exp(-np.clip(x, -30.0, 30.0))))
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": scores})

    return docs.select("doc_id", "text", "source").mapInPandas(run, "doc_id long, source string, score double")


def rates(scored: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """(source, documents, harmful, rate, mean_score) per source in its folded spelling; null source as `unknown`."""
    by = scored.groupBy(F.coalesce(snake(F.col("source")), F.lit("unknown")).alias("source"))
    return by.agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") >= cutoff).cast("long")).alias("harmful"), F.avg((F.col("score") >= cutoff).cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
