"""P8: a mix of sources with target shares of its tokens, by Efraimidis-Spirakis sampling.

Each document gets an exponential key scaled by its quality weight. Within a source, complete
epochs come first; what is left of the budget is filled with the documents of smallest key, whose
tokens are summed up to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.names import canonical
from sievework.runtime import running_total, settle, unit_hash

TOKENIZERS = "/opt/tokenizers"


def token_counts(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json", batch: int = 256) -> DataFrame:
    """docs(doc_id, text, ...) with `tokens`, the length of the whole text in a public tokenizer's tokens.

    `vocabulary` is a path that the workers can read (a file of the `tokenizers` library). Null
    and empty texts have 0.
    """
    keep = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        t.encode_special_tokens = True
        for b in batches:
            texts = [x if isinstance(x, str) else "" for x in b["text"]]
            n: list[int] = []
            for k in range(0, len(texts), batch):
                n += [len(e.ids) for e in t.encode_batch_fast(texts[k : k + batch], add_special_tokens=False)]
            out = b[keep].copy()
            out["tokens"] = n
            yield out

    return docs.mapInPandas(run, f"{schema}, tokens long")


def quality(text: Column) -> Column:
    """A weight in [0.5, 1.5]: more for texts of mostly letters and digits, less for very short or broken ones."""
    n = F.length(text)
    clean = F.regexp_count(text, F.lit(r"[\p{L}\p{N}\s.,;:!?]")) / F.greatest(n, F.lit(1))
    size = F.least(F.lit(1.0), n / 400.0)
    return F.coalesce(0.5 + 0.7 * clean + 0.3 * size, F.lit(0.5))


def mix(docs: DataFrame, targets: Mapping[str, tuple[float, int]], total: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, repeats) and its report, of docs(doc_id, source, tokens, weight).

    targets: source -> (share, max_repeats); shares are scaled to sum 1. `total` is the size in
    tokens, by default all tokens of the named sources. Sources are matched by canonical
    spelling; documents of other or no source, and without tokens, are left out. A source gets complete epochs
    and then the documents of smallest key (log(u) / -weight), up to its budget; never more
    than max_repeats of a document. The report has a row a source: budget, tokens reached,
    actual share of the mix, epochs, and `short` if repeats ran out.
    """
    spark = docs.sparkSession
    named = docs.withColumn("source", canonical(F.col("source"), list(targets))).where("source IS NOT NULL AND doc_id IS NOT NULL AND tokens > 0")
    named = settle(named.select("doc_id", "source", "tokens", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-6)).alias("weight")), "named")
    have = {r.source: (r.n, r.t) for r in named.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()}
    scale = sum(s for s, _ in targets.values()) or 1.0
    total = sum(t for _, t in have.values()) if total is None else total
    plan = []
    for source, (share, most) in sorted(targets.items()):
        budget, there = total * share / scale, have.get(source, (0, 0))[1]
        epochs = min(most, int(budget // there)) if there else 0
        left = budget - epochs * there if epochs < most else 0.0
        plan.append((source, share / scale, most, budget, epochs, left))
    quota = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, budget double, epochs int, rest double")
    u = (unit_hash(F.lit(seed), F.col("doc_id")).cast("double") + 1) / F.lit(2.0**63)
    # the exponential key as a 63-bit order key: the larger 1 - exp(-key), the later
    order = (-F.expm1(F.log(F.least(u, F.lit(1 - 1e-15))) / F.col("weight")) * F.lit(float(2**62))).cast("long")
    ranked = running_total(named.withColumn("k", order), ["source"], "k", ["doc_id"], F.col("tokens"))
    chosen = ranked.join(F.broadcast(quota), "source")
    last = F.col("upto") - F.col("tokens") < F.col("rest")  # the document that reaches the budget is kept if it overshoots less than it would leave open
    over, under = F.col("upto") - F.col("rest"), F.col("rest") - (F.col("upto") - F.col("tokens"))
    extra = (F.col("upto") <= F.col("rest")) | (last & (over <= under))
    out = settle(chosen.select("doc_id", "source", "tokens", (F.col("epochs") + extra.cast("int")).alias("repeats")).where("repeats > 0"), "mix")
    used = out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeated"))
    size = out.agg(F.sum(F.col("tokens") * F.col("repeats"))).first()[0] or 0
    r = quota.join(used, "source", "left").na.fill(0, ["tokens", "documents", "most_repeated"])
    report = r.select("source", "target_share", (F.col("tokens") / F.lit(max(size, 1))).alias("actual_share"), F.round("budget").cast("long").alias("budget"), "tokens", "documents", "max_repeats", "most_repeated", ((F.col("epochs") >= F.col("max_repeats")) & (F.col("tokens") < F.floor("budget")) | (F.col("documents") == 0)).alias("short"))
    return out.select("doc_id", "source", "repeats"), report
