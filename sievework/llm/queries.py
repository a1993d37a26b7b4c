"""The pN_ queries over whole tables, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sievework.llm import abuse, cutoff, leakage, mixing, overlap, packing, pairs, splits
from sievework.llm import target_sample as ts
from sievework.runtime import settle, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _lines(targets: DataFrame, most: int = 100_000) -> list[Row]:
    """All lines of a target table, which is configuration; more than `most` are refused, none is dropped."""
    rows = targets.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a target table has more than {most:,} lines")
    return rows


# ---------------------------------------------------------------- P1


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    sft = table(spark, d, "rsp_decision_sft").select(F.col("id").alias("record_id"), splits.problem_keys(F.col("id"), F.col("source_id")).alias("keys"))
    pref = table(spark, d, "rsp_decision_preferences").select(F.col("id").alias("record_id"), splits.problem_keys(F.col("id")).alias("keys"))
    return splits.group_records(sft.union(pref))


def _shares(spark: SparkSession, d: str) -> dict[str, float]:
    return {r.split: r.target_share for r in _lines(table(spark, d, "split_target"))}


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.shared_groups(settle(_grouped(spark, d), "grouped")).select("record_id", "group_id")


@query
def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(settle(_grouped(spark, d), "grouped"), _shares(spark, d))


@query
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    shares = _shares(spark, d)
    return splits.split_report(settle(splits.assign_splits(settle(_grouped(spark, d), "grouped"), shares), "assigned"), shares)


_KEYS_SQL = """
    SELECT id, list_sort(list_distinct(list_transform(
        regexp_extract_all(regexp_replace(regexp_replace(lower(regexp_replace(trim(src, E' \\t\\n\\r'), '([a-z])([A-Z])', '\\1_\\2', 'g')), '[ \\t\\n\\r_-]+', '_', 'g'), '([a-z])[:_]+([0-9])', '\\1_\\2', 'g'),
            '(?:^|[^a-z0-9])(?:(?:pref|dec|anc|ev|tokens)_)*([a-z]+(?:_[a-z]+)*_[0-9]+)', 1),
        lambda m: concat(regexp_extract(m, '^(.*_)[0-9]+$', 1), lpad(ltrim(regexp_extract(m, '([0-9]+)$', 1), '0'), 8, '0'))))) AS ks
"""
SQL["p1_found"] = f"""
WITH RECURSIVE src AS (
    SELECT id, concat_ws(' | ', id, source_id) AS src FROM rsp_decision_sft
    UNION ALL SELECT id, id FROM rsp_decision_preferences),
keyed AS (SELECT DISTINCT id, ks FROM ({_KEYS_SQL} FROM src) WHERE len(ks) > 0),
link AS (SELECT DISTINCT ks[1] AS a, unnest(ks) AS b FROM keyed WHERE len(ks) > 1),
edge AS (SELECT a, b FROM link WHERE a <> b UNION SELECT b, a FROM link WHERE a <> b),
reach AS (SELECT a AS n, a AS r FROM edge UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.n),
comp AS (SELECT n, min(r) AS c FROM reach GROUP BY n),
grouped AS (SELECT id AS record_id, coalesce(c, ks[1]) AS group_id FROM keyed LEFT JOIN comp ON comp.n = ks[1])
SELECT record_id, group_id FROM grouped QUALIFY count(*) OVER (PARTITION BY group_id) > 1
"""


# ---------------------------------------------------------------- P2

_FIELD = {"rsp_anchor_sft": "domain", "eval_prediction": "category"}


def _plans(spark: SparkSession, d: str) -> dict[str, dict[str, list[tuple[float, str, float, int]]]]:
    """population -> plan -> lines. The plan table is configuration; more than 100,000 lines are refused."""
    rows = _lines(table(spark, d, "sample_target"))
    out: dict[str, dict[str, list[tuple[float, str, float, int]]]] = {}
    for r in rows:
        out.setdefault(r.population, {}).setdefault(r.plan_name, []).append((r.sample_fraction, r.category, r.target_share, r.min_rows))
    return out


def _allocated(spark: SparkSession, d: str):
    """For every plan: its name, keyed population, lines, number of records, sample size."""
    for population, plans in sorted(_plans(spark, d).items()):
        names = sorted({c for lines in plans.values() for _, c, _, _ in lines})
        keyed = ts.prepared(ts.keyed_population(table(spark, d, population), "id", F.col(_FIELD[population]), names))
        counts = ts.category_counts(keyed)
        for name, lines in sorted(plans.items()):
            yield name, keyed, *ts.plan_lines(keyed, lines, counts)


@query
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for name, _, lines, records, size in _allocated(spark, d):
        for x in lines:
            rows.append((name, x.category, records, size, x.share, x.minimum, x.available, x.wanted, x.given, sum(x.taken_from.values()), x.given / size if size else None, x.lacking, x.lacking > 0, [(o, n) for o, n in x.taken_from.items()]))
    return spark.createDataFrame(rows, "plan_name string, category string, records long, sample_size long, target_share double, min_rows int, available long, wanted long, drawn long, passed_on long, actual_share double, lacking double, not_met boolean, stand_ins array<struct<category: string, n: int>>")


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_report(spark, d).where("not_met").select("plan_name", "category")


@query
def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    parts = [ts.draw(keyed, {x.category: x.given for x in lines}, seed=42).select(F.lit(name).alias("plan_name"), "id", "category") for name, keyed, lines, _, _ in _allocated(spark, d)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query
def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per plan: records, sample size and what the sample really holds, in all and of categories short of their target."""
    r = p2_report(spark, d).groupBy("plan_name").agg(F.max("records").alias("records"), F.max("sample_size").alias("sample_size"), F.sum(F.col("not_met").cast("long")).alias("lines_not_met"))
    got = p2_sample(spark, d).groupBy("plan_name").agg(F.count(F.lit(1)).alias("drawn"))
    return r.join(got, "plan_name", "left").select("plan_name", "records", "sample_size", "lines_not_met", F.coalesce("drawn", F.lit(0)).alias("drawn"))


_NAME_SQL = "regexp_replace(lower(regexp_replace(trim(v, E' \\t\\n\\r'), '([a-z])([A-Z])', '\\1_\\2', 'g')), '[ \\t\\n\\r_-]+', '_', 'g')"
_P2_SQL = f"""
WITH pop AS (SELECT 'rsp_anchor_sft' AS population, id, domain AS v FROM rsp_anchor_sft UNION ALL SELECT 'eval_prediction', id, category FROM eval_prediction),
names AS (SELECT DISTINCT population, category FROM sample_target),
vals AS (SELECT DISTINCT population, v, {_NAME_SQL} AS s FROM pop WHERE v IS NOT NULL),
near AS (SELECT vals.population, v, n.category, levenshtein(s, n.category) AS dist FROM vals JOIN names n USING (population)),
best AS (SELECT population, v, category FROM near WHERE dist <= 2 QUALIFY dist = min(dist) OVER (PARTITION BY population, v) AND count(*) OVER (PARTITION BY population, v, dist) = 1),
ids AS (SELECT pop.population, id, min(category) AS category FROM pop LEFT JOIN best USING (population, v) GROUP BY ALL),
sizes AS (SELECT population, count(*) AS n FROM ids GROUP BY ALL),
counts AS (SELECT population, category, count(*) AS n FROM ids GROUP BY ALL)
"""
SQL["p2_found"] = f"""{_P2_SQL} SELECT plan_name, t.category FROM sample_target t JOIN sizes USING (population) LEFT JOIN counts c ON c.population = t.population AND c.category = t.category
WHERE coalesce(c.n, 0) < round(greatest(min_rows, target_share * floor(sample_fraction * sizes.n + 1e-9)), 9)
"""
SQL["p2_totals"] = f"""{_P2_SQL} SELECT plan_name, max(records) AS records, max(sample_size) AS sample_size, CAST(sum(not_met) AS BIGINT) AS lines_not_met, CAST(least(greatest(max(sample_size), sum(least(min_rows, n))), sum(n)) AS BIGINT) AS drawn FROM (
 SELECT plan_name, sizes.n AS records, CAST(floor(sample_fraction * sizes.n + 1e-9) AS BIGINT) AS sample_size, min_rows, coalesce(c.n, 0) AS n,
  CAST(coalesce(c.n, 0) < round(greatest(min_rows, target_share * floor(sample_fraction * sizes.n + 1e-9)), 9) AS INTEGER) AS not_met
 FROM sample_target t JOIN sizes USING (population) LEFT JOIN counts c ON c.population = t.population AND c.category = t.category) GROUP BY plan_name
"""


# ---------------------------------------------------------------- P5


#: Categories that are variants of one task: a sequence holds items of one of them only.
VARIANTS = (("equation_numeric", "equation_numeric_symbolic"), ("numeral", "numeral_system"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(settle(packing.lengths(table(spark, d, "token_corpus")), "lengths"), barred=VARIANTS)


@query
def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """What every packing must keep: tokens placed, bins beyond capacity, bins with twins or with barred sources, items placed twice."""
    items = settle(packing.lengths(table(spark, d, "token_corpus")), "lengths")
    return packing.checks(settle(packing.pack(items, barred=VARIANTS), "packed"), items, VARIANTS)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("piece = 0 AND pieces > 1").select("problem_id")


@query
def p5_bins(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


@query
def p5_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.sequences(table(spark, d, "token_corpus"), settle(_packed(spark, d), "packed"))


@query
def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(_packed(spark, d))


SQL["p5_checks"] = "SELECT CAST(count(*) AS BIGINT) AS items, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(ceil(n / 8192)) AS BIGINT) AS pieces, 0::BIGINT AS over_capacity, 0::BIGINT AS with_twins, 0::BIGINT AS with_barred, 0::BIGINT AS placed_twice FROM (SELECT problem_id, max(coalesce(len(tokens), 0)) AS n FROM token_corpus WHERE problem_id IS NOT NULL GROUP BY 1)"
SQL["p5_found"] = "SELECT DISTINCT problem_id FROM token_corpus WHERE len(tokens) > 8192"


# ---------------------------------------------------------------- P6


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.detect(spread(table(spark, d, "eval_prediction").select("id", "source", "raw_output", "prediction")))[0].select("id", "field")


@query
def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.detect(spread(table(spark, d, "eval_prediction").select("id", "source", "raw_output", "prediction")))[0]


@query
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.report(spread(table(spark, d, "eval_prediction").select("id", "source", "raw_output", "prediction")))


# ---------------------------------------------------------------- P4


def _pair_values(spark: SparkSession, d: str) -> DataFrame:
    sft = pairs.stacked(spread(table(spark, d, "rsp_decision_sft").select("id", "prompt", "completion", "final_answer")), "id", "prompt", ["completion", "final_answer"], {"final_answer": "completion"})
    return sft.union(pairs.stacked(spread(table(spark, d, "rsp_decision_preferences").select("id", "prompt", "chosen", "rejected")), "id", "prompt", ["chosen", "rejected"]))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.label(_pair_values(spark, d)).select("record_id", "field", "defect")


@query
def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    return pairs.label(_pair_values(spark, d))


# ---------------------------------------------------------------- P3


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation records; of a problem predicted several times every distinct prompt counts."""
    sft = spread(table(spark, d, "rsp_decision_sft").select(F.col("id").alias("key"), "prompt", "split"))
    problems = table(spark, d, "eval_prediction").where("problem_id IS NOT NULL").select(F.col("problem_id").alias("key"), "prompt").distinct()
    return sft.where("split = 'train'").drop("split"), sft.where("split IN ('validation', 'test')").drop("split").union(problems)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    o = overlap.overlaps(*_sides(spark, d))
    return o.select(F.least("train_key", "held_key").alias("key_a"), F.greatest("train_key", "held_key").alias("key_b")).distinct()


@query
def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct texts with what matched and how many records hold either; see p3_members for these."""
    return overlap.classes(*_sides(spark, d))[0]


@query
def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """The records of every text that overlaps, with its number of links to different texts of the other side."""
    pairs, members = overlap.classes(*_sides(spark, d))
    links = pairs.select(F.lit("train").alias("side"), F.col("train_text").alias("text")).union(pairs.select(F.lit("held"), "held_text")).groupBy("side", "text").agg(F.count(F.lit(1)).alias("links"))
    return members.join(links, ["side", "text"])


@query
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split, source and source_id (null for eval_prediction): evaluation records that also stand in training."""
    pairs, members = overlap.classes(*_sides(spark, d))
    by_text = pairs.groupBy(F.col("held_text").alias("text")).agg(F.sum("train_copies").alias("pairs"))
    hit = settle(members.where("side = 'held'").join(by_text, "text").groupBy(F.col("key").alias("held_key")).agg(F.sum("pairs").alias("pairs")), "hits")
    sft = table(spark, d, "rsp_decision_sft").where("split IN ('validation', 'test')").select(F.col("id").alias("held_key"), "split", "source", "source_id")
    ev = table(spark, d, "eval_prediction").where("problem_id IS NOT NULL").select(F.col("problem_id").alias("held_key"), F.lit("eval_prediction").alias("split"), "source", F.lit(None).cast("string").alias("source_id"))
    rows = sft.union(ev).distinct().join(hit, "held_key", "left")
    return rows.groupBy("split", "source", "source_id").agg(F.count(F.lit(1)).alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


# ---------------------------------------------------------------- P7


def _leaks(spark: SparkSession, d: str, paraphrase: float | None = None) -> DataFrame:
    return leakage.search(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "heldout_item"), cosine=0.6 if paraphrase is None else 0.45, paraphrase=paraphrase)


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


@query
def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Passages and, beyond p7_found, paraphrases: documents that share half of an item's words in their order."""
    return _leaks(spark, d, 0.5)


@query
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_leaks(spark, d), table(spark, d, "heldout_item"))


# ---------------------------------------------------------------- P8


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text", "source", mixing.quality(F.col("text")).alias("weight"))
    targets = {r.source: (r.target_share, r.max_repeats) for r in _lines(table(spark, d, "mix_target"))}
    return mixing.mix(mixing.token_counts(spread(docs)), targets)


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


@query
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


# ---------------------------------------------------------------- P9

#: Documents of this score or more count as harmful.
HARMFUL = 0.46


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return abuse.score(spread(docs), abuse.learn(docs, table(spark, d, "doc_label")))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(F.col("score") >= HARMFUL).select("doc_id").distinct()


@query
def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


@query
def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d), HARMFUL)
