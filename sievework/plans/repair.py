"""Composite data sets: repair, replay, guard and preference rows from a run's predictions; audits; decoded items.

A prediction's record is its problem; wrong ones are the targets, right ones the replays. All draws are
by seeded hash, so each set is the same on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import answers as A
from sievework.functions import chat as C
from sievework.functions import tokens as T
from sievework.functions.names import folded
from sievework.operators import gates as G
from sievework.operators import joins as J
from sievework.operators import order as O
from sievework.plans.catalog import _F, _FAM, _P, _T, _TRIM, _folded, _ok, _fa, corpus, family, preds, query
from sievework.runtime import settle, table

_W = "coalesce(exact_match, 0) = 0"
_R = "coalesce(exact_match, 0) = 1"


def _draw_sql(cond: str, n: int, seed: int, not_in: str = "") -> str:
    return f"(SELECT * FROM {_P} WHERE {cond} {not_in} ORDER BY md5(concat_ws('|', '{seed}', id)), id LIMIT {n})"


def wrong(p: DataFrame, category: str | None = None) -> DataFrame:
    bad = p.where(F.coalesce("exact_match", F.lit(0)) == 0)
    return bad.where(F.col("category") == category) if category else bad


def right(p: DataFrame, category: str | None = None) -> DataFrame:
    good = p.where(F.coalesce("exact_match", F.lit(0)) == 1)
    return good.where(F.col("category") == category) if category else good


def drifted(p: DataFrame) -> DataFrame:
    """Replies without the literal box marker; null counts as lacking it."""
    return p.where(~A.has_box(F.col("raw_output")))


def _grouped(parts: list[tuple[str, DataFrame, int]]) -> DataFrame:
    out = None
    for name, df, times in parts:
        one = O.repeated(df, times).withColumn("mix_group", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_LACK = "NOT coalesce(contains(raw_output, '\\boxed{'), false)"


@query(f"""SELECT id, mix_group, repeat_index FROM (
SELECT id, 'equation_wrong' AS mix_group, CAST(unnest(range(6)) AS INTEGER) AS repeat_index FROM {_P} WHERE category = 'equation_numeric' AND {_W}
UNION ALL SELECT id, 'bit_drift', CAST(unnest(range(8)) AS INTEGER) FROM {_P} WHERE category = 'bit_manipulation' AND {_LACK}
UNION ALL SELECT id, 'equation_replay', 0 FROM {_draw_sql(f"category = 'equation_numeric' AND {_R}", 24, 42)}
UNION ALL SELECT id, 'bit_replay', 0 FROM {_draw_sql(f"category = 'bit_manipulation' AND {_R} AND NOT ({_LACK})", 24, 42)})""")
def correction_set(spark, d):
    """Wrong equations six times, drifted bit tasks eight times, and 24 right ones of each that are not used yet."""
    p = preds(spark, d, "category", "exact_match", "raw_output")
    drift = drifted(p.where("category = 'bit_manipulation'"))
    replay = J.unused(right(p, "bit_manipulation"), drift, "id")
    rows = _grouped([("equation_wrong", wrong(p, "equation_numeric"), 6), ("bit_drift", drift, 8), ("equation_replay", O.draw(right(p, "equation_numeric"), "id", 24, 42), 1), ("bit_replay", O.draw(replay, "id", 24, 42), 1)])
    return rows.select("id", "mix_group", "repeat_index")


@query(f"""SELECT id, mix_group, repeat_index, CASE WHEN v1 THEN 'reference_response' WHEN v2 THEN 'raw_output_exact' ELSE 'fallback_boxed_answer' END AS response_source
FROM (SELECT *, coalesce(reference_response <> '', false) AND ({_ok('answer', _fa('reference_response'))}) AS v1, coalesce(exact_match, 0) = 1 AND coalesce(raw_output <> '', false) AND ({_ok('answer', _fa('raw_output'))}) AS v2 FROM (
SELECT *, 'wrong' AS mix_group, CAST(unnest(range(3)) AS INTEGER) AS repeat_index FROM {_P} WHERE category IN ('equation_numeric', 'bit_manipulation') AND {_W}
UNION ALL SELECT *, 'replay', 0 FROM {_draw_sql(f"category = 'equation_numeric' AND {_R}", 18, 7)}) WHERE answer IS NOT NULL)""")
def teacher_set(spark, d):
    """Wrong rows three times and 18 replays, each with its first verified reply."""
    p = preds(spark, d, "category", "exact_match", "raw_output", "reference_response", "answer")
    bad = wrong(p).where(F.col("category").isin("equation_numeric", "bit_manipulation"))
    rows = _grouped([("wrong", bad, 3), ("replay", O.draw(right(p, "equation_numeric"), "id", 18, 7), 1)]).where("answer IS NOT NULL")
    reply = C.teacher_reply(F.col("reference_response"), F.col("raw_output"), F.col("exact_match"), F.col("answer"), F.col("category"))
    return rows.select("id", "mix_group", "repeat_index", reply["source"].alias("response_source"))


_OLD = "('cipher', 'gravity', 'numeral', 'unit_conversion')"


@query(f"""SELECT id, part FROM (SELECT id, 'train' AS part, CAST(unnest(range(4)) AS INTEGER) AS k FROM {_P} WHERE category = 'equation_numeric' AND {_W}
UNION ALL SELECT id, 'train', 0 FROM {_draw_sql(f"category = 'equation_numeric' AND {_R}", 12, 11)}
UNION ALL SELECT id, 'guard', 0 FROM (SELECT id, row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws('|', '12', id)), id) AS rn FROM {_P} WHERE category IN {_OLD} AND {_R}) WHERE rn <= 8
UNION ALL SELECT id, 'guard', 0 FROM {_draw_sql(f"category = 'equation_numeric' AND {_R}", 8, 11)})""")
def guarded_replay(spark, d):
    """Train rows (wrong x4, 12 right) and guard rows (8 per old category, 8 of the same right ones, which overlap by design)."""
    p = preds(spark, d, "category", "exact_match")
    old = right(p).where(F.col("category").isin("cipher", "gravity", "numeral", "unit_conversion"))
    eq = right(p, "equation_numeric")
    train = _grouped([("train", wrong(p, "equation_numeric"), 4), ("train", O.draw(eq, "id", 12, 11), 1)])
    guard = _grouped([("guard", O.sample_per_group(old, "category", "id", 8, 12), 1), ("guard", O.draw(eq, "id", 8, 11), 1)])
    return train.unionByName(guard).select("id", F.col("mix_group").alias("part"))


@query(f"""SELECT id, CAST(unnest(range(2)) AS INTEGER) AS repeat_index, E'S4: APPLY target\\nresult = ' || w || E'\\n</think>\\n\\\\boxed{{' || w || '}}<|im_end|>' AS rejected_response FROM (SELECT id, CASE WHEN {_TRIM("coalesce(prediction, '')")} = '' THEN 'NOT_FOUND' ELSE {_TRIM('prediction')} END AS w FROM {_P} WHERE category = 'equation_numeric' AND {_W} AND answer IS NOT NULL)""")
def preference_pairs(spark, d):
    """Wrong equations twice, with the reply to prefer and the one to reject; a pair with equal sides would teach nothing."""
    rows = O.repeated(wrong(preds(spark, d, "category", "exact_match", "answer", "prediction", "reference_response"), "equation_numeric").where("answer IS NOT NULL"), 2, 1)
    pair = rows.select("id", "repeat_index", C.apply_reply(F.col("reference_response"), F.col("answer")).alias("chosen_response"), C.rejected_reply(F.col("prediction")).alias("rejected_response"))
    return pair.select("id", "repeat_index", "rejected_response")


@query(f"""WITH s AS (SELECT * FROM {_P} WHERE NOT coalesce(regexp_full_match({_TRIM('answer')}, '[-+]?[0-9]+([.][0-9]+)?'), false)), f AS (SELECT id, CAST(unnest(range(3)) AS INTEGER) AS repeat_index FROM s WHERE {_W} AND category LIKE 'equation%')
SELECT id, repeat_index FROM f UNION ALL SELECT id, 0 FROM (SELECT id FROM s WHERE id NOT IN (SELECT id FROM f) ORDER BY md5(concat_ws('|', '5', id)), id LIMIT (SELECT greatest(360 - count(*), 0) FROM f))""")
def branch_targets(spark, d):
    """Symbolic tasks: the wrong ones three times first, filled up to 360 rows by a draw of the others."""
    s = settle(preds(spark, d, "category", "answer", "exact_match").where(~A.numeric_answer(F.col("answer"))).select("id", "category", "exact_match"), "symbolic")
    forced = O.repeated(wrong(s).where(F.col("category").startswith("equation")), 3, 1)
    fill = O.draw(J.unused(s, forced, "id"), "id", max(0, 360 - forced.count()), 5).withColumn("repeat_index", F.lit(0))
    return forced.select("id", "repeat_index").union(fill.select("id", "repeat_index"))


@query(f"""SELECT id, mix_group FROM (SELECT id, CASE WHEN {_W} THEN 'fisher_wrong' ELSE 'fisher_guard' END AS mix_group, row_number() OVER (PARTITION BY category, {_W} ORDER BY md5(concat_ws('|', '1051', id)), id) AS rn FROM {_P} WHERE category IN {_OLD}) WHERE rn <= 6""")
def fisher_rows(spark, d):
    """Six rows of each old category and outcome, for an importance estimate; the seed is set off from that of the training draw."""
    p = preds(spark, d, "category", "exact_match").where(F.col("category").isin("cipher", "gravity", "numeral", "unit_conversion")).withColumn("bad", F.coalesce("exact_match", F.lit(0)) == 0)
    few = O.top_per_group(p.select("id", "category", "bad").withColumn("k", O.draw_key(42 + 1009, "id")), ["category", "bad"], ["k", "id"], 6)
    return few.select("id", F.when(F.col("bad"), "fisher_wrong").otherwise("fisher_guard").alias("mix_group"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS family, count(*) AS rows, count(*) FILTER (WHERE prompt IS NULL) AS without_prompt, CAST(sum(hash_ok) AS BIGINT) AS with_weight FROM (SELECT *, CAST(sample_weight IS NOT NULL AS INTEGER) AS hash_ok FROM {_F(t)})" for k, t in _FAM.items()))
def training_set_audit(spark, d):
    """Row counts of the three families as they enter training, beside the count gate of row_count_gate."""
    out = None
    for k, t in _FAM.items():
        one = family(spark, d, t).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("prompt").isNull(), 1)).alias("without_prompt"), F.count("sample_weight").alias("with_weight")).withColumn("family", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.select("family", "rows", "without_prompt", "with_weight")


@query(f"SELECT problem_id, coalesce(segment, '') AS segment, CAST(len(tokens) AS INTEGER) AS n, array_to_string(list_transform(tokens, lambda x: 't' || x), ' ') AS text, array_to_string(list_transform(list_filter(range(1, len(tokens) + 1), lambda i: mask[i] <> 0), lambda i: 't' || tokens[i]), ' ') AS masked_text FROM {_T} LEFT JOIN (SELECT problem_id, min(segment) AS segment FROM token_index GROUP BY 1) USING (problem_id)")
def decoded_items(spark, d):
    """Items decoded to text with their metadata; the decoder is a plug-in, here token numbers."""
    meta = table(spark, d, "token_index").groupBy("problem_id").agg(F.min("segment").alias("segment"))
    t = J.looked_up(corpus(spark, d).drop("category"), meta, "problem_id", ["segment"])
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("t"), x.cast("string"))), " ")
    return t.select("problem_id", "segment", F.size("tokens").alias("n"), text(F.col("tokens")).alias("text"), text(T.kept_tokens(F.col("tokens"), F.col("mask"))).alias("masked_text"))


@query(f"SELECT problem_id, CAST(row_number() OVER (ORDER BY s IS NULL, s, problem_id) AS BIGINT) AS place FROM (SELECT DISTINCT problem_id FROM token_corpus) LEFT JOIN (SELECT problem_id, min(step) AS s FROM token_index WHERE epoch = 0 GROUP BY 1) USING (problem_id)")
def item_order(spark, d):
    """Items in the order of epoch 0, those that it lacks behind them by name."""
    idx = table(spark, d, "token_index").where("epoch = 0").select("problem_id", "step")
    files = table(spark, d, "token_corpus").select("problem_id").distinct()
    return J.indexed_first(idx, files, "problem_id", ["step"]).select("problem_id", "place")


@query("SELECT id, coalesce(nullif(f, ''), CASE d WHEN 'bit_manipulation' THEN 'bit' END, 'rest') AS task, 'row_' || lpad(CAST(rn - 1 AS VARCHAR), 6, '0') AS fallback_id FROM (SELECT id, coalesce(domain, '') AS d, '' AS f, row_number() OVER (ORDER BY id) AS rn FROM " + _F("rsp_anchor_sft") + ")")
def task_labels(spark, d):
    """A row's task from its field, a map or a default, and the id that a row without one would get."""
    a = O.numbered(family(spark, d, "rsp_anchor_sft", "domain"), ["id"])
    mapped = F.try_element_at(F.create_map(F.lit("bit_manipulation"), F.lit("bit")), F.coalesce("domain", F.lit("")))
    return a.select("id", J.task_of(F.lit(""), mapped, "rest", F.col("id")).alias("task"), F.format_string("row_%06d", F.col("rn") - 1).alias("fallback_id"))


@query(f"SELECT id, coalesce(x.v, y.v) AS v FROM (SELECT DISTINCT id, prompt FROM {_F('rsp_anchor_sft')}) a LEFT JOIN (SELECT id, max(final_answer) AS v FROM rsp_anchor_sft WHERE source IS NOT NULL GROUP BY 1) x USING (id) LEFT JOIN (SELECT id, max(domain) AS v FROM rsp_anchor_sft GROUP BY 1) y USING (id) WHERE coalesce(x.v, y.v) IS NOT NULL")
def preferred_values(spark, d):
    """Each record's value from the first of two tables that knows it; unknown records are dropped."""
    t = table(spark, d, "rsp_anchor_sft")
    ids = family(spark, d, "rsp_anchor_sft", "id")
    first = t.where("source IS NOT NULL").groupBy("id").agg(F.max("final_answer").alias("v")).where("v IS NOT NULL")
    second = t.groupBy("id").agg(F.max("domain").alias("v")).where("v IS NOT NULL")
    return J.by_priority(ids, "id", [first, second], "v")


def matching(rows: DataFrame, *predicates: Column) -> DataFrame:
    """The rows that meet every predicate of the caller (category, id prefix, prompt length, ...); an error if none does."""
    for p in predicates:
        rows = rows.where(p)
    if rows.isEmpty():
        raise ValueError(f"no rows where {' and '.join(map(str, predicates))}")
    return rows


def only_category(rows: DataFrame, category: str) -> DataFrame:
    """The rows; an error that names the categories, folded, which are not the one wanted, or if there are no rows."""
    found = {r.c for r in rows.select(folded(F.col("category"), G.DOMAINS).alias("c")).distinct().collect()}
    if not found:
        raise ValueError(f"no rows of category {category}")
    if found != {category}:
        raise ValueError(f"categories other than {category}: {sorted(found - {category})}")
    return rows


def category_rows(p: DataFrame, category: str) -> DataFrame:
    """All rows of a category in any spelling, numbered by id."""
    rows = only_category(matching(p, folded(F.col("category"), G.DOMAINS) == category), category)
    return O.numbered(rows, ["id"], "place")


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS place, pred AS prediction, CAST({_ok('answer', 'pred')} AS INTEGER) AS exact FROM (SELECT id, answer, {_TRIM(f"regexp_replace({_fa('raw_output')}, '<\\|[^>]+?\\|>', '', 'g')")} AS pred FROM {_P} WHERE {_folded('category')} = 'equation_numeric')")
def whole_category(spark, d):
    """Evaluation of a whole category: every prediction of it in order of id, none sampled, with its score."""
    rows = category_rows(settle(preds(spark, d, "category", "answer", "raw_output"), "predictions"), "equation_numeric")
    r = rows.select("id", "place", "answer", A.clean(A.final_answer(F.col("raw_output"))).alias("prediction"))
    return r.select("id", "place", "prediction", A.verified(F.col("answer"), F.col("prediction")).cast("int").alias("exact"))


@query("SELECT side, domain FROM (SELECT 'left' AS side, domain FROM (SELECT DISTINCT domain FROM rsp_anchor_sft WHERE domain IS NOT NULL EXCEPT SELECT domain FROM rsp_decision_sft) ORDER BY domain LIMIT 10) UNION ALL SELECT side, domain FROM (SELECT 'right' AS side, domain FROM (SELECT DISTINCT domain FROM rsp_decision_sft WHERE domain IS NOT NULL EXCEPT SELECT domain FROM rsp_anchor_sft) ORDER BY domain LIMIT 10)")
def domain_differences(spark, d):
    a, b = (table(spark, d, t).select("domain").where("domain IS NOT NULL") for t in ("rsp_anchor_sft", "rsp_decision_sft"))
    return G.set_difference(a, b, "domain")
