"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import answers as A
from sievework.functions import chat as C
from sievework.functions import tokens as T
from sievework.functions.names import folded
from sievework.operators import gates as G
from sievework.operators import joins as J
from sievework.operators import linalg as L
from sievework.operators import metrics as M
from sievework.operators import order as O
from sievework.runtime import settle, table
from sievework.sources import adapters as AD
from sievework.sources import io as IO

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "scored_predictions"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ shared inputs

_PRED = ["id", "problem_id", "category", "prompt", "answer", "reference_response", "raw_output", "prediction", "exact_match", "source"]


def preds(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Predictions, each id once (its first delivery); only `cols` are read if given."""
    return O.first_wins(table(spark, d, "eval_prediction"), "id", ["ingested_at"], list(dict.fromkeys(["id", *cols])) if cols else _PRED)


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Token items, each once; masks padded to the tokens' length."""
    t = O.first_wins(table(spark, d, "token_corpus"), "problem_id", ["ingested_at"], ["problem_id", "category", "tokens", "mask"])
    return t.withColumn("mask", T.padded(F.col("mask"), F.size("tokens"), 0.0))


def family(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    """Rows of a family, each id once; only `cols` are read if given."""
    df = table(spark, d, name)
    return O.first_wins(df, "id", ["ingested_at"], list(dict.fromkeys(["id", *cols])) if cols else [c for c in df.columns if c != "ingested_at"])


def index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "token_index").dropDuplicates(["problem_id", "epoch", "step", "segment"])


_P = "(SELECT * FROM eval_prediction WHERE id <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
_T = "(SELECT problem_id, category, tokens, mask || list_transform(range(len(tokens) - len(mask)), lambda x: 0.0::DOUBLE) AS mask FROM token_corpus QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY ingested_at) = 1)"
_F = lambda t: f"(SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
_I = "(SELECT DISTINCT problem_id, epoch, step, segment FROM token_index)"
_TRIM = lambda c: f"trim({c}, E' \\t\\n\\r')"


def _fa(c: str) -> str:
    """SQL of answers.final_answer."""
    boxes = f"list_transform(str_split({c}, '\\boxed{{')[2:], lambda s: {_TRIM('CASE WHEN contains(s, chr(125)) THEN regexp_extract(s, $$(?s)^(.*)[}]$$, 1) ELSE s END')})"
    said = ", ".join(_TRIM(f"regexp_extract_all({c}, '{p}', 1)[-1]") for p in (r"(?i)The final answer is:\s*([^\n]+)", r"(?i)Final answer is:\s*([^\n]+)", r"(?i)Final answer\s*[:：]\s*([^\n]+)"))
    lines = f"list_filter(list_transform(str_split({c}, chr(10)), lambda s: {_TRIM('s')}), lambda s: s <> '')"
    return f"coalesce(list_filter({boxes}, lambda s: s <> '')[-1], {boxes}[-1], {said}, regexp_extract_all({c}, '-?\\d+(?:\\.\\d+)?')[-1], {lines}[-1], 'NOT_FOUND')"


def _clean(c: str) -> str:
    return _TRIM(f"regexp_replace({c}, '<\\|[^>]+?\\|>', '', 'g')")


def _ok(gold: str, pred: str) -> str:
    """SQL of answers.verified."""
    g, p = _clean(f"coalesce({gold}, 'None')"), _clean(f"coalesce({pred}, 'None')")
    num = r"'[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?'"
    a, b = f"try_cast({g} AS DOUBLE)", f"try_cast({p} AS DOUBLE)"
    return f"CASE WHEN regexp_full_match({g}, '[01]+') THEN lower({g}) = lower({p}) WHEN regexp_full_match({g}, {num}) AND regexp_full_match({p}, {num}) THEN abs({a} - {b}) <= greatest(0.01 * greatest(abs({a}), abs({b})), 0.00001) ELSE lower({g}) = lower({p}) END"


_BLANK = r"\s\x{00A0}\x{200B}\x{FEFF}"


def _folded(c: str) -> str:
    """SQL of names.folded over the domains."""
    known = f"[{', '.join(repr(x) for x in G.DOMAINS)}]"
    snake = f"nullif(regexp_replace(lower(regexp_replace(regexp_replace({c}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g'), '([a-z])([A-Z])', '\\1_\\2', 'g')), '[\\s\\x{{00A0}}_-]+', '_', 'g'), '')"
    near = f"list_sort(list_filter(list_transform({known}, lambda n: struct_pack(d := levenshtein({snake}, n), n := n)), lambda x: x.d <= 2))"
    return f"coalesce(CASE WHEN list_contains({known}, {snake}) THEN {snake} WHEN len({near}) = 1 OR {near}[1].d < {near}[2].d THEN {near}[1].n END, {snake}, 'unknown')"


# ------------------------------------------------------------------ answers and scores


@query(f"SELECT id, pred AS prediction, CAST({_ok('answer', 'pred')} AS INTEGER) AS exact FROM (SELECT id, answer, {_clean(_fa('raw_output'))} AS pred FROM {_P})")
def scored_predictions(spark, d):
    p = preds(spark, d, "answer", "raw_output").select("id", "answer", A.clean(A.final_answer(F.col("raw_output"))).alias("prediction"))
    return p.select("id", "prediction", A.verified(F.col("answer"), F.col("prediction")).cast("int").alias("exact"))


@query(f"""SELECT category, count(*) AS examples, CAST(sum(exact) AS DOUBLE) / greatest(1, count(*)) AS accuracy, CAST(grouping(category) AS BIGINT) AS level
FROM (SELECT category, CAST({_ok('answer', _clean(_fa('raw_output')))} AS INTEGER) AS exact FROM {_P}) GROUP BY GROUPING SETS ((category), ())""")
def accuracy_summary(spark, d):
    p = preds(spark, d, "category", "answer", "raw_output").withColumn("exact", A.verified(F.col("answer"), A.clean(A.final_answer(F.col("raw_output")))).cast("int"))
    return M.accuracy(p, "exact", ["category"]).withColumn("level", F.col("level").cast("bigint"))


@query(f"SELECT id, {_fa('reference_response')} AS final_answer, coalesce({_TRIM('regexp_extract_all(reference_response, $$[\\]boxed[{]([^}]*)[}]$$, 1)[-1]')}, '') AS simple, coalesce(contains(reference_response, '\\boxed{{'), false) AS boxed FROM {_P}".replace("[\\]boxed", "\\\\boxed"))
def extracted_references(spark, d):
    r = F.col("reference_response")
    return preds(spark, d, "reference_response").select("id", A.final_answer(r).alias("final_answer"), A.boxed_simple(r).alias("simple"), A.has_box(r).alias("boxed"))


@query(f"SELECT id, coalesce(regexp_full_match({_TRIM('answer')}, '[-+]?[0-9]+([.][0-9]+)?'), false) AS is_numeric, coalesce(regexp_matches(answer, '[^\\p{{L}}\\p{{N}}]'), false) AS has_sign, '\\boxed{{' || answer || '}}' AS boxed FROM {_P}")
def answer_shapes(spark, d):
    a = F.col("answer")
    return preds(spark, d, "answer").select("id", A.numeric_answer(a).alias("is_numeric"), A.has_sign(a).alias("has_sign"), A.boxed(a).alias("boxed"))


_SYM = "category LIKE 'equation_numeric%'"
_REWARD = f"""SELECT id, problem_id, pred AS prediction, exact, has_boxed, inner_code AS internal_code,
 round((CASE WHEN exact = 1 THEN 1.0 ELSE 0.0 END) + (CASE WHEN has_boxed = 1 THEN 0.05 ELSE -0.1 END) + (CASE WHEN hit AND exact = 0 THEN -0.1 ELSE 0.0 END) + (CASE WHEN inner_code = 1 THEN -0.15 ELSE 0.0 END), 6)::DOUBLE AS reward
FROM (SELECT *, CAST(sym AND exact = 0 AND regexp_full_match(trim(pred), '[A-Zxyz?]{{2,}}') AS INTEGER) AS inner_code FROM (SELECT id, problem_id, pred, CAST({_ok('answer', 'pred')} AS INTEGER) AS exact, CAST(coalesce(contains(raw_output, '\\boxed{{'), false) AS INTEGER) AS has_boxed,
 coalesce({_SYM}, false) AS sym, coalesce({_SYM}, false) AND ({' OR '.join(f"contains(lower(coalesce(raw_output, '')), '{p}')" for p in A.FALLBACK_PHRASES)}) AS hit FROM (SELECT *, {_fa('raw_output')} AS pred FROM {_P})))"""


def _rewards(spark, d):
    sym = F.coalesce(F.col("category").startswith("equation_numeric"), F.lit(False))
    return preds(spark, d, "problem_id", "category", "answer", "raw_output").select("id", "problem_id", A.reward(F.col("raw_output"), F.col("answer"), sym).alias("r")).select("id", "problem_id", "r.prediction", "r.exact", "r.has_boxed", "r.internal_code", F.round("r.reward", 6).alias("reward"))


@query(_REWARD)
def rewards(spark, d):
    return _rewards(spark, d)


@query(f"""SELECT id, problem_id, reward, round(CASE WHEN s < 1e-6 THEN 0.0 ELSE (reward - m) / s END, 6) AS advantage FROM (SELECT *, avg(reward) OVER (PARTITION BY problem_id) AS m, stddev_pop(reward) OVER (PARTITION BY problem_id) AS s FROM ({_REWARD}) WHERE problem_id IS NOT NULL)""")
def group_advantages(spark, d):
    return M.advantages(_rewards(spark, d).where("problem_id IS NOT NULL"), ["problem_id"], "reward").select("id", "problem_id", "reward", F.round("advantage", 6).alias("advantage"))


@query(f"SELECT problem_id, count(*) AS rollouts, round(avg(reward), 6) AS mean_reward, max(reward) AS best_reward, CAST(sum(exact) AS BIGINT) AS exact FROM ({_REWARD}) WHERE problem_id IS NOT NULL GROUP BY problem_id")
def rollout_groups(spark, d):
    return M.rollout_stats(_rewards(spark, d).where("problem_id IS NOT NULL"), ["problem_id"], "reward", "exact").withColumn("mean_reward", F.round("mean_reward", 6))


@query(f"SELECT problem_id, id, advantage FROM (SELECT problem_id, id, round(CASE WHEN s < 1e-6 THEN 0.0 ELSE (reward - m) / s END, 6) AS advantage, max(abs(CASE WHEN s < 1e-6 THEN 0.0 ELSE (reward - m) / s END)) OVER (PARTITION BY problem_id) AS top FROM (SELECT *, avg(reward) OVER (PARTITION BY problem_id) AS m, stddev_pop(reward) OVER (PARTITION BY problem_id) AS s FROM ({_REWARD}) WHERE problem_id IS NOT NULL)) WHERE top >= 1e-8")
def informative_rollouts(spark, d):
    """Rollout scoring to policy rows: groups whose advantages are all zero are skipped."""
    a = M.advantages(_rewards(spark, d).where("problem_id IS NOT NULL"), ["problem_id"], "reward")
    live = a.groupBy("problem_id").agg(F.max(F.abs("advantage")).alias("top")).where("top >= 1e-8")
    return a.join(live, "problem_id", "left_semi").select("problem_id", "id", F.round("advantage", 6).alias("advantage"))


@query(f"""SELECT id, source, CAST(sum(e) OVER w AS DOUBLE) / count(*) OVER w AS running_accuracy FROM (SELECT id, source, coalesce(exact_match, 0) AS e FROM {_P}) WINDOW w AS (ORDER BY id ROWS UNBOUNDED PRECEDING)""")
def running_accuracy(spark, d):
    p = preds(spark, d, "source", "exact_match").select("id", "source", F.coalesce("exact_match", F.lit(0)).alias("e"), F.lit(1).alias("one"))
    both = O.running(p, ["id"], F.col("e"), "correct")
    both = O.running(both, ["id"], F.lit(1), "seen")
    return both.select("id", "source", (F.col("correct") / F.col("seen")).alias("running_accuracy"))


@query(f"SELECT source, CASE WHEN regexp_full_match(trim(answer), '[-+]?[0-9]+([.][0-9]+)?') THEN 'numeric' ELSE 'symbolic' END AS answer_type, count(*) AS examples, avg(coalesce(exact_match, 0)) AS accuracy, CAST(grouping(source) * 2 + grouping(CASE WHEN regexp_full_match(trim(answer), '[-+]?[0-9]+([.][0-9]+)?') THEN 'numeric' ELSE 'symbolic' END) AS BIGINT) AS level FROM {_P} GROUP BY CUBE (1, 2)")
def accuracy_slices(spark, d):
    p = preds(spark, d, "source", "answer", "exact_match").withColumn("answer_type", F.when(A.numeric_answer(F.col("answer")), "numeric").otherwise("symbolic"))
    return M.slices(p, "exact_match", ["source", "answer_type"]).withColumn("level", F.col("level").cast("bigint"))


@query(f"""WITH a AS (SELECT problem_id, max(coalesce(exact_match, 0)) AS o1, min(coalesce(prediction, '')) AS p1 FROM {_P} WHERE source = 'run_amber' AND problem_id IS NOT NULL GROUP BY 1),
b AS (SELECT problem_id, max(coalesce(exact_match, 0)) AS o2, min(coalesce(prediction, '')) AS p2 FROM {_P} WHERE source = 'run_basalt' AND problem_id IS NOT NULL GROUP BY 1)
SELECT count(*) FILTER (WHERE o1 = 0 AND o2 = 1) AS fixed, count(*) FILTER (WHERE o1 = 1 AND o2 = 0) AS regressed, count(*) FILTER (WHERE p1 <> p2) AS changed, count(*) FILTER (WHERE p1 IS NULL OR p2 IS NULL) AS one_sided FROM a FULL JOIN b USING (problem_id)""")
def run_comparison(spark, d):
    p = preds(spark, d, "problem_id", "source", "exact_match", "prediction").where("problem_id IS NOT NULL")
    one = lambda s: p.where(F.col("source") == s).groupBy("problem_id").agg(F.max(F.coalesce("exact_match", F.lit(0))).alias("o"), F.min(F.coalesce("prediction", F.lit(""))).alias("p"))
    return J.two_runs(one("run_amber"), one("run_basalt"), "problem_id", "o", "p")


# ------------------------------------------------------------------ prompts and replies


@query(f"""SELECT id, CASE WHEN contains(prompt, 'Please put your final answer inside') THEN prompt ELSE prompt || E'\\nPlease put your final answer inside `\\\\boxed{{}}`. For example: `\\\\boxed{{your answer}}`' END AS asked,
 E'<|im_start|>user\\n' || coalesce(prompt, '') || E'<|im_end|>\\n<|im_start|>assistant\\n' AS chat FROM {_P} WHERE prompt IS NOT NULL""")
def chat_prompts(spark, d):
    p = preds(spark, d, "prompt").where("prompt IS NOT NULL")
    return p.select("id", C.with_box_request(F.col("prompt")).alias("asked"), C.chat(None, F.col("prompt"), generate=True).alias("chat"))


@query(f"SELECT id, {_TRIM('prompt')} AS user_prompt, {_TRIM('raw_output')} || E'<|im_end|>' AS assistant FROM {_P} WHERE prompt IS NOT NULL AND raw_output IS NOT NULL AND NOT contains(prompt, '<|im') AND NOT contains(raw_output, '<|im')")
def chat_round_trip(spark, d):
    """A chat is rendered and taken apart again."""
    p = preds(spark, d, "prompt", "raw_output").where("prompt IS NOT NULL AND raw_output IS NOT NULL AND NOT contains(prompt, '<|im') AND NOT contains(raw_output, '<|im')")
    whole = p.select("id", C.chat(F.lit("system line"), F.col("prompt"), F.col("raw_output")).alias("t"))
    return whole.select("id", C.user_prompt(F.col("t")).alias("user_prompt"), F.regexp_replace(C.assistant_text(F.col("t")), r"\s*<\|im_end\|>$", C.END).alias("assistant")).withColumn("assistant", F.concat(A.strip(F.regexp_replace("assistant", r"<\|im_end\|>$", "")), F.lit(C.END)))


_SFT = _F("rsp_decision_sft")
_BOX_SQL = lambda c: "coalesce(" + _TRIM(f"regexp_extract_all({c}, '\\\\boxed\\{{([^}}]*)\\}}', 1)[-1]") + ", '')"


@query(f"""SELECT id, CASE WHEN {_BOX_SQL('body')} <> gold THEN rtrim(regexp_replace(body, '\\\\boxed\\{{[^}}]*\\}}', '', 'g'), E' \\t\\n\\r') || chr(10) || '\\boxed{{' || gold || '}}' ELSE body END || '<|im_end|>' AS completion
FROM (SELECT id, rtrim(replace(coalesce(completion, ''), '<|im_end|>', ''), E' \\t\\n\\r') AS body, {_TRIM('final_answer')} AS gold FROM {_SFT} WHERE final_answer IS NOT NULL)""")
def normal_completions(spark, d):
    s = family(spark, d, "rsp_decision_sft", "completion", "final_answer").where("final_answer IS NOT NULL")
    return s.select("id", C.normal_completion(F.col("completion"), F.col("final_answer")).alias("completion"))


_LINE = f"'Final answer: \\boxed{{' || {_TRIM('answer')} || '}}'"


@query(f"""SELECT id, CASE WHEN category = 'bit_manipulation' THEN E'This is a bit-column task. Resolve every output bit with the verified column or gate, do not fall back to decimal numbers, and always finish with an 8-bit boxed answer.\\n' || {_LINE}
WHEN category = 'equation_numeric' THEN concat_ws(chr(10), 'Use the middle input character at position 2 as the operator branch.', 'Keep literal punctuation symbols exactly; do not replace them with internal labels.',
 CASE WHEN NOT regexp_full_match({_TRIM('answer')}, '[-+]?[0-9]+([.][0-9]+)?') THEN 'This target answer is symbolic, so do not use a numeric fallback.' END, CASE WHEN contains(answer, '`') THEN 'The backtick suffix is part of the final answer and must be preserved.' END,
 CASE WHEN regexp_matches({_TRIM('answer')}, '[^\\p{{L}}\\p{{N}}]') THEN 'Do not drop, normalize, or translate punctuation in the boxed answer.' END, {_LINE}) ELSE {_LINE} END AS correction,
 E'S4: APPLY target\\nresult = ' || w || E'\\n</think>\\n\\\\boxed{{' || w || '}}<|im_end|>' AS rejected
FROM (SELECT *, CASE WHEN {_TRIM("coalesce(prediction, '')")} = '' THEN 'NOT_FOUND' ELSE {_TRIM('prediction')} END AS w FROM {_P}) WHERE answer IS NOT NULL AND coalesce(exact_match, 0) = 0""")
def correction_replies(spark, d):
    p = preds(spark, d, "category", "answer", "prediction", "exact_match").where("answer IS NOT NULL AND coalesce(exact_match, 0) = 0")
    return p.select("id", C.correction_reply(F.col("answer"), F.col("category")).alias("correction"), C.rejected_reply(F.col("prediction")).alias("rejected"))


@query(f"""SELECT id, CASE WHEN v1 THEN 'reference_response' WHEN v2 THEN 'raw_output_exact' ELSE 'fallback_boxed_answer' END AS source, CASE WHEN v1 THEN {_fa('reference_response')} WHEN v2 THEN {_fa('raw_output')} ELSE {_TRIM('answer')} END AS extracted
FROM (SELECT *, coalesce(reference_response <> '', false) AND ({_ok('answer', _fa('reference_response'))}) AS v1, coalesce(exact_match, 0) = 1 AND coalesce(raw_output <> '', false) AND ({_ok('answer', _fa('raw_output'))}) AS v2 FROM {_P} WHERE answer IS NOT NULL)""")
def teacher_targets(spark, d):
    p = preds(spark, d, "category", "answer", "reference_response", "raw_output", "exact_match").where("answer IS NOT NULL")
    t = C.teacher_reply(F.col("reference_response"), F.col("raw_output"), F.col("exact_match"), F.col("answer"), F.col("category"))
    return p.select("id", t.alias("t")).select("id", "t.source", "t.extracted")


# ------------------------------------------------------------------ tokens and masks


@query(f"SELECT problem_id, tokens[1:len(tokens) - 1] AS inputs, tokens[2:] AS targets, mask[2:] AS weights FROM {_T} WHERE len(tokens) >= 2 AND len(list_filter(mask[2:], lambda x: x > 0)) > 0")
def shifted_examples(spark, d):
    t = corpus(spark, d)
    i, g, w = T.shifted(F.col("tokens"), F.col("mask"))
    return t.select("problem_id", "tokens", i.alias("inputs"), g.alias("targets"), w.alias("weights")).where(T.trainable(F.col("tokens"), F.col("weights"))).drop("tokens")


@query(f"""SELECT problem_id, CAST(k AS INTEGER) AS prompt_tokens, tokens[k + 1:] AS response, list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN mask[i] > 0 THEN tokens[i] ELSE -100 END) AS labels, list_transform(list_filter(range(1, len(tokens) + 1), lambda i: mask[i] <> 0), lambda i: tokens[i]) AS kept
FROM (SELECT *, coalesce(list_min(list_filter(range(1, len(mask) + 1), lambda i: mask[i] > 0)) - 1, len(mask)) AS k FROM {_T})""")
def mask_views(spark, d):
    t = corpus(spark, d)
    m, x = F.col("mask"), F.col("tokens")
    return t.select("problem_id", T.loss_start(m).alias("prompt_tokens"), T.split_at_loss(x, m)[1].alias("response"), T.masked_labels(x, m).alias("labels"), T.kept_tokens(x, m).alias("kept"))


@query(f"SELECT problem_id, len(tokens) > 1024 AS too_long, tokens[1:1024] AS cut, CAST(len(list_filter(mask[1:1024], lambda x: x > 0)) AS INTEGER) AS supervised FROM {_T}")
def length_policy(spark, d):
    t = corpus(spark, d)
    return t.select("problem_id", (F.size("tokens") > 1024).alias("too_long"), T.head(F.col("tokens"), 1024).alias("cut"), F.size(F.filter(T.head(F.col("mask"), 1024), lambda x: x > 0)).alias("supervised"))


@query(f"SELECT count(*) AS items, count(*) FILTER (WHERE len(tokens) <= 1024) AS kept, count(*) FILTER (WHERE len(tokens) > 1024) AS skipped, CAST(max(len(tokens)) AS INTEGER) AS longest FROM {_T}")
def length_stats(spark, d):
    n = F.size("tokens")
    return corpus(spark, d).agg(F.count(F.lit(1)).alias("items"), F.count(F.when(n <= 1024, 1)).alias("kept"), F.count(F.when(n > 1024, 1)).alias("skipped"), F.max(n).alias("longest"))


_WORDS = "list_transform(list_filter(regexp_split_to_array(coalesce({c}, ''), '\\s+'), lambda w: w <> ''), lambda w: CAST(CAST('0x' || md5(w)[1:8] AS BIGINT) % 50000 AS BIGINT))"


@query(f"""SELECT id, CAST(len(p) + len(c) AS INTEGER) AS total_tokens, CAST(len(c) AS INTEGER) AS loss_tokens, (p || c)[1:256] AS input_ids, (list_transform(p, lambda x: -100::BIGINT) || c)[1:256] AS labels
FROM (SELECT id, {_WORDS.replace('{c}', 'prompt')} AS p, {_WORDS.replace('{c}', 'completion')} AS c FROM {_SFT} WHERE prompt IS NOT NULL)""")
def sft_records(spark, d):
    s = family(spark, d, "rsp_decision_sft", "prompt", "completion").where("prompt IS NOT NULL").select("id", T.word_tokens(F.col("prompt")).alias("p"), T.word_tokens(F.col("completion")).alias("c"))
    return s.select("id", (F.size("p") + F.size("c")).alias("total_tokens"), F.size("c").alias("loss_tokens"), T.sft_record(F.col("p"), F.col("c"), 256).alias("r")).select("id", "total_tokens", "loss_tokens", "r.input_ids", "r.labels")


@query(f"""SELECT id, CAST(len(list_filter((list_transform(p, lambda x: 0) || list_transform(c, lambda x: 1))[1:256], lambda x: x = 1)) AS INTEGER) AS chosen_loss, CAST(len(list_filter((list_transform(p, lambda x: 0) || list_transform(r, lambda x: 1))[1:256], lambda x: x = 1)) AS INTEGER) AS rejected_loss
FROM (SELECT id, {_WORDS.replace('{c}', 'prompt')} AS p, {_WORDS.replace('{c}', 'chosen')} AS c, {_WORDS.replace('{c}', 'rejected')} AS r FROM {_F('rsp_decision_preferences')}) WHERE chosen_loss > 0 AND rejected_loss > 0""")
def preference_records(spark, d):
    w = T.word_tokens
    p = family(spark, d, "rsp_decision_preferences", "prompt", "chosen", "rejected").select("id", w(F.col("prompt")).alias("p"), w(F.col("chosen")).alias("c"), w(F.col("rejected")).alias("r"))
    both = p.select("id", T.sft_record(F.col("p"), F.col("c"), 256)["loss_tokens"].alias("chosen_loss"), T.sft_record(F.col("p"), F.col("r"), 256)["loss_tokens"].alias("rejected_loss"))
    return both.where("chosen_loss > 0 AND rejected_loss > 0")


# Fixed value: the longest sequence of the contract. The four queries above cut to shorter prefixes, those below to this.
LONGEST = 8192


@query(SQL["length_policy"].replace("1024", str(LONGEST)))
def contract_length_policy(spark, d):
    t = corpus(spark, d)
    return t.select("problem_id", (F.size("tokens") > LONGEST).alias("too_long"), T.head(F.col("tokens"), LONGEST).alias("cut"), F.size(F.filter(T.head(F.col("mask"), LONGEST), lambda x: x > 0)).alias("supervised"))


@query(SQL["length_stats"].replace("1024", str(LONGEST)))
def contract_length_stats(spark, d):
    n = F.size("tokens")
    return corpus(spark, d).agg(F.count(F.lit(1)).alias("items"), F.count(F.when(n <= LONGEST, 1)).alias("kept"), F.count(F.when(n > LONGEST, 1)).alias("skipped"), F.max(n).alias("longest"))


@query(SQL["sft_records"].replace("256", str(LONGEST)))
def contract_sft_records(spark, d):
    s = family(spark, d, "rsp_decision_sft", "prompt", "completion").where("prompt IS NOT NULL").select("id", T.word_tokens(F.col("prompt")).alias("p"), T.word_tokens(F.col("completion")).alias("c"))
    return s.select("id", (F.size("p") + F.size("c")).alias("total_tokens"), F.size("c").alias("loss_tokens"), T.sft_record(F.col("p"), F.col("c"), LONGEST).alias("r")).select("id", "total_tokens", "loss_tokens", "r.input_ids", "r.labels")


@query(SQL["preference_records"].replace("256", str(LONGEST)))
def contract_preference_records(spark, d):
    w = T.word_tokens
    p = family(spark, d, "rsp_decision_preferences", "prompt", "chosen", "rejected").select("id", w(F.col("prompt")).alias("p"), w(F.col("chosen")).alias("c"), w(F.col("rejected")).alias("r"))
    both = p.select("id", T.sft_record(F.col("p"), F.col("c"), LONGEST)["loss_tokens"].alias("chosen_loss"), T.sft_record(F.col("p"), F.col("r"), LONGEST)["loss_tokens"].alias("rejected_loss"))
    return both.where("chosen_loss > 0 AND rejected_loss > 0")


@query(f"""WITH t AS (SELECT problem_id, tokens, tokens[2:4] AS w FROM {_T}), p AS (SELECT problem_id, w, unnest(tokens) AS x, unnest(range(len(tokens))) AS i FROM t),
n AS (SELECT problem_id, w, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY problem_id ORDER BY i)),
f AS (SELECT problem_id, min(i) AS i FROM n WHERE len(w) > 0 AND x = w[1] AND (len(w) < 2 OR y = w[2]) AND (len(w) < 3 OR z = w[3]) GROUP BY 1)
SELECT problem_id, CAST(coalesce(f.i, -1) AS INTEGER) AS at FROM t LEFT JOIN f USING (problem_id)""")
def token_positions(spark, d):
    """Every item: where its second to fourth token first stand. Items of two or three tokens look
    for the ones they have behind the first; those of fewer have nothing to look for and give -1."""
    return corpus(spark, d).select("problem_id", T.find(F.col("tokens"), F.slice("tokens", 2, 3)).alias("at"))


_HEAD = r"regexp_extract(completion, '(?s)^(.*)\\boxed\{', 1)"


@query(f"""SELECT id, list_transform(range(n), lambda i: CASE WHEN boxed AND i >= k THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END) AS weights
FROM (SELECT id, coalesce(contains(completion, '\\boxed{{'), false) AS boxed, len({_WORDS.replace('{c}', 'completion')}) AS n, len({_WORDS.replace('{c}', _HEAD)}) AS k FROM {_SFT})""")
def boxed_tail_weights(spark, d):
    """Token weights of every completion: 3 from its last boxed marker on, 1 before it or without one."""
    return family(spark, d, "rsp_decision_sft", "completion").select("id", T.boxed_tail(F.col("completion"), T.word_tokens, 3.0).alias("weights"))


@query(f"""SELECT problem_id, batch_id, list_transform(range(1, CAST(ceil(m / 8.0) * 8 AS BIGINT) + 1), lambda i: coalesce(tokens[i], 0)) AS tokens FROM (SELECT problem_id, batch_id, tokens, max(len(tokens)) OVER (PARTITION BY batch_id) AS m FROM (SELECT problem_id, tokens, CAST((row_number() OVER (ORDER BY problem_id) - 1) // 16 AS BIGINT) AS batch_id FROM {_T}))""")
def padded_batches(spark, d):
    b = O.batched(corpus(spark, d).select("problem_id", "tokens"), ["problem_id"], 16)
    return O.padded_batches(b, "batch_id", {"tokens": 0}, 8).select("problem_id", "batch_id", "tokens")


@query(f"""SELECT coalesce(category, 'unknown') AS category, count(*) AS n, CAST(sum(len(tokens)) AS BIGINT) AS total, CAST(max(len(tokens)) AS BIGINT) AS largest, {', '.join(f"CAST(list_sort(list(len(tokens)))[least(count(*), CAST(floor(count(*) * {p}) AS BIGINT) + 1)] AS BIGINT) AS p{round(p * 100)}" for p in (0.5, 0.9, 0.99))} FROM {_T} GROUP BY 1""")
def length_quantiles(spark, d):
    t = corpus(spark, d).select(F.coalesce("category", F.lit("unknown")).alias("category"), F.size("tokens").cast("bigint").alias("len"))
    return M.floor_quantiles(t, "len", ["category"], [0.5, 0.9, 0.99])


@query(f"""SELECT task, count(*) AS examples, CAST(sum(len(tokens)) AS BIGINT) AS tokens, sum(coalesce(list_sum(mask), 0.0)) AS weight, CAST(min(len(tokens)) AS INTEGER) AS shortest, CAST(max(len(tokens)) AS INTEGER) AS longest, CAST(grouping(task) AS BIGINT) AS level FROM (SELECT *, CASE WHEN category = 'bit_manipulation' THEN 'bit' ELSE 'rest' END AS task FROM {_T}) GROUP BY GROUPING SETS ((task), ())""")
def task_totals(spark, d):
    t = corpus(spark, d).withColumn("task", F.when(F.col("category") == "bit_manipulation", "bit").otherwise("rest"))
    w = F.aggregate("mask", F.lit(0.0), lambda s, x: s + x)
    n = F.size("tokens")
    return t.groupingSets([[F.col("task")], []], "task").agg(F.count(F.lit(1)).alias("examples"), F.sum(n).alias("tokens"), F.sum(w).alias("weight"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.grouping_id("task").cast("bigint").alias("level"))


@query(f"""SELECT task, list_sort(list(struct_pack(category := category, n := n))) AS counts FROM (SELECT CASE WHEN category = 'bit_manipulation' THEN 'bit' ELSE 'rest' END AS task, coalesce(category, 'unknown') AS category, count(*) AS n FROM {_T} GROUP BY 1, 2) GROUP BY 1""")
def task_categories(spark, d):
    t = corpus(spark, d).withColumn("task", F.when(F.col("category") == "bit_manipulation", "bit").otherwise("rest"))
    return M.nested_counts(t, "task", "category")


@query("SELECT problem_id, sum(total_loss) / greatest(CAST(sum(num_loss_tokens) AS DOUBLE), 1.0) AS token_mean, count(*) AS n FROM token_index WHERE total_loss IS NOT NULL AND NOT isnan(total_loss) AND num_loss_tokens IS NOT NULL GROUP BY problem_id".replace("sum(total_loss) /", "round(sum(total_loss) /").replace("1.0) AS", "1.0), 6) AS"))
def loss_means(spark, d):
    t = table(spark, d, "token_index").where("total_loss IS NOT NULL AND NOT isnan(total_loss) AND num_loss_tokens IS NOT NULL")
    mean = M.weighted_mean(F.col("total_loss") / F.nullif("num_loss_tokens", F.lit(0)), F.col("num_loss_tokens"))
    exact = F.sum("total_loss") / F.greatest(F.sum("num_loss_tokens").cast("double"), F.lit(1.0))
    return t.groupBy("problem_id").agg(F.round(F.when(F.min("num_loss_tokens") > 0, mean).otherwise(exact), 6).alias("token_mean"), F.count(F.lit(1)).alias("n"))


@query("SELECT id, round(ln(1 + exp(-abs(m))) + greatest(-m, 0.0), 9) AS loss FROM (SELECT id, 2.0 * (len(coalesce(chosen, '')) - len(coalesce(rejected, ''))) / 100.0 - 0.5 AS m FROM " + _F("rsp_decision_preferences") + ")")
def preference_losses(spark, d):
    """The margin objective, with lengths in place of log-probabilities."""
    n = lambda c: F.length(F.coalesce(c, F.lit(""))) / 100.0
    return family(spark, d, "rsp_decision_preferences", "chosen", "rejected").select("id", F.round(M.margin_loss(n("chosen"), n("rejected"), 2.0, 0.5), 9).alias("loss"))


# ------------------------------------------------------------------ order, samples, sets


@query(f"SELECT id, category FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws('|', '42', id)), id) AS rn FROM {_P}) WHERE rn <= 20")
def sampled_per_category(spark, d):
    return O.sample_per_group(preds(spark, d, "category").select("id", "category"), "category", "id", 20, 42).select("id", "category")


@query(f"SELECT category, list_sort(list(id)) AS ids FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id) AS rn FROM {_P}) WHERE rn <= 5 GROUP BY category")
def first_ids(spark, d):
    f = O.top_per_group(preds(spark, d, "category").select("id", "category"), ["category"], ["id"], 5)
    return f.groupBy("category").agg(F.array_sort(F.collect_list("id")).alias("ids"))


@query("SELECT problem_id, max_by(segment, (epoch, step, segment)) AS segment, min((epoch, step, segment)).epoch AS first_epoch FROM (SELECT problem_id, epoch, step, segment FROM token_index) GROUP BY problem_id".replace("max_by(segment, (epoch, step, segment))", "arg_max(segment, struct_pack(epoch := epoch, step := step, segment := segment))").replace("min((epoch, step, segment)).epoch", "min(epoch)"))
def last_index_rows(spark, d):
    t = table(spark, d, "token_index").select("problem_id", "epoch", "step", "segment")
    return O.last_wins(t, "problem_id", ["epoch", "step", "segment"], ["problem_id", "segment"]).select("problem_id", "segment", F.col("first_pos.epoch").alias("first_epoch"))


@query(f"SELECT i.problem_id, i.pos, CAST(len(t.tokens) AS INTEGER) AS n FROM (SELECT problem_id, min(step) AS pos FROM token_index WHERE coalesce(epoch, 0) = 0 GROUP BY 1) i JOIN {_T} t USING (problem_id)")
def replay_order(spark, d):
    first = table(spark, d, "token_index").where("coalesce(epoch, 0) = 0 AND problem_id IS NOT NULL").groupBy("problem_id").agg(F.min("step").alias("pos"))
    return first.join(corpus(spark, d), "problem_id").select("problem_id", "pos", F.size("tokens").alias("n"))


@query(f"SELECT i.problem_id, i.epoch, i.step, i.segment, coalesce(t.category, '') AS category FROM {_I} i JOIN {_T} t USING (problem_id)")
def index_join(spark, d):
    return index(spark, d).drop("category").join(corpus(spark, d), "problem_id").select("problem_id", "epoch", "step", "segment", F.coalesce("category", F.lit("")).alias("category"))


@query(f"SELECT t.problem_id, coalesce(i.segment, '') AS segment FROM {_T} t LEFT JOIN (SELECT problem_id, min(segment) AS segment FROM token_index GROUP BY 1) i USING (problem_id)")
def corpus_with_metadata(spark, d):
    meta = table(spark, d, "token_index").groupBy("problem_id").agg(F.min("segment").alias("segment"))
    return J.looked_up(corpus(spark, d).select("problem_id"), meta, "problem_id", ["segment"])


@query(f"SELECT id, problem_id FROM {_P} p WHERE problem_id IN (SELECT source_id FROM rsp_decision_sft) AND coalesce(exact_match, 0) = 0")
def wrong_known_problems(spark, d):
    known = table(spark, d, "rsp_decision_sft").select(F.col("source_id").alias("problem_id")).where("problem_id IS NOT NULL")
    return preds(spark, d, "problem_id", "exact_match").where("coalesce(exact_match, 0) = 0").join(known.distinct(), "problem_id", "left_semi").select("id", "problem_id")


@query(f"SELECT id FROM {_P} p WHERE problem_id IS NOT NULL AND problem_id NOT IN (SELECT source_id FROM rsp_decision_sft WHERE source_id IS NOT NULL)")
def unseen_problems(spark, d):
    used = table(spark, d, "rsp_decision_sft").select(F.col("source_id").alias("problem_id")).where("problem_id IS NOT NULL")
    return J.unused(preds(spark, d, "problem_id").where("problem_id IS NOT NULL"), used, "problem_id").select("id")


@query(f"SELECT id, CAST(unnest(range(6)) AS INTEGER) AS repeat_index FROM {_P} WHERE category = 'equation_numeric' AND coalesce(exact_match, 0) = 0")
def oversampled_wrong(spark, d):
    return O.repeated(preds(spark, d, "category", "exact_match").where("category = 'equation_numeric' AND coalesce(exact_match, 0) = 0").select("id"), 6).select("id", "repeat_index")


@query(f"SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 64 AS BIGINT) AS batch_id, CAST((row_number() OVER (ORDER BY id) - 1) % 64 AS BIGINT) AS batch_pos FROM {_P}")
def batches(spark, d):
    return O.batched(preds(spark, d, "id").select("id"), ["id"], 64).select("id", "batch_id", F.col("batch_pos").cast("bigint").alias("batch_pos"))


@query(f"SELECT problem_id FROM (SELECT problem_id, n, sum(n) OVER (ORDER BY problem_id ROWS UNBOUNDED PRECEDING) - n AS before FROM (SELECT problem_id, len(list_filter(mask, lambda x: x > 0)) AS n FROM {_T})) WHERE before < 50000")
def token_budget(spark, d):
    t = corpus(spark, d).select("problem_id", F.size(F.filter("mask", lambda x: x > 0)).alias("n"))
    return O.within_budget(t, ["problem_id"], "n", 50_000).select("problem_id")


@query("""WITH b AS (SELECT problem_id AS id, row_number() OVER (ORDER BY problem_id) AS rn FROM (SELECT DISTINCT problem_id FROM token_corpus WHERE category = 'bit_manipulation')), a AS (SELECT problem_id AS id, row_number() OVER (ORDER BY problem_id) AS rn FROM (SELECT DISTINCT problem_id FROM token_corpus WHERE category = 'cryptarithm'))
SELECT id, rn AS place, 0 AS is_aux FROM b UNION ALL SELECT id, rn * ((SELECT count(*) FROM b) // (SELECT count(*) FROM a)) AS place, 1 AS is_aux FROM a""")
def interleaved_replay(spark, d):
    t = table(spark, d, "token_corpus").select(F.col("problem_id").alias("id"), "category").distinct()
    pick = lambda c: t.where(F.col("category") == c).select("id").distinct()
    return O.interleaved(pick("bit_manipulation"), pick("cryptarithm"), ["id"])


@query(f"""SELECT category, batch_id, id FROM (SELECT s.category, s.slot // 4 AS batch_id, r.id FROM (SELECT category, n, unnest(range(12)) AS slot FROM (SELECT category, count(*) AS n FROM {_P} WHERE category IS NOT NULL GROUP BY 1)) s JOIN (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY id) - 1 AS at FROM {_P}) r ON r.category = s.category AND r.at = s.slot % s.n)""")
def cyclic_batches(spark, d):
    return O.cyclic(preds(spark, d, "category").where("category IS NOT NULL").select("id", "category"), "category", ["id"], 4, 3).select("category", "batch_id", "id")


@query("SELECT s AS step, list_transform(range(3), lambda i: ['bit', 'cipher', 'gravity', 'rest'][CAST((s + i) % 4 AS INTEGER) + 1]) AS active FROM (SELECT unnest(range(12)) AS s)")
def active_tasks(spark, d):
    return O.active_groups(["gravity", "rest", "cipher", "bit"], 3, spark.range(12).select(F.col("id").alias("step")))


@query(f"SELECT id FROM (SELECT DISTINCT id FROM rsp_anchor_sft) ORDER BY md5(concat_ws('|', '43', id)), id LIMIT 500")
def seeded_draw(spark, d):
    return O.draw(table(spark, d, "rsp_anchor_sft").select("id").distinct(), "id", 500, 43)


@query(f"""WITH r AS (SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5(concat_ws('|', '7', id)), id) AS rn, dense_rank() OVER (ORDER BY domain) AS g FROM (SELECT id, {_folded('domain')} AS domain FROM {_F('rsp_anchor_sft')} WHERE id <> '')), n AS (SELECT max(g) AS n FROM r)
SELECT id, domain FROM r, n WHERE rn <= 101 // n + CAST(g <= 101 % n AS INTEGER)""")
def stratified_domains(spark, d):
    """101 rows in equal parts per domain: the whole table, spellings folded, null as `unknown`."""
    t = family(spark, d, "rsp_anchor_sft", "domain").select("id", folded(F.col("domain"), G.DOMAINS).alias("domain"))
    return O.stratified(t, "domain", "id", 101, 7).select("id", "domain")


@query(f"""SELECT id, mix_group FROM (SELECT id, mix_group, row_number() OVER (PARTITION BY mix_group ORDER BY md5(concat_ws('|', '42', id)), id) AS rn FROM (SELECT id, CASE WHEN category = 'equation_numeric' AND coalesce(exact_match, 0) = 0 THEN 'targeted_equation_fix' WHEN category = 'equation_numeric' THEN 'equation_replay_correct' WHEN category = 'bit_manipulation' THEN 'bit_replay' ELSE 'other_category_replay' END AS mix_group FROM {_P}))
WHERE rn <= CASE mix_group WHEN 'targeted_equation_fix' THEN 64 WHEN 'equation_replay_correct' THEN 26 WHEN 'bit_replay' THEN 26 ELSE 12 END""")
def guarded_mix(spark, d):
    """Quotas by rounded shares of 128 rows; the remainder goes to the other categories."""
    total, share = 128, {"targeted_equation_fix": 0.5, "equation_replay_correct": 0.2, "bit_replay": 0.2}
    quota = {k: round(total * v) for k, v in share.items()}
    quota["other_category_replay"] = max(0, total - sum(quota.values()))
    eq = F.col("category") == "equation_numeric"
    group = F.when(eq & (F.coalesce("exact_match", F.lit(0)) == 0), "targeted_equation_fix").when(eq, "equation_replay_correct").when(F.col("category") == "bit_manipulation", "bit_replay").otherwise("other_category_replay")
    ranked = O.top_per_group(preds(spark, d, "category", "exact_match").select("id", group.alias("mix_group")).withColumn("k", O.draw_key(42, "id")), ["mix_group"], ["k", "id"], max(quota.values()))
    return ranked.where(F.col("rn") <= J.mapping(quota)[F.col("mix_group")]).select("id", "mix_group")


# Fixed value: problems that the bit replay always holds.
ANCHORS = ("hk_3302f383", "hk_c095f799-p0")


def replay_mix(p: DataFrame, total: int, anchors: Sequence[str], seed: int) -> DataFrame:
    """(id, mix_group) of predictions: `total` rows by rounded shares, the remainder in equal parts per other category.

    The bit replay begins with the anchor problems in their order, one row each. `total` <= 0 keeps all rows. A group
    with fewer rows than its share gives all it has.
    """
    c = p.select("id", "problem_id", folded(F.col("category"), G.DOMAINS).alias("category"), (F.coalesce("exact_match", F.lit(0)) == 0).alias("bad"))
    c = settle(c, "mix")
    eq, bit = c.where("category = 'equation_numeric'"), c.where("category = 'bit_manipulation'")
    hard, right, other = eq.where("bad"), eq.where("NOT bad"), c.where("category NOT IN ('equation_numeric', 'bit_manipulation')")
    pos = F.array_position(F.array(*[F.lit(a) for a in anchors]).cast("array<string>"), F.col("problem_id"))
    forced = bit.where(pos > 0).groupBy("problem_id").agg(F.min("id").alias("id")).select("id", pos.alias("pos"))
    if total > 0:
        n_hard, n_right, n_bit = round(total * 0.5), round(total * 0.2), round(total * 0.2)
        hard, right = O.draw(hard, "id", n_hard, seed), O.draw(right, "id", n_right, seed)
        bit = O.draw_forced(bit, "id", n_bit, seed, forced)
        other = O.stratified(other, "category", "id", max(0, total - n_hard - n_right - n_bit), seed)
    parts = {"targeted_equation_fix": hard, "equation_replay_correct": right, "other_category_replay": other}
    out = bit.select("id", F.when(pos > 0, "bit_replay_anchor").otherwise("bit_replay").alias("mix_group"))
    for name, df in parts.items():
        out = out.unionByName(df.select("id", F.lit(name).alias("mix_group")))
    return out


@query(f"""WITH c AS (SELECT id, problem_id, coalesce(exact_match, 0) = 0 AS bad, md5(concat_ws('|', '42', id)) AS k, {_folded('category')} AS category FROM {_P}),
f AS (SELECT min(id) AS id, problem_id FROM c WHERE category = 'bit_manipulation' AND problem_id IN {ANCHORS} GROUP BY 2),
o AS (SELECT *, dense_rank() OVER (ORDER BY category) AS g, row_number() OVER (PARTITION BY category ORDER BY k, id) AS rn FROM c WHERE category NOT IN ('equation_numeric', 'bit_manipulation')), n AS (SELECT max(g) AS n FROM o)
SELECT id, 'targeted_equation_fix' AS mix_group FROM (SELECT * FROM c WHERE category = 'equation_numeric' AND bad ORDER BY k, id LIMIT 64)
UNION ALL SELECT id, 'equation_replay_correct' FROM (SELECT * FROM c WHERE category = 'equation_numeric' AND NOT bad ORDER BY k, id LIMIT 26)
UNION ALL SELECT id, CASE WHEN problem_id IN {ANCHORS} THEN 'bit_replay_anchor' ELSE 'bit_replay' END FROM (SELECT * FROM c WHERE category = 'bit_manipulation' ORDER BY coalesce(list_position({list(ANCHORS)}, CASE WHEN id IN (SELECT id FROM f) THEN problem_id END), 99), k, id LIMIT 26)
UNION ALL SELECT id, 'other_category_replay' FROM o, n WHERE rn <= 12 // n + CAST(g <= 12 % n AS INTEGER)""")
def equal_parts_mix(spark, d):
    """128 rows: hard equations, right equations, bit tasks with their anchors, and the other categories in equal parts."""
    return replay_mix(preds(spark, d, "problem_id", "category", "exact_match"), 128, ANCHORS, 42)


@query("SELECT DISTINCT category FROM token_corpus WHERE category IS NOT NULL EXCEPT SELECT DISTINCT domain FROM rsp_anchor_sft WHERE domain IS NOT NULL UNION ALL SELECT 'all:' || count(DISTINCT category) FROM token_corpus")
def category_sets(spark, d):
    c = table(spark, d, "token_corpus").select("category")
    known = table(spark, d, "rsp_anchor_sft").select(F.col("domain").alias("category"))
    only = c.where("category IS NOT NULL").distinct().join(known, "category", "left_anti")
    return only.union(c.agg(F.concat(F.lit("all:"), F.count_distinct("category").cast("string"))))


@query("SELECT id, 'anchor' AS part FROM (SELECT DISTINCT id FROM rsp_anchor_sft) UNION ALL SELECT id, 'decision' FROM (SELECT DISTINCT id FROM rsp_decision_sft)")
def family_union(spark, d):
    part = lambda t, n: table(spark, d, t).select("id").distinct().withColumn("part", F.lit(n))
    return part("rsp_anchor_sft", "anchor").unionByName(part("rsp_decision_sft", "decision"))


@query(f"SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM {_P} GROUP BY 1")
def source_counts(spark, d):
    return M.counts(preds(spark, d, "source"), "source")


@query(f"SELECT category, count(*) AS n, min(id) AS first_pos FROM {_P} GROUP BY 1")
def most_common_categories(spark, d):
    return M.most_common(preds(spark, d, "category"), "category", "id")


@query("SELECT count(DISTINCT problem_id) AS problems, list_sort(list(DISTINCT segment) FILTER (WHERE segment IS NOT NULL)) AS segments FROM token_index")
def distinct_values(spark, d):
    return table(spark, d, "token_index").agg(F.count_distinct("problem_id").alias("problems"), F.array_sort(F.collect_set("segment")).alias("segments"))


@query(f"SELECT id, lambda AS weight FROM (SELECT DISTINCT id FROM rsp_decision_preferences), (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) t(lambda)".replace("lambda AS weight", "lam AS weight").replace("t(lambda)", "t(lam)"))
def weight_grid(spark, d):
    return J.grid(table(spark, d, "rsp_decision_preferences").select("id").distinct(), [0.05, 0.1, 0.2], "weight")


@query("SELECT id, sample_weight * CASE domain WHEN 'equation_numeric' THEN 1.2 WHEN 'bit_manipulation' THEN 1.1 ELSE 1.0 END AS weight FROM " + _F("rsp_anchor_sft") + " WHERE sample_weight IS NOT NULL")
def domain_weights(spark, d):
    m = J.mapping({"equation_numeric": 1.2, "bit_manipulation": 1.1})
    return family(spark, d, "rsp_anchor_sft", "domain", "sample_weight").where("sample_weight IS NOT NULL").select("id", (F.col("sample_weight") * F.coalesce(F.try_element_at(m, F.col("domain")), F.lit(1.0))).alias("weight"))


@query("SELECT e.id AS step, 0.001 * (1 - e.id / 10.0) AS rate FROM (SELECT unnest(range(10)) AS id) e")
def learning_rates(spark, d):
    return spark.range(10).select(F.col("id").alias("step"), M.linear_decay(0.001, F.col("id"), 10).alias("rate"))


# ------------------------------------------------------------------ gates

_FAM = {"anchor_sft": "rsp_anchor_sft", "decision_sft": "rsp_decision_sft", "decision_preferences": "rsp_decision_preferences"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS family, count(DISTINCT id) AS rows, CAST({G.LEAST_ROWS[k]} AS BIGINT) AS least, count(DISTINCT id) >= {G.LEAST_ROWS[k]} AS passed FROM {t}" for k, t in _FAM.items()))
def row_count_gate(spark, d):
    return G.count_gate({k: table(spark, d, t) for k, t in _FAM.items()})


@query("SELECT p AS preferences, a AS anchors, CAST(p AS DOUBLE) / a AS ratio, CAST(p AS DOUBLE) / a <= 0.35 AS passed FROM (SELECT (SELECT count(DISTINCT id) FROM rsp_decision_preferences) AS p, (SELECT count(DISTINCT id) FROM rsp_anchor_sft) AS a)")
def preference_ratio_gate(spark, d):
    return G.ratio_gate(table(spark, d, "rsp_decision_preferences"), table(spark, d, "rsp_anchor_sft"))


@query("SELECT id, 'decision_sft' AS row_type, f AS field FROM (SELECT id, unnest([" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in G.REQUIRED["decision_sft"]) + f", CASE WHEN domain IS NOT NULL AND domain NOT IN {G.DOMAINS} THEN 'domain' END]) AS f FROM {_SFT}) WHERE f IS NOT NULL")
def contract_violations(spark, d):
    return G.missing_fields(family(spark, d, "rsp_decision_sft"), "decision_sft")


@query(f"SELECT id, {_BOX_SQL('completion')} AS boxed, coalesce(regexp_matches(completion, '\\\\boxed\\{{[^}}]*$'), false) AS malformed, {_BOX_SQL('completion')} <> {_TRIM(chr(99) + 'oalesce(final_answer, $$$$)')} AS mismatch FROM {_SFT} WHERE completion IS NOT NULL")
def terminal_boxes(spark, d):
    s = family(spark, d, "rsp_decision_sft", "completion", "final_answer").where("completion IS NOT NULL")
    return G.answer_mismatch(s).select("id", "boxed", "malformed", "mismatch")


@query(f"SELECT id FROM {_F('rsp_decision_preferences')} WHERE chosen IS NOT NULL AND rejected IS NOT NULL AND {_BOX_SQL('chosen')} = {_BOX_SQL('rejected')}")
def undecided_preferences(spark, d):
    return G.same_outcome(family(spark, d, "rsp_decision_preferences", "chosen", "rejected").where("chosen IS NOT NULL AND rejected IS NOT NULL")).select("id")


@query(f"SELECT id FROM {_SFT} WHERE prompt IS NOT NULL AND split = 'train' AND sha256(regexp_replace(lower(trim(prompt)), '\\s+', ' ', 'g')) IN (SELECT sha256(regexp_replace(lower(trim(prompt)), '\\s+', ' ', 'g')) FROM eval_prediction WHERE prompt IS NOT NULL)")
def eval_prompt_overlap(spark, d):
    return J.prompt_overlap(family(spark, d, "rsp_decision_sft", "prompt", "split").where("prompt IS NOT NULL AND split = 'train'"), table(spark, d, "eval_prediction").where("prompt IS NOT NULL")).select("id")


@query()
def gate_replays(spark, d):
    """Selected gates against the prompts' examples; tested against plain Python."""
    bits = family(spark, d, "rsp_decision_sft", "domain", "prompt", "decision_points").where("lower(domain) = 'bit_manipulation' AND prompt IS NOT NULL AND decision_points IS NOT NULL")
    return G.gate_replay(bits)


@query(f"SELECT count(*) AS findings, list_sort(list(id)[1:0]) || (SELECT list(id ORDER BY id) FROM (SELECT id FROM {_SFT} WHERE completion IS NULL ORDER BY id LIMIT 50)) AS first, count(*) = 0 AS passed FROM {_SFT} WHERE completion IS NULL")
def verdicts(spark, d):
    return G.verdict(family(spark, d, "rsp_decision_sft", "completion").where("completion IS NULL").select("id"), "id")


# ------------------------------------------------------------------ tensors


def _vectors(spark, d):
    return table(spark, d, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / sqrt(greatest(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)), 1e-12) * greatest(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)), 1e-12)), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosines(spark, d):
    v = _vectors(spark, d)
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(L.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


def _grads(spark, d):
    """Pairs of neighbouring vectors as the gradients of two tasks on one tensor."""
    return _vectors(spark, d).select(F.concat(F.lit("t"), F.floor(F.col("vec_id") / 2).cast("string")).alias("name"), F.concat(F.lit("task"), (F.col("vec_id") % 2).cast("string")).alias("task"), F.col("embedding").cast("array<double>").alias("g"))


_PAIR = "(SELECT vec_id // 2 AS k, max(embedding) FILTER (WHERE vec_id % 2 = 0) AS x, max(embedding) FILTER (WHERE vec_id % 2 = 1) AS y FROM embeddings GROUP BY 1)"
_DOT = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


@query(f"SELECT 't' || CAST(k AS BIGINT) AS name, round({_DOT('x', 'y')}, 6) AS dot, {_DOT('x', 'y')} < 0 AS conflict FROM {_PAIR} WHERE x IS NOT NULL AND y IS NOT NULL")
def gradient_conflicts(spark, d):
    g = _grads(spark, d)
    p = L.project_conflicts(g, ["task0", "task1"]).groupBy("name").agg(F.max("conflicts").alias("c"), F.max("pairs").alias("n"))
    both = g.where("task = 'task0'").select("name", F.col("g").alias("x")).join(g.where("task = 'task1'").select("name", F.col("g").alias("y")), "name").join(p, "name")
    return both.select("name", F.round(L.dot(F.col("x"), F.col("y")), 6).alias("dot"), (F.col("c") > 0).alias("conflict"))


@query()
def combined_gradients(spark, d):
    return L.combined(L.project_conflicts(_grads(spark, d), ["task0", "task1"]), 2)


@query("SELECT label, round(sum(x * x) / count(*), 9) AS fisher_mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label")
def fisher_by_label(spark, d):
    g = _vectors(spark, d).select(F.col("label").cast("string").alias("name"), "label", F.col("embedding").alias("g"))
    f = L.squared_mean(g)
    keys = g.select("name", "label").distinct()
    return f.groupBy("name").agg(F.round(F.avg("fisher"), 9).alias("fisher_mean")).join(keys, "name").select("label", "fisher_mean")


@query(f"SELECT round(sum(d) / greatest(sum(n), 1), 9) AS penalty FROM (SELECT list_sum(list_transform(range(1, len(x) + 1), lambda i: power(x[i]::DOUBLE - y[i]::DOUBLE, 2))) AS d, len(x) AS n FROM {_PAIR} WHERE x IS NOT NULL AND y IS NOT NULL)")
def anchored_penalty(spark, d):
    g = _grads(spark, d)
    ones = g.where("task = 'task0'").select("name", F.transform("g", lambda _: F.lit(1.0)).alias("g"))
    return L.squared_pull(g.where("task = 'task0'"), g.where("task = 'task1'"), ones).select(F.round("penalty", 9).alias("penalty"))


_NAMES = ["model.layers.%d.self_attn.q_proj", "model.layers.%d.mixer.in_proj", "model.layers.%d.mlp.up_proj", "model.layers.%d.experts.w1", "model.embed_tokens%d", "model.norm%d"]


def _modules(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("bigint").alias("dim"))
    name = F.format_string("%s", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("vec_id") % 6 + 1).cast("int")))
    return e.select(F.replace(name, F.lit("%d"), F.col("vec_id").cast("string")).alias("name"), F.array("dim", F.lit(2).cast("bigint")).alias("shape"))


_KIND = "CASE vec_id % 6 WHEN 0 THEN 'attention' WHEN 1 THEN 'mamba_or_ssm' WHEN 2 THEN 'ffn_or_mlp' WHEN 3 THEN 'moe_or_expert' WHEN 4 THEN 'embedding' ELSE 'other_linear' END"


@query(f"SELECT {_KIND} AS kind, count(*) AS modules, CAST(sum(len(embedding) * 2) AS BIGINT) AS parameters, {_KIND} <> 'embedding' AS tunable, max(len(embedding) || 'x2') AS shape FROM embeddings GROUP BY 1, 4")
def module_inventory(spark, d):
    m = _modules(spark, d).withColumn("kind", AD.module_kind(F.col("name"))).withColumn("tunable", AD.tunable(F.col("kind"), AD.leaf(F.col("name"))))
    return m.groupBy("kind", "tunable").agg(F.count(F.lit(1)).alias("modules"), F.sum(M.product(F.col("shape"))).alias("parameters"), F.max(AD.shape_text(F.col("shape"))).alias("shape"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 6 = 0 THEN 0.05 WHEN vec_id % 6 = 2 THEN 0.02 WHEN vec_id % 6 IN (1, 3) THEN 0.03 ELSE 1.0 END::DOUBLE AS scale FROM embeddings")
def module_scales(spark, d):
    m = _modules(spark, d).withColumn("id", F.regexp_extract("name", r"(\d+)(?:\.|$)", 1).cast("bigint"))
    s = J.scale_of(m, [("layers", 0.03), ("self_attn.q_proj", 0.05), ("mlp.up_proj", 0.02)], 1.0)
    return s.select("id", "scale")


@query("SELECT 'base.' || vec_id AS prefix, vec_id % 5 <> 0 AS paired FROM embeddings")
def tensor_pairing(spark, d):
    v = table(spark, d, "embeddings").select("vec_id")
    t = v.select(F.format_string("base.%d.lora_A.weight", "vec_id").alias("name")).union(v.where("vec_id % 5 <> 0").select(F.format_string("base.%d.lora_B.weight", "vec_id")))
    return J.tensor_pairs(t).select("prefix", F.col("b").isNotNull().alias("paired"))


@query("SELECT 'k' || vec_id AS name, CASE WHEN vec_id % 3 = 2 THEN NULL ELSE 'm' || vec_id END AS target FROM embeddings")
def renamed_tensors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id")
    keys = v.select(F.format_string("k%d", "vec_id").alias("name"))
    model = v.where("vec_id % 3 <> 2").select(F.format_string("m%d", "vec_id").alias("name"))
    return J.renamed_match(keys, model, [("x", "y"), ("k", "m")]).select("name", "target")


# ------------------------------------------------------------------ files and reports


@query(f"SELECT coalesce(source, 'unknown') || ': ' || count(*) AS line FROM {_P} GROUP BY source")
def report_text(spark, d):
    return IO.report_lines(preds(spark, d, "source"), "source")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS rows, map_from_entries(list(struct_pack(k := k, v := n) ORDER BY k)) AS counts, 'eval' AS name FROM (SELECT coalesce(category, 'unknown') AS k, count(*) AS n FROM {_P} GROUP BY 1)")
def manifest(spark, d):
    return IO.manifest(preds(spark, d, "category"), "category", name="eval")


@query(f"SELECT id, sha256(prompt) AS digest, CAST(length(prompt) AS INTEGER) AS chars FROM {_P} WHERE prompt IS NOT NULL")
def content_digests(spark, d):
    return preds(spark, d, "prompt").where("prompt IS NOT NULL").select("id", F.sha2("prompt", 256).alias("digest"), F.length("prompt").alias("chars"))
