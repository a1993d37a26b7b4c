"""P4: defective prompt and response pairs, by labelling functions and an EM label model.

Per defect four noisy labelling functions, each on other evidence (marks, lexicon, letters, script, words shared
with the prompt, length, ending), vote on every value (1 yes, 0 no, - abstain). They may disagree, and a value may
look like several defects. The counts of the vote patterns over all rows go to an expectation-maximization model of
the functions' accuracies, which starts from defects planted into a sample of the values; the cutoffs are validated
on another part of these. A value keeps every label whose posterior passes its cutoff.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.runtime import settle

DEFECTS = ("empty", "copied_question", "refusal", "other_language", "truncated")

# What stands in for a missing answer.
PLACEHOLDERS = ("n/a", "na", "none", "null", "nil", "nan", "tbd", "todo", "unknown", "undefined", "empty", "no response", "no answer", "no output", "placeholder", "missing", "blank", "xxx")

# How an answer is declined, in the corpus languages.
REFUSALS = {
    "en": (
        r"\b(?:can(?:'|’)?t|cannot|can not|won(?:'|’)?t|will not|could not|couldn(?:'|’)?t)\s+(?:be able to\s+)?(?:help|assist|comply|answer|provide|do that|continue|solve|fulfil|engage|discuss|give|support)",
        r"\bunable to (?:help|assist|comply|answer|provide|solve|give)",
        r"\b(?:not able to|not in a position to|not allowed to|not permitted to) (?:help|assist|comply|answer|provide|solve|give|work)",
        r"\b(?:must|have to|need to|i) (?:decline|refuse|pass on)",
        r"\bdeclin(?:e|ed|ing) to (?:answer|respond|help|assist|solve)",
        r"\brather not (?:solve|answer|help|say|do|work)",
        r"\b(?:guidelines|policy|policies|rules i follow) (?:do|does) not (?:allow|permit)",
        r"\bfalls? outside (?:of )?what i (?:may|can)",
        r"\bno (?:answer|solution|result) (?:will|can) be (?:given|provided)",
        r"\b(?:kindly|please) (?:consult|ask) (?:a |an |something |someone )",
    ),
    "ko": (r"도와\s*드릴 수 없", r"답변을? (?:제공|드릴|할)[^.]{0,8} 수 없", r"(?:답변|응답|요청)[^.]{0,12}(?:거절|거부|불가)", r"할 수 없습니다[.!]?\s*$"),
    "de": (r"\b(?:kann|darf|möchte|werde)\b[^.]{0,60}\bnicht\b[^.]{0,20}\b(?:helfen|beantworten|antworten|lösen|bearbeiten)", r"nicht helfen", r"nicht beantworten"),
    "es": (r"\bno (?:puedo|podré|me es posible|estoy autorizad[oa])[^.]{0,20}\b(?:ayudar|responder|contestar|resolver|cumplir)", r"\blo siento, (?:pero )?no\b"),
    "fr": (r"\bne (?:peux|puis|pourrai|suis)[^.]{0,20}\b(?:pas|en mesure)\b[^.]{0,20}\b(?:répondre|aider|résoudre|traiter)", r"\b(?:impossible|refuse) de (?:répondre|vous aider)"),
}

# Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the and that is with for which has so this not to because each one from by it what do does are was will can your here have at be as through on an".split(),
    "de": "der die das und ist ich zu zum für auf mit den ein eine keine keinen also nicht dem aus wird von im sich welche alle zunächst zuerst daher somit gibt es nun an".split(),
    "es": "el la los las que de en una un por para con se lo del al es y no esta este sin lo tanto primero vamos a cada esto eso".split(),
    "fr": "le la les des une un est que je pour dans du de et ne pas qui ce sur au aux avec à sans donc ainsi toutes tous nous voyons cela quelle".split(),
}

# Words of regret or courtesy, in the corpus languages.
REGRET = r"\b(?:sorry|apolog\w+|unfortunately|afraid|regret|leider|bedauere?|tut mir leid|entschuldig\w+|lo siento|lamento|lamentablemente|désolée?|navrée?|malheureusement|regrette|i must|i have to|kindly|as an)\b|죄송|유감|미안|안타깝"

# Letters that one of the languages has and most others lack.
LETTERS = {"de": "[äöüß]", "es": "[ñ¿¡áíóú]", "fr": "[èêàçùœâîô]"}

BOX = r"\\boxed\{([^{}]+)\}"


def visible(c: Column) -> Column:
    """The value without markup, special tokens, zero-width characters and blanks."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"<\|[^>]*\|?>|</?[a-zA-Z][^>]*>|```\w*|&nbsp;", "")
    return F.regexp_replace(c, r"[\s\x{00A0}\x{00AD}\x{200B}-\x{200F}\x{2060}\x{3000}\x{FEFF}\x{1160}\x{3164}]+", "")


def text_lines(c: Column) -> Column:
    """Distinct lines in letters, digits and signs only; a leading `Question:` is dropped."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^\s*(?:question|prompt|q|user|task|input|frage|pregunta|질문)\s*[:：]\s*", "")
    return F.array_remove(F.transform(F.split(c, r"\n"), lambda x: F.regexp_replace(x, r"[\s>*`]+", "")), "")


def squashed(c: Column) -> Column:
    return F.array_join(text_lines(c), "")


def results(c: Column) -> Column:
    """Boxed results that are not mere slots such as {...} or {result}."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(BOX), 1)
    return F.filter(found, lambda x: ~F.lower(F.trim(x)).isin("...", "…", "result", "answer", "", "ergebnis", "résultat", "resultado", "결과"))


def language(c: Column) -> Column:
    """en, de, es, fr or ko by distinct function words and script; null if undecided."""
    clean = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), BOX, " ")
    return _let(plain_words(clean), lambda ws: language_of(ws, hangul(clean)))


def hangul(c: Column) -> Column:
    """Whether the text has three Korean syllables or more."""
    return c.rlike(r"(?s)\p{IsHangul}.*\p{IsHangul}.*\p{IsHangul}")


def language_of(words: Column, korean: Column) -> Column:
    """The language of a text's distinct lower-case words; see `language`."""

    def pick(score: Column) -> Column:
        best = F.array_max(score)
        lead = F.filter(score, lambda x: x.n == best.n)
        return F.when((best.n >= 2) & (F.size(lead) == 1), best.k)

    def latin(words: Column) -> Column:
        hits = [F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, ws)))).alias("n"), F.lit(k).alias("k")) for k, ws in FUNCTION_WORDS.items()]
        return _let(F.array(*hits), pick)

    return F.when(korean, "ko").otherwise(latin(words))


def _bit(c: Column) -> Column:
    return F.coalesce(c.cast("int").cast("string"), F.lit("-"))  # c is computed once


def letters(c: Column, korean: Column | None = None) -> Column:
    """The language that the letters of a lower-case text suggest: ko by script, de, es or fr by their own letters, en if all are plain; null without letters."""
    guess = F.when(hangul(c) if korean is None else korean, "ko")
    for k, p in LETTERS.items():
        guess = guess.when(c.rlike(p), k)
    return guess.when(c.rlike("[a-z]{3}"), "en")


def plain_words(c: Column) -> Column:
    """Distinct words of letters of a lower-case text, boxed results left out."""
    return F.array_remove(F.array_distinct(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\boxed\{[^{}]+\}|[^\p{L}]+", " "), " ")), "")


def closing_tokens(values: DataFrame, share: float = 0.5) -> list[str]:
    """Words or commands that stand in the last line of at least `share` of all responses: marks of a reply that
    has come to its end, whatever they are in these rows. At most a few, as a line has few words."""
    last = F.substring_index(F.rtrim("value"), "\n", -1)
    r = values.where("field <> 'final_answer' AND value IS NOT NULL")
    total = r.count()
    each = r.select(F.explode(F.array_distinct(F.regexp_extract_all(last, F.lit(r"\\?\p{L}{2,}"), 0))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    common = {w for ws in FUNCTION_WORDS.values() for w in ws}
    return sorted(r.t for r in each.where(F.col("n") >= share * max(total, 1)).collect() if r.t.lower() not in common)


def votes(values: DataFrame, closing: Sequence[str] = ("\\boxed",)) -> DataFrame:
    """(record_id, field, kind, v) for values(record_id, field, prompt, lang_q, value, reference).

    `reference` is null for a response; for a final answer it is the completion it belongs to. v holds for each
    defect its pattern of votes. Functions that need the prompt, the reference's result or a language abstain
    where there is none.
    """
    base = F.struct(F.coalesce("value", F.lit("")).alias("value"), F.lower(F.coalesce("value", F.lit(""))).alias("low"))
    first = values.where("record_id IS NOT NULL").select("record_id", "field", _let(base, lambda b: _let(_seen(b), lambda s: _let(_facts(s, closing), _patterns))).alias("v"))
    out = first.select("record_id", "field", F.when(F.col("field") == "final_answer", "answer").otherwise("response").alias("kind"), "v")
    return out.groupBy("record_id", "field", "kind").agg(F.min("v").alias("v"))


def _let(facts: Column, body) -> Column:
    """body(facts) with `facts` computed once a row, which a chain of projections would not do."""
    return F.transform(F.array(facts), body)[0]


def _seen(b: Column) -> Column:
    """What the facts are made of: whether the value has results, its visible part, the reference's last result."""
    short = F.col("field") == "final_answer"
    box = F.try_element_at(results(F.col("reference")), F.lit(-1))
    known = F.struct(b.alias("b"), (F.size(results(b.value)) > 0).alias("own"))
    return _let(known, lambda k: F.struct(k.b.value.alias("value"), k.b.low.alias("low"), short.alias("short"), k.own.alias("own"), F.when(k.own, k.b.value).otherwise(visible(k.b.low)).alias("vis"), box.alias("box")))


def _facts(b: Column, closing: Sequence[str]) -> Column:
    """What the labelling functions share: the value, its visible part, results, words, language, ending, reference."""
    short, value, prompt, own, vis, box = b.short, b.value, F.coalesce("prompt", F.lit("")), b.own, b.vis, b.box
    starts = box.startswith(F.trim("value")) & (F.trim("value") != F.trim(box)) & (F.trim("value") != "")
    says = lambda x: F.exists(F.array(*map(F.lit, closing)).cast("array<string>"), lambda t: F.contains(x, t)) if closing else F.lit(False)
    closed = says(value) & F.exists(F.split(value, r"\n"), lambda x: says(x) & ~F.contains(prompt, F.trim(x)))
    end = F.substring_index(F.substring_index(value, "\\boxed{", -1), "}", -1)
    return F.struct(
        value.alias("value"),
        b.low.alias("low"),
        F.col("prompt").alias("prompt"),
        F.col("lang_q").alias("lang_q"),
        F.col("letters_q").alias("letters_q"),
        F.col("words_q").alias("words_q"),
        short.alias("short"),
        vis.alias("vis"),
        F.when(own, F.lit("result")).otherwise(F.regexp_replace(vis, r"^[\[({<\"'.]+|[\])}>\"'.]+$", "")).alias("core"),
        own.alias("own"),
        box.alias("box"),
        (short & F.coalesce(starts, F.lit(False))).alias("starts"),
        F.when(~short, plain_words(b.low)).alias("words"),
        hangul(value).alias("korean"),
        closed.alias("closed"),
        F.rtrim(value).rlike(r"[.!?。！？][\"'”’)\]*`]*$|\\boxed\{[^{}]*\}[\s*$`]*$").alias("stopped"),
        F.when(own & ~short, (F.trim(end) != "") & ~F.rtrim(end).rlike(r"[.!?。！？)\]`*$][\"'”’]*$")).otherwise(F.lit(False)).alias("loose"),
    )


def _patterns(x: Column) -> Column:
    """The vote patterns of all defects, joined by bars. Costly functions look only at values without a result."""
    has_q = x.prompt.isNotNull()
    slots = ("?", "-", "--", "...", "…", "\\boxed{}", "\\boxed{...}", "_")
    stands_in = x.core.isin(*[p.replace(" ", "") for p in PLACEHOLDERS]) | (~x.short & x.core.rlike(r"^[\p{P}\p{S}]*$")) | x.vis.isin(*slots)
    look = has_q & ~x.own & ~x.starts & (F.length(x.vis) >= F.when(x.short, 12).otherwise(8))
    lines, asked, flat = F.array_distinct(text_lines(x.value)), text_lines(x.prompt), squashed(x.value)
    plain = x.low
    said = F.lit(False)
    for patterns in REFUSALS.values():
        said = said | plain.rlike("|".join(f"(?:{p})" for p in patterns))
    shared = F.size(F.array_intersect(x.words, x.words_q)) / F.greatest(F.size(x.words), F.lit(1))
    y = F.struct(
        x.alias("x"),
        (x.vis == "").alias("blank"),
        (stands_in & ~x.starts).alias("stands_in"),
        F.when(look, (F.size(lines) > 0) & (F.size(F.array_except(lines, asked)) == 0)).otherwise(F.lit(False)).alias("all_lines"),
        F.when(look, (flat != "") & F.array_join(asked, "").contains(flat)).otherwise(F.lit(False)).alias("inside"),
        F.when(x.own, F.lit(False)).otherwise(F.coalesce(said, F.lit(False))).alias("declines"),
        F.when(x.own, F.lit(False)).otherwise(plain.rlike(REGRET)).alias("regrets"),
        shared.alias("shared"),
        letters(plain, x.korean).alias("letters"),
        F.when(~x.short, language_of(x.words, x.korean)).alias("lang"),
        F.length(x.vis).alias("n"),
    )

    def bits(y: Column) -> Column:
        x = y.x
        letter = x.vis.rlike(r"[\p{L}\p{N}]")
        digits = x.value.rlike(r"\d")
        some = ~y.blank
        long = F.size(x.words) >= 5
        open_brace = F.length(F.regexp_replace(x.value, r"[^{(\[]+", "")) > F.length(F.regexp_replace(x.value, r"[^})\]]+", ""))
        response = {
            "empty": (y.blank, F.when(some, y.stands_in), ~letter, y.n < 8),
            "copied_question": (F.when(has_q, y.all_lines), F.when(has_q, y.inside), F.when(has_q & long, y.shared >= 0.9), F.when(some, ~x.closed)),
            "refusal": (F.when(some, y.declines), F.when(some, y.regrets), F.when(some, ~digits), F.when(some, ~x.closed & (y.n < 200))),
            "other_language": (F.when(y.lang.isNotNull() & x.lang_q.isNotNull(), y.lang != x.lang_q), F.when(y.letters.isNotNull() & x.letters_q.isNotNull(), (y.letters == "ko") != (x.letters_q == "ko")), F.when(y.letters.isNotNull() & x.letters_q.isNotNull() & long, y.letters != x.letters_q), F.when(long & has_q, y.shared < 0.1)),
            "truncated": (F.when(some, ~x.closed), F.when(some, ~x.stopped), F.when(x.own, x.loose), F.when(some, open_brace)),
        }
        given = x.box.isNotNull() & some
        answer = {
            "empty": (y.blank, F.when(some, y.stands_in), F.when(x.box.isNull(), ~digits).otherwise(~letter & x.box.rlike(r"[\p{L}\p{N}]")), F.when(x.box.isNotNull(), ~x.starts & (F.trim(x.value) != F.trim(x.box)))),
            "copied_question": (F.when(has_q, y.all_lines), F.when(has_q, y.inside), F.when(x.box.isNotNull(), y.n > F.length(x.box) + 10), F.when(some, x.value.rlike(r"\S\s+\S+\s+\S"))),
            "refusal": (y.declines, y.regrets, F.when(some, x.value.contains(" ") & ~digits), F.when(x.box.isNotNull(), y.n > F.length(x.box) + 8)),
            "other_language": (F.lit(None).cast("boolean"),) * 4,
            "truncated": (F.when(given, x.starts), F.when(given, F.length(F.trim(x.value)) < F.length(F.trim(x.box))), F.when(given, F.trim(x.value) != F.trim(x.box)), F.when(given, ~y.stands_in | x.starts)),
        }
        return F.when(x.short, F.concat_ws("|", *[F.concat(*map(_bit, answer[k])) for k in DEFECTS])).otherwise(F.concat_ws("|", *[F.concat(*map(_bit, response[k])) for k in DEFECTS]))

    return _let(y, bits)


# ------------------------------------------------------------------ label model


@dataclass
class Model:
    """Prior of the defect and, for each function, its rates of a yes on defective and on sound values."""

    prior: float
    hit: list[float]
    false: list[float]

    def posterior(self, pattern: str) -> float:
        yes, no = math.log(self.prior), math.log(1 - self.prior)
        for j, x in enumerate(pattern):
            if x != "-":
                yes += math.log(self.hit[j] if x == "1" else 1 - self.hit[j])
                no += math.log(self.false[j] if x == "1" else 1 - self.false[j])
        return 1 / (1 + math.exp(min(700, no - yes)))


#: pattern -> (defective, sound) values of a planted sample
Planted = Mapping[str, tuple[float, float]]


def learn(counts: Mapping[str, int], planted: Planted | None = None, steps: int = 100, weight: float = 0.1) -> Model:
    """EM over conditionally independent functions on the counts of all rows.

    Without planted values it starts from functions that are right 9 times in 10 and a rare defect. Planted
    defects give the start and stay in as `weight` of the rows, whatever their number, so that the label keeps its
    meaning; how the functions vote on sound values is learned from the rows alone. Estimates are smoothed, so that
    none is certain.
    """
    width = len(next(iter(counts))) if counts else 1
    total = sum(counts.values())
    scale = weight * max(total, 1) / max(sum(x[0] for x in (planted or {}).values()), 1e-9)

    def rates(soft: Mapping[str, float], prior: float | None = None) -> Model:
        """The rates with `soft` posteriors of the rows, and the planted defects at their weight."""
        hit, false = [], []
        for j in range(width):
            got = [[0.9, 1.0], [0.02, 1.0]]
            for p, n in counts.items():
                for k, share in enumerate((soft[p], 1 - soft[p])):
                    if p[j] != "-":
                        got[k][0] += n * share * (p[j] == "1")
                        got[k][1] += n * share
            for p, x in (planted or {}).items():
                if p[j] != "-":
                    got[0][0] += x[0] * scale * (p[j] == "1")
                    got[0][1] += x[0] * scale
            hit.append(min(max(got[0][0] / got[0][1], 0.001 if planted else 0.5), 0.9999))
            false.append(max(min(got[1][0] / got[1][1], 0.999 if planted else 0.4), 1e-5))
        mass = sum(n * soft[p] for p, n in counts.items())
        return Model(prior or min(max((mass + 0.5) / (total + 1), 1e-6), 0.5), hit, false)

    if planted:
        # at first a function's votes are taken to be right in four cases of five; the rows then tell
        model = rates(dict.fromkeys(counts, 0.0), 0.02)
        model.false = [max(x / 5, 1e-5) for x in model.false]
    else:
        model = Model(0.05, [0.9] * width, [0.02] * width)
    for _ in range(steps):
        new = rates({p: model.posterior(p) for p in counts})
        still = abs(new.prior - model.prior) < 1e-9
        model = new
        if still:
            break
    return model


def fit(counts: Mapping[str, int], steps: int = 100) -> dict[str, float]:
    """Posterior of the defect for each vote pattern, learned from the counts alone."""
    model = learn(counts, steps=steps)
    return {p: model.posterior(p) for p in counts}


def cutoff(counts: Mapping[str, int], post: Mapping[str, float], low: float = 0.5, high: float = 0.95) -> float:
    """The cutoff in [low, high] of the best expected F1 over all rows, judged by the posteriors themselves."""
    total = sum(n * post[p] for p, n in counts.items())
    return _best(lambda c: [(n, n * post[p]) for p, n in counts.items() if post[p] >= c], total, post.values(), low, high)


def validated(planted: Planted, model: Model, low: float = 0.05, high: float = 0.95) -> tuple[float, float]:
    """The cutoff of the best F1 on planted values that the model has not learned from, and that F1.

    The recall is that of the planted defects. Of the values taken as they are, some have the defect themselves;
    as many as the model's prior and that recall make expect are not counted as false. The middle between the cutoff
    and the next posterior below is taken.
    """
    sides = [sum(x[k] for x in planted.values()) for k in (0, 1)]
    if not min(sides):
        return 0.5, float("nan")
    post = {p: model.posterior(p) for p in planted}
    f1 = {}
    for c in sorted({low, high, *[x for x in post.values() if low < x < high]}):
        true = model.prior * sum(x[0] for p, x in planted.items() if post[p] >= c) / sides[0]
        found = sum(x[1] for p, x in planted.items() if post[p] >= c) / sides[1]
        f1[c] = 2 * true / (max(true, found) + model.prior)
    top = max(f1.values())
    best = max(c for c in f1 if f1[c] >= top - 1e-9)
    return (max([x for x in (low, *post.values()) if x < best], default=best) + best) / 2, top


def _best(kept: Callable[[float], list[tuple[float, float]]], total: float, posts: Iterable[float], low: float, high: float) -> float:
    best = (-1.0, low)
    for c in sorted({low, high, *[x for x in posts if low <= x <= high]}):
        rows = kept(c)
        size, true = sum(n for n, _ in rows), sum(q for _, q in rows)
        f1 = 2 * true / (size + total) if size + total else 0.0
        if f1 > best[0] + 1e-12:
            best = (f1, c)
    return best[1]


# Whole refusals for planting, in the corpus languages.
DECLINES = {
    "en": ("I'm sorry, but I can't help with that request.", "I am unable to provide an answer to this.", "I must decline to answer this question."),
    "ko": ("죄송하지만 이 요청은 도와드릴 수 없습니다.", "이 질문에는 답변을 드릴 수 없습니다."),
    "de": ("Es tut mir leid, dabei kann ich nicht helfen.", "Diese Frage kann ich leider nicht beantworten."),
    "es": ("Lo siento, no puedo ayudar con eso.", "No puedo responder a esta pregunta."),
    "fr": ("Désolé, je ne peux pas répondre à cette demande.", "Je ne peux pas vous aider sur ce point."),
}


def plant(values: DataFrame, most: int = 4000, seed: int = 11) -> DataFrame:
    """A sample of at most `most` values (lowest hash of record and field) as they are and with each defect planted:
    the columns of `values`, `truth` (a defect, or sound) and `part` (learn, validate).

    Blanks and placeholders, the value's beginning, a refusal in the prompt's language, the prompt or half of its
    lines, the response of another row in another language. A final answer's beginning is that of its result.
    """
    # the filter needs the id alone, so it reaches the scan and texts are parsed only for what it keeps
    draw = F.xxhash64(F.lit(seed), "record_id").bitwiseAND(F.lit((1 << 32) - 1))
    near = values.where(draw < F.lit(int(2**32 * min(1.0, 1.2 * most / max(values.count(), 1)))))
    few = settle(near.where("record_id IS NOT NULL AND prompt IS NOT NULL AND value IS NOT NULL").withColumn("k", F.xxhash64(F.lit(seed), "record_id", "field")).orderBy("k", "record_id", "field").limit(most), "planting")
    u = lambda n: F.pmod(F.xxhash64(F.lit(n), "k"), F.lit(1000)) / F.lit(1000.0)
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (u(n) * len(xs)).cast("int") + 1)
    box = F.try_element_at(results(F.coalesce("reference", "value")), F.lit(-1))
    asked = F.split("prompt", r"\n")
    refusals = pick(DECLINES["en"], 5)
    for lang, xs in DECLINES.items():
        refusals = F.when(F.col("lang_q") == lang, pick(xs, 5)).otherwise(refusals)
    short = F.col("field") == "final_answer"
    start = F.when(short, F.when(F.length(box) >= 2, F.substring(box, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(box) * (0.2 + 0.7 * u(2))).cast("int")))).otherwise(None)).otherwise(F.substring("value", F.lit(1), F.greatest(F.lit(8), F.floor(F.length("value") * (0.1 + 0.9 * u(2))).cast("int"))))
    forms = {
        "sound": F.col("value"),
        "empty": pick(["", " ", "\n", "<think></think>", *PLACEHOLDERS, "...", "\\boxed{}"], 1),
        "truncated": start,
        "refusal": refusals,
        "copied_question": F.when(u(3) < 0.5, F.col("prompt")).otherwise(F.array_join(F.slice(asked, 1, F.greatest(F.lit(2), F.floor(F.size(asked) / 2).cast("int"))), "\n")),
    }
    own = [c for c in values.columns if c != "value"]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("truth"), c.alias("value")) for k, c in forms.items()])).alias("x")
    made = few.select(*own, "k", each).select(*own, "k", "x.value", "x.truth").where("value IS NOT NULL")
    answers = few.where(~short & F.col("lang_q").isNotNull())
    ranked = answers.select(*own, "k", "value", F.pmod("k", F.lit(257)).alias("slot"))
    other = ranked.select((F.pmod(F.col("slot") + 1, F.lit(257))).alias("slot"), F.col("value").alias("v"), F.col("lang_q").alias("l"), F.col("k").alias("ok"))
    foreign = ranked.join(other, "slot").where(F.col("l") != F.col("lang_q")).groupBy("k").agg(F.min_by(F.struct(*own, F.col("v").alias("value")), "ok").alias("x")).select(*[f"x.{c}" for c in own], "k", "x.value", F.lit("other_language").alias("truth"))
    part = F.when(F.pmod(F.xxhash64(F.lit(99), "k"), F.lit(2)) == 0, "learn").otherwise("validate")
    out = made.unionByName(foreign).withColumn("part", part)
    return out.withColumn("record_id", F.concat_ws("\x01", "record_id", "truth", "part")).drop("k").select(*values.columns, "truth", "part")


def models(counts: Mapping[tuple[str, str], int], planted: Mapping[tuple[str, str, str, str], int]) -> dict[tuple[str, str], tuple[Model, float, float]]:
    """(kind, defect) -> model, cutoff, validated F1; counts of (kind, votes), planted of (kind, votes, truth, part)."""
    out = {}
    for kind in sorted({k for k, _ in counts}):
        for i, defect in enumerate(DEFECTS):
            rows: Counter[str] = Counter()
            for (k, v), n in counts.items():
                if k == kind:
                    rows[v.split("|")[i]] += n
            parts: dict[str, dict[str, list[float]]] = {"learn": {}, "validate": {}}
            for (k, v, truth, part), n in planted.items():
                # what other defects look like here is left open: only sound values are known not to have this one
                if k == kind and truth in (defect, "sound"):
                    parts[part].setdefault(v.split("|")[i], [0.0, 0.0])[truth == "sound"] += n
            if not any(x[0] for x in parts["learn"].values()):
                # nothing could be planted, as with another language where all prompts are in one
                model = learn(rows)
                out[kind, defect] = model, cutoff(rows, {p: model.posterior(p) for p in rows}), float("nan")
                continue
            model = learn(rows, {p: (x[0], x[1]) for p, x in parts["learn"].items()})
            out[kind, defect] = model, *validated({p: (x[0], x[1]) for p, x in parts["validate"].items()}, model)
    return out


def label(values: DataFrame) -> DataFrame:
    """(record_id, field, defect, posterior, labels): every value with a label; `labels` are all whose posterior
    passes its validated cutoff, in the order of DEFECTS; `defect` is the first of them, as a value that is empty,
    copied or a refusal also looks cut off."""
    closing = closing_tokens(values)
    v = settle(votes(values, closing), "votes")
    seen = {(r.kind, r.v): r.n for r in v.groupBy("kind", "v").agg(F.count(F.lit(1)).alias("n")).collect()}  # patterns, not rows
    sample = plant(values)
    known = votes(sample, closing).withColumn("tag", F.split("record_id", "\x01")).select("kind", "v", F.element_at("tag", -2).alias("truth"), F.element_at("tag", -1).alias("part"))
    planted = {(r.kind, r.v, r.truth, r.part): r.n for r in known.groupBy("kind", "v", "truth", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    fitted = models(seen, planted)
    rows = []
    for kind, pattern in seen:
        kept = []
        for k, p in zip(DEFECTS, pattern.split("|"), strict=True):
            if (kind, k) in fitted and "1" in p:
                model, c, _ = fitted[kind, k]
                if (q := model.posterior(p)) >= c:
                    kept.append((k, round(q, 6)))
        if kept:
            rows.append((kind, pattern, kept[0][0], kept[0][1], [k for k, _ in kept]))
    labels = v.sparkSession.createDataFrame(rows, "kind string, v string, defect string, posterior double, labels array<string>")
    return v.join(F.broadcast(labels), ["kind", "v"]).select("record_id", "field", "defect", "posterior", "labels")


def stacked(df: DataFrame, id_col: str, prompt: str, fields: Sequence[str], reference: Mapping[str, str] | None = None) -> DataFrame:
    """(record_id, field, prompt, lang_q, letters_q, words_q, value, reference): one row a field of every row."""
    reference = reference or {}
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), (F.col(reference[f]) if f in reference else F.lit(None).cast("string")).alias("reference")) for f in fields])
    asked = df.select(F.col(id_col).alias("record_id"), F.col(prompt).alias("prompt"), language(F.col(prompt)).alias("lang_q"), letters(F.lower(prompt)).alias("letters_q"), plain_words(F.lower(prompt)).alias("words_q"), each.alias("each"))
    own = ["record_id", "prompt", "lang_q", "letters_q", "words_q"]
    return asked.select(*own, F.explode("each").alias("x")).select("record_id", "x.field", *own[1:], "x.value", "x.reference")
