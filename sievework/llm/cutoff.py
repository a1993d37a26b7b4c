"""P6: text values cut by a field limit or in transfer.

Every value's length is taken under several encodings; per source, a pile of values at the
largest length of one of them exposes the limit it was stored with. Then the endings are
inspected: endings that many complete replies share are learned from all rows, and a value
that ends otherwise, in a broken escape or in a mark, is a cut one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.runtime import settle

# Marks that stand for text left out, and the remains of broken transfers.
MARK = r"\s*(?:…|\.\.\.|\[(?:cut|truncated|snip|more|\.\.\.|…)\]|<(?:cut|truncated)>|\((?:cut|truncated)\))\s*$"
BROKEN = "(?:�|\\\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|<\\|[a-z_]*\\|?|&(?:#?[a-zA-Z0-9]{0,6}))$"
BOX = r"\\boxed\{([^{}]+)\}"
STOP = r"[.!?。！？][\"'”’)\]*_]*$"
MEASURES = ("characters", "utf8_bytes", "utf16_units", "html_characters", "html_bytes", "json_characters", "json_bytes", "crlf_characters", "crlf_bytes", "words")


def lengths(c: Column) -> dict[str, Column]:
    """The value's length under each encoding of MEASURES; null for null."""
    chars, bytes_ = F.length(c), F.octet_length(c)
    # the bytes that a sign takes away where it is left out: faster than a regular expression
    count = lambda sign: ((bytes_ - F.octet_length(F.replace(c, F.lit(sign)))) / len(sign)).cast("int")
    html = 4 * count("&") + 3 * (count("<") + count(">")) + 5 * (count('"') + count("'"))
    rare = F.regexp_count(c, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")), F.regexp_count(c, F.lit(r"[\x08\x0c]"))
    json = count('"') + count("\\") + count("\n") + count("\r") + count("\t") + F.when(c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), 5 * rare[0] - 4 * rare[1]).otherwise(0)
    crlf = count("\n") - count("\r\n")
    pairs = F.when(bytes_ > chars, F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))).otherwise(0)
    return dict(zip(MEASURES, (chars, bytes_, chars + pairs, chars + html, bytes_ + html, chars + json, bytes_ + json, chars + crlf, bytes_ + crlf, count(" ") + 1), strict=True))


def boxed(c: Column) -> Column:
    """The last closed, non-empty boxed result, or null."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(BOX), 1), F.lit(-1))


def ending(c: Column) -> Column:
    """The last sentence or line in a comparable form: digits as 9, the boxed result left out. One of more than 300
    characters is given by a digest, so that long ones are learned like any other."""
    last = F.ltrim(F.substring_index(F.rtrim(c), "\n", -1))
    last = F.regexp_replace(last, r"^.*(?<=[.!?。])\s+(?=\S)", "")
    last = F.regexp_replace(F.regexp_replace(last, BOX, "[]"), r"\d+", "9")
    return F.when(F.length(last) > 300, F.concat(F.lit("#"), F.md5(last))).otherwise(last)


def find_limits(spread: DataFrame, least: int = 5, band: float = 0.06) -> DataFrame:
    """(source, measure, max_length, at_limit) for counted lengths(source, measure, length, n, loose): every pile.

    A pile is a length that at least `least` values reach within its last 4 units (2, if it is below 100), which are
    filled more than 3 times as densely as the `band` (a share of the length, 8 units at least) below and above,
    if half of them or more end loosely, and if no pile of the measure within 4 units is higher. A source may have
    several, as fields or exports have their own limits. Measures of which one source's piles hold fewer than half
    as many values as those of its best measure are left out.
    """
    key = Window.partitionBy("source", "measure").orderBy(F.col("length").cast("long"))
    near = key.rangeBetween(-3, 0)
    wide = [F.when(F.col("length") < 100, a).otherwise(b) for a, b in ((2, 4), (1, 3))]
    got = spread.withColumn("l", F.col("length").cast("long"))
    got = got.withColumns({"at4": F.sum("n").over(near), "at2": F.sum("n").over(key.rangeBetween(-1, 0)), "loose4": F.sum("loose").over(near), "loose2": F.sum("loose").over(key.rangeBetween(-1, 0)), "top": F.max("n").over(key.rangeBetween(-4, 4))})
    got = got.withColumns({"at_limit": F.when(F.col("length") < 100, F.col("at2")).otherwise(F.col("at4")), "loose_at": F.when(F.col("length") < 100, F.col("loose2")).otherwise(F.col("loose4"))})
    some = got.where((F.col("at_limit") >= least) & (F.col("loose_at") * 2 >= F.col("at_limit")) & (F.col("n") == F.col("top")))
    width = F.greatest(F.lit(8.0), F.col("p.l") * band)
    a, p = spread.select("source", "measure", F.col("length").alias("ol"), F.col("n").alias("on")).alias("a"), some.select("source", "measure", "l", "at_limit", wide[0].alias("w")).alias("p")
    beside = p.join(a, ["source", "measure"]).where((F.col("ol") > F.col("l") - F.col("w") - width) & (F.col("ol") <= F.col("l") + width)).groupBy("source", "measure", "l", "at_limit", "w", width.alias("width")).agg(F.sum(F.when(F.col("ol") <= F.col("l") - F.col("w"), F.col("on")).otherwise(0)).alias("below"), F.sum(F.when(F.col("ol") > F.col("l"), F.col("on")).otherwise(0)).alias("above"))
    dense = F.col("at_limit") / F.col("w")
    real = beside.where((dense > 3 * F.col("below") / F.col("width")) & (dense > 3 * F.col("above") / F.col("width")))
    rank = F.create_map(*[v for i, m in enumerate(MEASURES) for v in (F.lit(m), F.lit(-i))])
    sums = real.groupBy("source", "measure").agg(F.sum("at_limit").alias("held"))
    best = sums.groupBy("source").agg(F.max("held").alias("most"), F.max_by("measure", F.struct("held", rank[F.col("measure")])).alias("first"))
    kept = sums.join(best, "source").where((F.col("held") * 2 >= F.col("most"))).select("source", "measure", (F.col("measure") == F.col("first")).alias("best"))
    return real.join(kept, ["source", "measure"]).select("source", "measure", F.col("l").alias("max_length"), "at_limit", "best")


def measured(rows: DataFrame) -> DataFrame:
    """(id, source, ...) of every distinct content of an id: lengths without a mark, ending, boxed result, flags.

    Null ids are kept out; a null source is reported as `unknown`; equal deliveries count once, and deliveries that
    differ are judged each.
    """
    raw = F.col("raw_output")
    # marks and broken ends are looked for in the last characters, in the whole value where these are mostly blank
    tail = F.substring(raw, -300, 300)
    tail = F.when(F.length(F.regexp_replace(tail, r"\s+$", "")) >= 40, tail).otherwise(raw)
    first = F.struct(tail.rlike(MARK).alias("marked"), F.rtrim(tail).rlike(BROKEN).alias("broken"), boxed(raw).alias("box"))

    def then(x: Column) -> Column:
        whole = F.when(x.marked, F.regexp_replace(raw, MARK, "")).otherwise(raw)
        after = F.rtrim(F.call_function("substring_index", raw, F.concat(F.lit("\\boxed{"), x.box, F.lit("}")), F.lit(-1)))
        pred = F.col("prediction")
        return F.struct(
            F.array(*lengths(whole).values()).alias("raw_len"),
            F.array(*lengths(F.nullif(F.trim(pred), F.lit(""))).values()).alias("pred_len"),
            (F.trim(F.coalesce(raw, F.lit(""))) == "").alias("raw_none"),
            x.marked.alias("marked"),
            x.broken.alias("broken"),
            x.box.isNotNull().alias("has_box"),
            (x.box.isNotNull() & ((F.trim(after) == "") | after.rlike(STOP))).alias("box_closed"),
            (~F.coalesce(F.substring(F.rtrim(whole), -40, 40).rlike(STOP), F.lit(False))).alias("no_stop"),
            ending(raw).alias("end"),
            (x.box.startswith(pred) & (x.box != pred) & (F.trim(pred) != "")).alias("pred_cut"),
        )

    out = rows.where("id IS NOT NULL").select("id", F.coalesce("source", F.lit("unknown")).alias("source"), F.transform(F.array(first), then)[0].alias("x"))
    return out.select("id", "source", "x.*").distinct()


def spread_of(m: DataFrame, lens: str) -> DataFrame:
    """(source, measure, length, n, loose) of the lengths in column `lens`; loose: the flag of that name, or a cut prediction."""
    each = m.select("source", (F.col("loose") | F.col("pred_cut")).cast("int").alias("loose"), F.posexplode(lens).alias("i", "length")).where("length IS NOT NULL AND length > 0")
    return each.groupBy("source", F.element_at(F.array(*map(F.lit, MEASURES)), F.col("i") + 1).alias("measure"), "length").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("loose", F.lit(0))).alias("loose"))


def whole_endings(m: DataFrame, share: float = 0.0005, least: int = 3) -> list[str]:
    """Endings that complete replies share: at most 1/share texts, hence small enough for a filter list.

    An ending must close at least `share` of all replies (`least` of them), from two sources, mostly
    away from their source's limit, without mark; and it may not be the start of another ending
    that is five times as frequent.
    """
    total = m.count()
    floor = max(least, share * total)
    seen = (
        m.where("end IS NOT NULL AND end <> '' AND NOT marked AND NOT broken")
        .groupBy("end")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.avg(F.col("at_limit").cast("double")).alias("hit"))
        .where((F.col("n") >= floor) & (F.col("sources") >= 2) & (F.col("hit") < 0.5))
        .collect()
    )
    n = {r.end: r.n for r in seen}
    return sorted(e for e in n if not any(o != e and o.startswith(e) and n[o] >= 5 * n[e] for o in n))


def detect(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The findings (id, source, field, kind) and the limits (source, field, measure, max_length, at_limit).

    kind: `marked` (a mark says so), `transfer` (broken escape, character or token at the end),
    `field_limit` (an unfinished end at the source's limit), `unfinished` (an unfinished end
    elsewhere), `prediction` (only the beginning of the boxed result). The limits given are those of the best measure. Null and blank values are
    no cases. Complete replies without box or full stop are known by their ending.
    """
    m = settle(measured(rows), "measured")
    often = whole_endings(m.withColumn("at_limit", F.lit(False)))
    usual = F.coalesce(F.col("end").isin(often), F.lit(False)) if often else F.lit(False)
    m = m.withColumn("loose", F.col("no_stop") & ~F.col("box_closed") & ~usual)
    raw_limits = settle(find_limits(spread_of(m, "raw_len")), "limits")
    pred_limits = find_limits(spread_of(m.where("pred_cut"), "pred_len")).where("best")
    index = F.create_map(*[v for i, x in enumerate(MEASURES) for v in (F.lit(x), F.lit(i))])
    piles = raw_limits.groupBy("source").agg(F.collect_list(F.struct(index[F.col("measure")].alias("i"), "max_length")).alias("piles"))
    width = lambda p: F.when(p.max_length < 100, 2).otherwise(4)
    near = F.exists("piles", lambda p: (F.get(F.col("raw_len"), p.i) > p.max_length - width(p)) & (F.get(F.col("raw_len"), p.i) <= p.max_length))
    known = m.join(piles, "source", "left").withColumn("at_limit", F.coalesce(near, F.lit(False)))
    ends = whole_endings(known)
    fine = F.col("end").isin(ends) if ends else F.lit(False)
    fine = F.coalesce(fine, F.lit(False))
    kind = (
        F.when(F.col("raw_none"), None)
        .when(F.col("marked"), "marked")
        .when(F.col("has_box") & F.col("box_closed"), None)
        .when(F.col("broken"), "transfer")
        .when(fine, None)
        .when(F.col("at_limit"), "field_limit")
        .otherwise("unfinished")
    )
    raw = known.select("id", "source", F.lit("raw_output").alias("field"), kind.alias("kind"))
    raw_limits = raw_limits.where("best")
    pred = m.where("pred_cut").select("id", "source", F.lit("prediction").alias("field"), F.lit("prediction").alias("kind"))
    limits = raw_limits.select("source", F.lit("raw_output").alias("field"), "measure", "max_length", "at_limit").union(pred_limits.select("source", F.lit("prediction"), "measure", "max_length", "at_limit"))
    found = raw.where("kind IS NOT NULL").union(pred)
    return found.groupBy("id", "source", "field").agg(F.min("kind").alias("kind")), limits


def report(rows: DataFrame) -> DataFrame:
    """(source, field, rows, cut, rate, kinds, limit_measure, limit_length, limits) per source and field: the limit of most values, and their number."""
    found, limits = detect(rows)
    total = rows.where("id IS NOT NULL").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.countDistinct("id").alias("rows"))
    kinds = found.groupBy("source", "field", "kind").agg(F.count(F.lit(1)).alias("n"))
    cut = kinds.groupBy("source", "field").agg(F.sum("n").alias("cut"), F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("kinds"))
    fields = total.select("source", "rows", F.explode(F.array(F.lit("raw_output"), F.lit("prediction"))).alias("field"))
    one = limits.groupBy("source", "field").agg(F.max_by(F.struct("measure", "max_length"), F.struct("at_limit", "max_length")).alias("b"), F.count(F.lit(1)).alias("limits")).select("source", "field", "b.*", "limits")
    out = fields.join(cut, ["source", "field"], "left").join(one, ["source", "field"], "left")
    return out.select("source", "field", "rows", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("rows")).alias("rate"), "kinds", F.col("measure").alias("limit_measure"), F.col("max_length").alias("limit_length"), F.coalesce("limits", F.lit(0)).alias("limits"))
