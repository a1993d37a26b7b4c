import html
import json

import pytest
from pyspark.sql import functions as F

from sievework.llm import cutoff as C

SCHEMA = "id string, source string, raw_output string, prediction string"


@pytest.mark.parametrize("text", ["plain", "a&b<c>\"'", "x\ny\r\nz", "ünï 한글", "𝒳 𝒴", ""])
def test_lengths(one, text):
    want = {
        "characters": len(text),
        "utf8_bytes": len(text.encode()),
        "utf16_units": len(text.encode("utf-16-le")) // 2,
        "html_characters": len(html.escape(text)),
        "json_characters": len(json.dumps(text, ensure_ascii=False)) - 2,
        "json_bytes": len(json.dumps(text, ensure_ascii=False).encode()) - 2,
        "crlf_characters": len(text.replace("\r\n", "\n").replace("\n", "\r\n")),
        "words": len(text.split(" ")),
    }
    for k, c in C.lengths(F.col("a")).items():
        if k in want:
            assert one(c, text) == want[k], k


def rows():
    out = []
    for i in range(300):
        body = f"Line {i} holds. " * (i % 30 + 1) + f"So the result is \\boxed{{{1000 + i}}}"
        tail = ["", ".", "\nDone", "\nAll lines match"][i % 4]
        out.append((f"full{i}", f"s{i % 3}", body + tail, str(1000 + i)))
    for i in range(40):
        out.append((f"cut{i}", "limited", ("Every line holds and the rule agrees with it, " * 20 + "word" * 9)[i : i + 400].strip("."), None))
        out.append((f"short{i}", "limited", f"Result: \\boxed{{{i}}}", f"{i}"))
    out += [("mark", "s0", "so it goes [cut]", None), ("escape", "s1", "so it goes \\u00", None), ("token", "s1", "so it goes<|im_", None), ("null", "s1", None, None), ("blank", "s1", "  ", None)]
    out += [("pred", "s2", "x \\boxed{12345}", "123"), ("whole", "s2", "x \\boxed{12345}", "12345"), ("other", "s2", "x \\boxed{12345}", "99"), ("nopred", "s2", "x \\boxed{12345}", "")]
    return [*out, out[0], ("nosource", None, "x \\boxed{1}", "1"), (None, "s1", "cut off he", None)]


def test_detection(spark):
    found, limits = C.detect(spark.createDataFrame(rows(), SCHEMA).withColumn("length", F.lit(1)))
    got = {(r.id, r.field): r.kind for r in found.collect()}
    want = {(f"cut{i}", "raw_output") for i in range(40)} | {("mark", "raw_output"), ("escape", "raw_output"), ("token", "raw_output"), ("pred", "prediction")}
    assert set(got) == want
    assert got["mark", "raw_output"] == "marked" and got["escape", "raw_output"] == "transfer" and got["cut0", "raw_output"] == "field_limit"
    assert [(r.source, r.measure, r.max_length) for r in limits.where("field = 'raw_output'").collect()] == [("limited", "characters", 400)]


def test_report_and_empty(spark):
    r = {(x.source, x.field): x for x in C.report(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert r["limited", "raw_output"].cut == 40 and r["limited", "raw_output"].rate == 0.5 and r["unknown", "raw_output"].cut == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert C.detect(empty)[0].count() == 0 and C.report(empty).count() == 0
