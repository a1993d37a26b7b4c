import pytest
from pyspark.sql import functions as F

from sievework.functions import chat as C
from sievework.functions import tokens as T


def test_turns(one):
    text = "<|im_start|>user\none<|im_end|>\n<|im_start|>user\n two \n<|im_end|>\n<|im_start|>assistant\n ok <|im_end|>"
    assert one(C.user_prompt(F.col("a")), text) == "two"
    assert one(C.user_prompt(F.col("a")), "<|x|> plain ") == "plain"
    assert one(C.user_prompt(F.col("a"), fallback=False), "plain") == ""
    assert one(C.assistant_text(F.col("a")), text) == "ok <|im_end|>"
    assert one(C.assistant_text(F.col("a")), "none") == ""


def test_box_request_once(one):
    first = one(C.with_box_request(F.col("a")), "ask")
    assert one(C.with_box_request(F.col("a")), first) == first


def test_completions(one):
    assert one(C.normal_completion(F.col("a"), F.col("b")), r"x \boxed{1} ", "2") == "x\n\\boxed{2}<|im_end|>"
    assert one(C.normal_completion(F.col("a"), F.col("b")), r"x \boxed{2}<|im_end|>", "2") == "x \\boxed{2}<|im_end|>"
    assert one(C.normal_response(F.col("a")), "<|im_start|>assistant\n<think> go") == "go<|im_end|>"


def test_apply_reply(one):
    ref = "S1: x\nS4: APPLY it\n\\boxed{5}"
    assert one(C.apply_reply(F.col("a"), F.col("b")), ref, "5").startswith("S4: APPLY it")
    assert one(C.apply_reply(F.col("a"), F.col("b")), ref, "6").startswith("S4: APPLY target\nresult = 6")
    assert one(C.guard_reply(F.col("a"), F.col("b")), None, "6").startswith("Final answer: \\boxed{6}")
    assert "NOT_FOUND" in one(C.rejected_reply(F.col("a")), None)


def row(spark, tokens, mask):
    return spark.createDataFrame([(tokens, mask)], "t array<bigint>, m array<double>")


def test_masks(spark):
    t, m = F.col("t"), F.col("m")
    r = row(spark, [5, 6, 7, 8], [0.0, 0.0, 1.0, 0.0]).select(T.loss_start(m).alias("k"), T.masked_labels(t, m).alias("l"), T.kept_tokens(t, m).alias("c"), T.shifted(t, m)[1].alias("g"), T.trainable(t, m).alias("ok")).first()
    assert (r.k, r.l, r.c, r.g, r.ok) == (2, [-100, -100, 7, -100], [7], [6, 7, 8], True)
    r = row(spark, [], []).select(T.loss_start(m).alias("k"), T.shifted(t, m)[0].alias("i"), T.trainable(t, m).alias("ok")).first()
    assert (r.k, r.i, r.ok) == (0, [], False)


def test_find_pad_and_recover(spark):
    t, m = F.col("t"), F.col("m")
    r = row(spark, [1, 2, 1, 2, 3], [1.0]).select(
        T.find(t, F.array(F.lit(2).cast("bigint"), F.lit(3).cast("bigint"))).alias("a"),
        T.find(t, F.array().cast("array<bigint>")).alias("b"),
        T.padded(t, F.lit(5), 0, 8).alias("p"),
        T.recovered_mask([lambda: F.when(F.size(m) == F.size(t), m), lambda: T.span_mask(t, F.lit(3), F.lit(2))], F.lit("x")).alias("r"),
        T.policy_weights(F.slice(t, 1, 2), F.slice(t, 3, 3), 2, 9).alias("w"),
    ).first()
    assert (r.a, r.b, len(r.p), r.r, r.w) == (3, -1, 8, [0, 0, 0, 1, 1], [0.0, 1.0, 1.0])


def test_errors(spark):
    with pytest.raises(Exception, match="length mismatch: id7"):
        row(spark, [1], [1.0, 0.0]).select(T.aligned(F.col("t"), F.col("m"), F.lit("id7"))).collect()
    assert spark.createDataFrame([("[1,2]",)], "r string").select(T.int_list(F.col("r"), "r").alias("x")).first().x == [1, 2]
    with pytest.raises(Exception, match="no list of integers"):
        spark.createDataFrame([('["a"]',)], "r string").select(T.int_list(F.col("r"), "r")).collect()
