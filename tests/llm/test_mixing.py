from sievework.llm import mixing as X

SCHEMA = "doc_id long, source string, tokens long, weight double"


def run(spark, rows, targets, total=None):
    mix, report = X.mix(spark.createDataFrame(rows, SCHEMA), targets, total)
    return {r.doc_id: r.repeats for r in mix.collect()}, {r.source: r for r in report.collect()}


def test_shares_repeats_and_shortfall(spark):
    rows = [(i, "big", 100, 1.0) for i in range(1000)] + [(2000 + i, "Small", 100, None) for i in range(50)] + [(3000, None, 100, 1.0), (3001, "big", 0, 1.0), (3002, "other thing", 5, 1.0)]
    used, report = run(spark, rows, {"big": (0.6, 1), "small": (0.4, 3)}, total=50_000)
    assert report["big"].tokens == 30_000 and not report["big"].short
    assert report["small"].tokens == 15_000 and report["small"].short
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    assert {used[2000 + i] for i in range(50)} == {3} and not {3000, 3001, 3002} & set(used)


def test_complete_epochs_come_first(spark):
    used, report = run(spark, [(i, "a", 10, 1.0) for i in range(100)], {"a": (1.0, 5)}, total=2500)
    assert sorted(set(used.values())) == [2, 3] and sum(v == 3 for v in used.values()) == 50 and report["a"].tokens == 2500


def test_weights_raise_the_chance(spark):
    used, _ = run(spark, [(i, "a", 10, 8.0 if i % 2 else 0.5) for i in range(2000)], {"a": (1.0, 1)}, total=6000)
    heavy = sum(i % 2 for i in used)
    assert len(used) == 600 and heavy > 500


def test_empty(spark):
    used, report = run(spark, [], {"a": (1.0, 2)})
    assert used == {} and report["a"].short


def test_tokens_are_counted_over_whole_texts(spark):
    long = "word " * 20_000
    got = {r.doc_id: r.tokens for r in X.token_counts(spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, long)], "doc_id long, text string")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 20_000
