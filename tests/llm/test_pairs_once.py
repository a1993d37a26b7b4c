from sievework.llm import pairs as P


def test_results_and_votes_are_computed_once_a_value(spark):
    rows = [("a", "completion", "p", None), ("b", "completion", "f(x) = [1", "t"), ("c", "completion", "f(x) = {1}]", "t"), ("d", "completion", "é [𝒳 (", "t"), ("e", "completion", "", "t"), ("f", "final_answer", "7", "so \\boxed{7}")]
    df = spark.createDataFrame([(i, f, "Find the rule.", "en", "en", ["find", "the", "rule"], v, r) for i, f, v, r in rows], "record_id string, field string, prompt string, lang_q string, letters_q string, words_q array<string>, value string, reference string")
    got = P.votes(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # of the value and of its reference
    assert plan.count("regexp_extract_all") == 2
    # the last vote on a response: more brackets opened than closed
    last = {r.record_id: r.v.split("|")[-1][-1] for r in got.where("field = 'completion'").collect()}
    assert last == {"a": "0", "b": "1", "c": "0", "d": "1", "e": "-"}
