import random

import numpy as np
from pyspark.sql import functions as F

from sievework.llm import abuse as A
from tests.llm.test_abuse import corpus


def tables(spark, texts, labels):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, harmful int")


def copied(df, times):
    return df.crossJoin(df.sparkSession.range(times).withColumnRenamed("id", "k")).withColumn("doc_id", F.col("doc_id") + F.col("k") * 1_000_000).drop("k")


def test_copies_under_other_ids_do_not_change_the_model(spark):
    texts, labels = corpus(random.Random(6), 200)
    # a harmful text that was labelled harmless: four copies of it must not make its wording harmless
    docs, judged = tables(spark, [*texts, "you filthy moron and your zorb of friends."], [*labels, 0])
    once, often = A.labelled(docs, judged), A.labelled(copied(docs, 4), copied(judged, 4))
    assert once == often and len(once[0]) == len(set(texts)) + 1
    a, b = A.learn(docs, judged), A.learn(copied(docs, 4), copied(judged, 4))
    assert a.at.tolist() == b.at.tolist() and a.weight.tolist() == b.weight.tolist() and a.known == b.known


def test_every_shard_is_learned(spark):
    texts, labels = corpus(random.Random(6), 600)
    odd = "qworp your zibble you glarbing snurfle"
    docs, judged = tables(spark, [*texts, f"{odd}. rule 3 beats rule 4 on all slices."], [*labels, 1])
    model = A.learn(docs, judged, shard=200)
    held, truth = corpus(random.Random(9), 300)
    truth = [any(w in t for w in ("moron", "vermin", "legs", "verdammter")) for t in held]
    test = spark.createDataFrame([(i, t, "x") for i, t in enumerate(held)], "doc_id long, text string, source string")
    got = {r.doc_id: r.score >= 0.35 for r in A.score(test, model).collect()}
    assert sum(got[i] == t for i, t in enumerate(truth)) >= 294
    (zibble,) = A.grams(np.array([A.Hashes()["zibble"]], dtype=np.uint64))
    assert zibble in model.at  # only one shard holds it


def test_a_feature_takes_the_mean_of_the_shards_that_saw_it():
    at = lambda *x: np.array(x)
    a = A.Model(at(1, 5), at(2.0, 4.0), 0.5, {2: ["ab"]}, at(1, 5, 7))
    b = A.Model(at(5), at(1.0), -0.5, {2: ["aa", "ab"]}, at(1, 5))
    m = A.merged([a, b])
    assert m.at.tolist() == [1, 5] and m.weight.tolist() == [1.0, 2.5] and m.bias == 0.0 and m.known == {2: ["ab", "aa"]}
