import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import rule_ensemble as rules


def corpus(n=300):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        good = k % 4 != 0
        docs.append((k, " ".join(words) + "." if good else "### ".join(words)))
        labels.append((k, int(good)))
    return docs, labels


def test_held_out_accuracy_and_compiled_rules(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.scores(d, lab).collect()}
    truth = dict(labels)
    assert len(got) == len(docs)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.5)
    wrong = [k for k, r in got.items() if r.held_out and r.predicted != truth[k]]
    assert len(wrong) <= 2
    kept = {r.doc_id for r in rules.keep_good(d, lab).collect()}
    assert kept == {k for k, r in got.items() if r.predicted}


def test_score_equals_a_plain_evaluation(spark):
    docs, labels = corpus(120)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    ensemble, stated = rules.learn(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert ensemble.weights
    for r in stated.withColumn("score", ensemble.score()).collect():
        total = ensemble.constant
        for rule, weight in ensemble.weights.items():
            if all((r[rules.PREFIX + rules.STATISTICS[k]] > at) == above for k, at, above in rule):
                total += weight
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_nulls_and_missing_labels(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "some words here", None), (3, "", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None), (None, 1), (3, 7)], "doc_id long, quality int")
    got = rules.scores(d, none).collect()
    assert len(got) == 4 and {round(r.score, 6) for r in got} == {0.5}
    assert rules.keep_good(d, none).columns == d.columns
    assert rules.scores(d.limit(0), none).count() == 0
    one = spark.createDataFrame([(k, 1) for k in range(5)], "doc_id long, quality int")
    assert rules.scores(d, one).where(F.col("predicted") == 0).count() == 0


def test_window_distinct_covers_the_whole_text():
    at = rules.STATISTICS.index("window_distinct")
    for n, repeated in ((0, 5), (64, 0), (64, 63), (128, 20), (10, 30)):
        words = [f"w{k}" for k in range(n)] + ["same"] * repeated
        windows = [words[k : k + rules.WINDOW] for k in range(0, len(words), rules.WINDOW)]
        assert rules.statistics([" ".join(words)])[0, at] == pytest.approx(sum(len(set(w)) for w in windows) / len(words))
