"""Operator 9: quality classifier as a sparse rule ensemble.

Statistics of the whole text (shares of kinds of bytes, repetition of words and lines,
lengths) are taken in one pass. A forest of shallow trees is fitted on the labelled
rows; each path from a root to a node is a rule, a conjunction of thresholds. A lasso
logistic regression weights the rules, most of them with zero, and the others are
compiled into one Spark column expression, which scores all documents.

All labelled training rows are used; fitting runs on Spark. Defined results: a null or
empty text has statistics of zero and a score like every other; a label that is null or
neither 0 nor 1 isn't used; several labels of one document count by their mean (a half
is good); without training rows of both kinds every score is the share of good ones, or
0.5 without any; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import batches, words
from factloom.session import materialize

TREES, DEPTH, LEAST_ROWS = 16, 3, 5
LASSO = 0.001
WINDOW = 64
PREFIX = "__stat_"

#: Kinds of bytes whose share of a text is a statistic.
BYTE_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "end": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+<=>@\\^_`{}~[]/",
    "space": b" \t\n\r\x0b\x0c",
    "line": b"\n",
    "other": bytes(range(128, 256)),
}
STATISTICS = [*BYTE_KINDS, "log_words", "word_bytes", "twice_running", "window_distinct", "repeated_lines"]
_KIND = np.zeros((256, len(BYTE_KINDS)))
for _k, _kind in enumerate(BYTE_KINDS.values()):
    _KIND[list(_kind), _k] = 1


def statistics(texts: list[str]) -> np.ndarray:
    """(texts, STATISTICS) values; zero for texts without words."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for first, word, ends in words.of_texts(texts):
        at = 0
        for k, end in enumerate(ends.tolist(), first):
            w, at = word[at:end], end
            if not len(w):
                continue
            raw = np.frombuffer(texts[k].encode("utf-8", "surrogatepass"), np.uint8)
            kinds = np.bincount(raw, minlength=256) @ _KIND / len(raw)
            lines = texts[k].split("\n")
            full = len(w) // WINDOW * WINDOW
            distinct = 0  # of all windows together; the last one may be shorter
            for parts in (w[:full].reshape(-1, WINDOW), w[None, full:]):
                if parts.size:
                    parts = np.sort(parts, axis=1)
                    distinct += (parts[:, 1:] != parts[:, :-1]).sum() + len(parts)
            distinct /= len(w)
            out[k] = [
                *kinds, np.log1p(len(w)), len(raw) * (1 - kinds[6]) / len(w),
                (w[1:] == w[:-1]).mean() if len(w) > 1 else 0.0, distinct, 1 - len(set(lines)) / len(lines),
            ]
    return out


def _names() -> list[str]:
    return [PREFIX + s for s in STATISTICS]


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the statistics of their texts as columns named by PREFIX."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            values = statistics(batches.texts(batch, text))
            yield batches.with_columns(batch, **{n: pa.array(values[:, k]) for k, n in enumerate(_names())})

    return docs.mapInArrow(run, batches.schema_with(docs, **dict.fromkeys(_names(), "double")))


#: A condition is (statistic's number, threshold, whether the value is above it); a rule is a set of them.
Rule = frozenset


def tree_rules(node, path: Rule = Rule()) -> set[Rule]:
    """The conjunctions that lead to the nodes of a fitted tree."""
    found = {path} if path else set()
    if node.numDescendants() > 0:
        split = node.split()
        k, at = split.featureIndex(), split.threshold()
        found |= tree_rules(node.leftChild(), path | {(k, at, False)})
        found |= tree_rules(node.rightChild(), path | {(k, at, True)})
    return found


def holds(rule: Rule) -> Column:
    tests = [
        F.col(_names()[k]) > F.lit(at) if above else F.col(_names()[k]) <= F.lit(at)
        for k, at, above in sorted(rule)
    ]
    return reduce(lambda x, y: x & y, tests)


class Ensemble:
    """Weighted rules; ``score()`` is the compiled column."""

    def __init__(self, constant: float, weights: dict[Rule, float]):
        self.constant, self.weights = constant, weights

    def score(self) -> Column:
        total = F.lit(self.constant)
        for rule, weight in self.weights.items():
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(stated: DataFrame, label: str) -> Ensemble:
    """Fit rules and weights on rows that have statistics and a label of 0 or 1 (double)."""
    n, good = stated.agg(F.count("*"), F.sum(label)).first()
    if not n or good in (0, n):
        share = min(max((good or 0) / n if n else 0.5, 1e-6), 1 - 1e-6)
        return Ensemble(float(np.log(share / (1 - share))), {})
    rows = VectorAssembler(inputCols=_names(), outputCol="__features").transform(stated)
    forest = RandomForestClassifier(
        featuresCol="__features", labelCol=label, numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS,
        featureSubsetStrategy="onethird", seed=9,
    ).fit(rows)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree._java_obj.rootNode())}, key=sorted)
    if not rules:
        return Ensemble(float(np.log(good / (n - good))), {})
    fired = stated.select(
        label, array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("__rules")
    )
    lasso = LogisticRegression(
        featuresCol="__rules", labelCol=label, elasticNetParam=1.0, regParam=LASSO, maxIter=60
    ).fit(fired)
    weights = lasso.coefficients.toArray().tolist()
    return Ensemble(float(lasso.intercept), {r: w for r, w in zip(rules, weights) if w})


def labelled(stated: DataFrame, labels: DataFrame, key: str, quality: str) -> DataFrame:
    """Statistics of the rows with a label, named __label."""
    per_key = (
        labels.where(F.col(quality).isin(0, 1)).groupBy(F.col(key).alias("__key"))
        .agg((F.avg(quality) >= 0.5).cast("double").alias("__label"))
    )
    return stated.join(per_key, F.col(key) == F.col("__key")).select("__label", *_names())


def held_out(key: Column) -> Column:
    """Rows never learned from: crc32 of the key as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> tuple[Ensemble, DataFrame]:
    """An ensemble learned from labelled rows that aren't held out, and all rows' keys and statistics."""
    batches.ready(docs.sparkSession)
    stated = materialize(add_statistics(docs.select(key, text), text).drop(text), "statistics")
    train = labelled(stated.where(~held_out(F.col(key))), labels, key, quality)
    return fit(materialize(train.coalesce(32), "training"), "__label"), stated


def scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """One row per row of docs: key, held_out, score, predicted."""
    ensemble, stated = learn(docs, labels, key, text, quality)
    return stated.select(key, held_out(F.col(key)).alias("held_out"), ensemble.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """The rows of docs whose score is 0.5 or more, columns unchanged."""
    ensemble, _ = learn(docs, labels, key, text, quality)
    return add_statistics(docs, text).where(ensemble.score() >= 0.5).select(*docs.columns)
