"""Operator 5: masked pseudo-likelihood by a bidirectional window network.

Every token is predicted from the two before and the two after it. The network, in
numpy, sums a vector for each word and place around the token, and predicts first the
token's class, then the token in its class. A document's score is the sum of the log
probabilities of all its tokens, each with only itself masked.

The counts of all words of all documents are a written table. The network's ids are the
most frequent words, and buckets by hash for the others; their number and the vectors'
width follow the number of distinct words counted (``side``). A rare word's probability
is its bucket's, times the word's own share of the bucket's occurrences: each document's
rare words are joined to their counts. No word of that join has more than one part in
the number of frequent words of all tokens, as each of those is at least as frequent.

All documents train the network: each task runs through its own from common first values,
which start at the words' frequencies, and the results are averaged by tokens. Tasks and
driver hold one network, which grows about as the root of the number of distinct words.

Defined results: a null or empty text has no tokens, a log likelihood of 0 and a null
mean; repeated rows are scored each and weigh as often in training; other columns are
not used; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import batches, words
from factloom.llm.sums import merged
from factloom.session import materialize

#: Classes, and ids of a class, of the smallest network.
CLASSES, OF_CLASS = 32, 32
SIZE = CLASSES * OF_CLASS
#: One id in so many is a bucket of rare words.
BUCKET_PART = 4
#: Low bits of a word's hash that choose its bucket.
BUCKET_BITS = (1 << 40) - 1
PLACES = (-2, -1, 1, 2)
STEP_TOKENS, RATE = 8192, 0.08
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 1 << 20


def side(distinct: int) -> int:
    """Classes, and ids of each, for so many distinct words: ids are about twice the root of the words."""
    return max(CLASSES, 4 * int(np.ceil(np.sqrt(2 * np.sqrt(distinct)) / 4)))


class Vocabulary:
    """Frequent words by hash, buckets for the rest (with their occurrences), and what each id's frequency is."""

    def __init__(self, frequent: list[tuple[int, int]], buckets: dict[int, int], size: int = SIZE):
        self.size, self.buckets = size, size // BUCKET_PART
        self.n_frequent = size - self.buckets
        word = np.array([w for w, _ in frequent], np.int64).view(np.uint64)
        self.order = np.argsort(word)
        self.word = word[self.order]
        count = np.ones(size)  # one more for each, so nothing is impossible
        count[: len(frequent)] += [n for _, n in frequent]
        self.share = np.zeros(size)  # log of a bucket's occurrences, of which a word has its own count
        for b, n in buckets.items():
            count[self.n_frequent + b] += n
            self.share[self.n_frequent + b] = np.log(max(1, n))
        self.log_frequency = np.log(count / count.sum())

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        rare = self.n_frequent + ((hashes & np.uint64(BUCKET_BITS)) % np.uint64(self.buckets)).astype(np.int64)
        if not len(self.word):
            return rare
        at = np.searchsorted(self.word, hashes)
        at[at == len(self.word)] = 0
        return np.where(self.word[at] == hashes, self.order[at], rare)

    def padded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts with padding between, the tokens' places, and each text's number of tokens."""
        return self.framed(texts)[:3]

    def framed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``padded`` gives, and the tokens' hashes."""
        parts, counts, hashes = [np.full(2, self.size)], [], [np.zeros(0, np.uint64)]
        for _, word, ends in words.of_texts(texts):
            hashes.append(word)
            for x in np.split(self.ids(word), ends[:-1]):
                parts += [x, parts[0]]
                counts.append(len(x))
        ids = np.concatenate(parts)
        return ids, np.flatnonzero(ids < self.size), np.array(counts, np.int64), np.concatenate(hashes)

    def rare_words(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
        """For each text, its words without an id of their own and how often each occurs in it."""
        held = ids >= self.n_frequent
        text, word = np.repeat(np.arange(len(counts)), counts)[held], hashes[held]
        order = np.lexsort((word, text))
        text, word = text[order], word[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(word)), bool), (word[1:] != word[:-1]) | (text[1:] != text[:-1]))))
        times = np.diff(np.concatenate((first, [len(word)])))
        ends = np.searchsorted(text[first], np.arange(len(counts) + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(word[first].view(np.int64)), pa.array(times.astype(np.int32))], names=["word", "times"])
        return pa.ListArray.from_arrays(pa.array(ends), pairs)


class Network:
    """Context vectors, class and word outputs, as views of one flat array; ``size`` ids in as many classes as each has."""

    def __init__(self, flat: np.ndarray, size: int = SIZE):
        self.flat = flat.astype(np.float32)
        self.size, self.classes = size, math.isqrt(size)
        self.kind = np.uint16 if size < 1 << 16 else np.uint32
        self.parts, at = [], 0
        for shape in self.shapes(size):
            n = int(np.prod(shape))
            self.parts.append(self.flat[at : at + n].reshape(shape))
            at += n

    @staticmethod
    def shapes(size: int) -> tuple[tuple[int, ...], ...]:
        c = math.isqrt(size)
        width = 8 + c // 4
        return (len(PLACES), size + 1, width), (width,), (width, c), (c,), (c, width, c), (c, c)

    @classmethod
    def length(cls, size: int) -> int:
        return sum(int(np.prod(s)) for s in cls.shapes(size))

    @classmethod
    def first(cls, vocabulary: Vocabulary) -> Network:
        out = cls(np.random.default_rng(5).standard_normal(cls.length(vocabulary.size)) * 0.1, vocabulary.size)
        by_class = vocabulary.log_frequency.reshape(out.classes, out.classes)
        of_class = np.logaddexp.reduce(by_class, axis=1)
        out.parts[1][:] = 0
        out.parts[3][:] = of_class
        out.parts[5][:] = by_class - of_class[:, None]
        out.parts[0][:, out.size] = 0
        return out

    def _hidden(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        context, bias = self.parts[:2]
        total = context[0][ids[at + PLACES[0]]]
        for k in range(1, len(PLACES)):
            total += context[k][ids[at + PLACES[k]]]
        total += bias
        return np.tanh(total, out=total)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=1, keepdims=True)
        return x

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the tokens at these places, each from those around it."""
        out = np.empty(len(at), np.float32)
        _, _, to_class, class_bias, to_word, word_bias = self.parts
        for a in range(0, len(at), 1 << 15):
            rows = at[a : a + (1 << 15)]
            order = np.argsort(ids[rows].astype(self.kind), kind="stable")
            target = ids[rows][order]
            hidden = self._hidden(ids, rows)[order]
            p = self._softmax(hidden @ to_class + class_bias)[np.arange(len(rows)), target // self.classes]
            edge = np.searchsorted(target, np.arange(self.classes + 1) * self.classes)
            for c in range(self.classes):
                i, j = edge[c], edge[c + 1]
                if i < j:
                    q = self._softmax(hidden[i:j] @ to_word[c] + word_bias[c])
                    p[i:j] *= q[np.arange(j - i), target[i:j] - c * self.classes]
            out[a + order] = np.log(np.maximum(p, 1e-30))
        return out

    def gradient(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the mean negative log probability of the tokens at these places."""
        grad = Network(np.zeros(len(self.flat), np.float32), self.size)
        _, _, to_class, class_bias, to_word, word_bias = self.parts
        order = np.argsort(ids[at].astype(self.kind), kind="stable")
        at = at[order]
        target, n = ids[at], len(at)
        hidden = self._hidden(ids, at)
        p = self._softmax(hidden @ to_class + class_bias)
        p[np.arange(n), target // self.classes] -= 1
        p /= n
        grad.parts[2][:] = hidden.T @ p
        grad.parts[3][:] = p.sum(axis=0)
        back = p @ to_class.T
        edge = np.searchsorted(target, np.arange(self.classes + 1) * self.classes)
        for c in range(self.classes):
            i, j = edge[c], edge[c + 1]
            if i < j:
                q = self._softmax(hidden[i:j] @ to_word[c] + word_bias[c])
                q[np.arange(j - i), target[i:j] - c * self.classes] -= 1
                q /= n
                grad.parts[4][c] = hidden[i:j].T @ q
                grad.parts[5][c] = q.sum(axis=0)
                back[i:j] += q @ to_word[c].T
        back *= 1 - hidden * hidden
        grad.parts[1][:] = back.sum(axis=0)
        for k, place in enumerate(PLACES):
            near = ids[at + place]
            by = np.argsort(near.astype(self.kind), kind="stable")
            near = near[by]
            first = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1])))
            grad.parts[0][k][near[first]] = np.add.reduceat(back[by], first, axis=0)
        return grad.flat

    def step(self, grad: np.ndarray, state: np.ndarray) -> None:
        """One step of Adagrad; padding keeps its zero vector."""
        state += grad * grad
        self.flat -= RATE * grad / (np.sqrt(state) + 1e-6)
        self.parts[0][:, self.size] = 0


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(parts: list[np.ndarray]) -> None:
        nonlocal word, count
        new, n = np.unique(np.concatenate(parts), return_counts=True)
        every, back = np.unique(np.concatenate([word, new]), return_inverse=True)
        count = np.bincount(back, np.concatenate([count, n]), len(every)).astype(np.int64)
        word = every

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], names=["word", "n"])

    parts, held = [], 0
    for batch in it:
        for _, w, _ in words.of_texts(batches.texts(batch, "text")):
            parts.append(w)
            held += len(w)
        if held > HELD_WORDS:
            merge(parts)
            parts, held = [], 0
            if len(word) > HELD_WORDS:
                yield passed()
                word, count = word[:0], count[:0]
    if parts:
        merge(parts)
    yield passed()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of all documents, written."""
    return materialize(docs.select("text").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """From the counts of all words; the driver gets a row for each id at most."""
    counts = word_counts(docs) if counts is None else counts
    size = side(counts.count()) ** 2
    n_buckets = size // BUCKET_PART
    frequent = counts.orderBy(F.desc("n"), "word").limit(size - n_buckets).collect()
    bucket = (F.col("word").bitwiseAND(F.lit(BUCKET_BITS)) % n_buckets).alias("bucket")
    buckets = {r.bucket: r.n for r in counts.groupBy(bucket).agg(F.sum("n").alias("n")).collect()}
    for r in frequent:
        buckets[(r.word & BUCKET_BITS) % n_buckets] -= r.n
    return Vocabulary([(r.word, r.n) for r in frequent], buckets, size)


def train(docs: DataFrame, known: Vocabulary) -> Network:
    """A network that all documents have trained, averaged over tasks by tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # a word for each id at most

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, tokens = Network.first(shared.value), 0
        state, rng = np.full(len(network.flat), 1e-4, np.float32), np.random.default_rng(7)
        for batch in it:
            ids, at, _ = shared.value.padded(batches.texts(batch, "text"))
            at = rng.permutation(at)
            for a in range(0, len(at), STEP_TOKENS):
                network.step(network.gradient(ids, at[a : a + STEP_TOKENS]), state)
            tokens += len(at)
        values = np.concatenate([network.flat * float(tokens), [tokens]]).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], names=["values"])

    total = merged(docs.select("text").mapInArrow(run, "values binary"), Network.length(known.size) + 1)
    return Network(total[:-1] / total[-1], known.size) if total[-1] else Network.first(known)


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_tokens, log_likelihood, mean_log_probability."""
    spark = batches.ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counts = word_counts(docs)
    known = vocabulary(docs, counts)
    shared = spark.sparkContext.broadcast((known, train(docs, known).flat))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, flat = shared.value
        network, row = Network(flat, held.size), TaskContext.get().partitionId() << 33
        for batch in it:
            ids, at, sizes, hashes = held.framed(batches.texts(batch, "text"))
            value = np.concatenate([[0.0], np.cumsum(network.log_probabilities(ids, at) - held.share[ids[at]])])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            total = value[ends[1:]] - value[ends[:-1]]
            total[sizes == 0] = 0
            columns = [pa.array(np.arange(row, row + len(sizes))), batch.column("key"), pa.array(sizes), pa.array(total)]
            row += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [*columns, held.rare_words(hashes, ids[at], sizes)], names=["row", "key", "n_tokens", "by_ids", "rare"]
            )

    schema = f"row long, key {kind}, n_tokens long, by_ids double, rare array<struct<word:bigint,times:int>>"
    judged = materialize(docs.mapInArrow(run, schema), "judged")
    rare = judged.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.times").join(counts, "word")
    own = rare.groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("own"))
    out = judged.drop("rare").join(own, "row", "left").select(
        "key", "n_tokens", (F.col("by_ids") + F.coalesce("own", F.lit(0.0))).alias("log_likelihood")
    )
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.withColumn("mean_log_probability", mean).withColumnRenamed("key", key)
