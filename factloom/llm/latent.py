"""Operator 2: benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of three blocks of 16 words, one for each block. A
randomised singular value decomposition of the passages' TF-IDF matrix, restricted to
the words of the benchmark, gives a latent space: two passes over the passages multiply
a block of random vectors by the matrix and its transpose, each task summing its own
share. Items and passages are compared by cosine in that space, with the axes divided by
the roots of the singular values. Windows that share as many words of weight with an item as any match
needs are candidates whatever their cosine. Candidates are checked on the words: the longest common
subsequence of item and text and, for paraphrases, of the item's answer (a column, or
its last sentence) and the text.

The benchmark is worked off in blocks of ITEMS items, the only part of it that driver
and tasks hold; the text of the documents is read once for each block, and everything
after runs on word numbers (0 for words outside the benchmark). Words in more than a
thousandth of the blocks are common and carry no weight. Items that this leaves few words
are looked at again: what counts is how often a word stands outside their own copies, so
an item in a third of all documents keeps its words, and the rule for what is a match.
Such items are searched in a space whose axes aren't scaled, so what is frequent isn't
lost. Items of words that are common elsewhere, too, have a space where all words count.

Defined results: a null or empty text, or item, matches nothing; words are lower-cased
in A-Z and cut at white space and ASCII punctuation; repeated rows are reported each,
as are rows without a key (null). Other columns are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm import batches, words
from factloom.llm.sums import merged
from factloom.session import materialize

ITEMS = 2048
BLOCK, BLOCKS = 16, 3
RANK, EXTRA = 128, 16
#: Words in more than this share of the blocks are common and carry no weight. Items with fewer than
#: LEAST_CONTENT other words are searched in a space of their own, spanned by so many of each one's rarest.
COMMON, RAREST = 0.001, 12
#: Words in so many blocks at most are never common.
FEW = 50
LEAST_COSINE, LEAST_COSINE_COMMON = 0.4, 0.6
#: Shares of an item's words of weight, in order, that make a copy; and a paraphrase, if the answer's are there too.
COPY, PARAPHRASE, ANSWER = 0.6, 0.4, 0.75
#: With fewer words that aren't common outside the item's copies, all words of an item count, and this share makes a copy.
LEAST_CONTENT, PLAIN_COPY = 6, 0.8
#: Words of an answer that isn't given: a shorter last sentence is extended to the left.
LEAST_ANSWER = 6


class Benchmark:
    """Items of one block: their words as numbers from 1, and their answers' words."""

    def __init__(self, rows: list[tuple]):
        texts, answers = [r[1] or "" for r in rows], [r[2] for r in rows]
        hashed = [words.of_text(t, words.BARE) for t in texts]
        self.ids = [r[0] for r in rows]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
        self.items = [self.numbers(h) for h in hashed]
        last = [a if a else re.split(r"[.!?\n]+\s*", t.strip(" .!?\n"))[-1] for t, a in zip(texts, answers)]
        self.answers = [self.numbers(words.of_text(t, words.BARE)) for t in last]
        for k, (item, given) in enumerate(zip(self.items, answers)):
            if not given and len(self.answers[k]) < LEAST_ANSWER:
                self.answers[k] = item[-LEAST_ANSWER:]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def masks(item: np.ndarray) -> dict[int, int]:
    """The positions of each word of an item as bits."""
    out: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        if w:
            out[w] = out.get(w, 0) | 1 << k
    return out


def common_subsequence(item: dict[int, int], text: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    row = 0
    for w in text:
        if m := item.get(w):
            x = row | m
            row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


class _Blocks:
    """Blocks of a batch of documents: occurrences of weighted words and the block of each."""

    def __init__(self, docs: list[np.ndarray], weight: np.ndarray):
        counts = np.array([max(1, -(-len(d) // BLOCK)) for d in docs])
        self.first = np.concatenate(([0], np.cumsum(counts)))  # of each document
        word = np.concatenate(docs).astype(np.int64)
        length = np.array([len(d) for d in docs])
        inside = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
        block = np.repeat(self.first[:-1], length) + inside // BLOCK
        held = weight[word] > 0
        self.word, self.block = word[held], block[held]
        self.doc = np.repeat(np.arange(len(docs)), counts)

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        """For each block, the sum of its words' vectors."""
        out = np.zeros((self.first[-1], vectors.shape[1]), np.float32)
        if len(self.block):
            at = np.flatnonzero(np.concatenate(([True], self.block[1:] != self.block[:-1])))
            out[self.block[at]] = np.add.reduceat(vectors[self.word], at, axis=0)
        return out

    def passages(self, blocks: np.ndarray) -> np.ndarray:
        """For each block, the sum over the passage that begins with it and ends within its document."""
        out = blocks.copy()
        for k in range(1, BLOCKS):
            same = self.doc[k:] == self.doc[:-k]
            out[:-k][same] += blocks[k:][same]
        return out

    def back(self, passages: np.ndarray) -> np.ndarray:
        """For each block, the sum over the passages that it is in."""
        out = passages.copy()
        for k in range(1, BLOCKS):
            same = self.doc[k:] == self.doc[:-k]
            out[k:][same] += passages[:-k][same]
        return out

    def add_transposed(self, passages: np.ndarray, out: np.ndarray) -> None:
        """Add each word's sum of what its occurrences' passages have."""
        if len(self.word):
            blocks = self.back(passages)
            order = np.argsort(self.word, kind="stable")
            word = self.word[order]
            at = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[word[at]] += np.add.reduceat(blocks[self.block[order]], at, axis=0)


def _numbered(docs: DataFrame, bench: Benchmark, dtype: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(bench)  # at most ITEMS items

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for _, word, ends in words.of_texts(batches.texts(batch, "text"), words.BARE):
                number = shared.value.numbers(word).astype(dtype)
                rows += [x.tobytes() for x in np.split(number, ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.binary())], names=["id", "words"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, words binary")


def _rows(batch: pa.RecordBatch, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in batch.column("words").to_pylist()]


def _total(numbered: DataFrame, shape: tuple[int, ...], add) -> np.ndarray:
    """The sum of an array that every task fills by ``add(batch, array)``."""

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in it:
            add(batch, total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["values"])

    return merged(numbered.mapInArrow(fill, "values binary"), int(np.prod(shape))).reshape(shape)


def word_counts(numbered: DataFrame, n_words: int, dtype: str) -> np.ndarray:
    """The number of blocks, and of blocks with each word."""

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        blocks = _Blocks(_rows(batch, dtype), np.ones(n_words + 1))
        held = blocks.word > 0
        seen = np.unique(blocks.block[held] * (n_words + 1) + blocks.word[held]) % (n_words + 1)
        total += np.bincount(seen, minlength=n_words + 1)
        total[0] += blocks.first[-1]

    return _total(numbered, (n_words + 1,), add)


def weights(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies of words over blocks, and which words aren't common."""
    n, df = counts[0], counts.copy()
    df[0] = n
    rare = df <= max(COMMON * n, FEW)
    rare[0] = False
    return np.maximum(np.log((1 + n) / (1 + df)), 0.1), rare


def outside_copies(numbered: DataFrame, bench: Benchmark, held: list[int], counts: np.ndarray, dtype: str) -> np.ndarray:
    """``counts`` without the blocks where a word stands in a copy of one of the held items that have it.

    A copy is a block that has half a block's words (or half of a shorter item's) in the item's order, with
    the blocks beside it.
    """
    held = [k for k in held if len(bench.items[k]) >= LEAST_CONTENT]
    if not held:
        return counts
    shared = numbered.sparkSession.sparkContext.broadcast([bench.items[k] for k in held])

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        used = np.zeros(len(total), np.float32)
        used[np.concatenate(shared.value)] = 1
        blocks = _Blocks(_rows(batch, dtype), used)
        inside = [np.zeros(0, np.int64)]
        edges = np.searchsorted(blocks.block, np.arange(blocks.first[-1] + 1))
        for at in range(0, len(shared.value), 128):
            items = shared.value[at : at + 128]
            has = np.zeros((len(total), len(items)), np.float32)
            for k, item in enumerate(items):
                has[item, k] = 1
            least = np.array([min(BLOCK, len(i)) / 2 for i in items])
            near = blocks.sums(has) >= least
            for k in np.flatnonzero(near.any(axis=0)).tolist():
                known = masks(items[k])
                for b in np.flatnonzero(near[:, k]).tolist():
                    if common_subsequence(known, blocks.word[edges[b] : edges[b + 1]].tolist()) >= least[k]:
                        d = blocks.doc[b]
                        a, z = max(b - 1, blocks.first[d]), min(b + 2, blocks.first[d + 1])
                        rows = slice(edges[a], edges[z])
                        own = has[blocks.word[rows], k] > 0
                        inside.append(blocks.block[rows][own] * len(total) + blocks.word[rows][own])
        total += np.bincount(np.unique(np.concatenate(inside)) % len(total), minlength=len(total))

    return counts - _total(numbered, counts.shape, add)


def groups(bench: Benchmark, counts: np.ndarray, recounted) -> Iterator[tuple[list[int], np.ndarray, bool, bool]]:
    """(items, word weights, whether all words count, whether axes are scaled): the searches that a block of items needs.

    ``recounted`` gives the counts outside copies of the items that have few rare words.
    """
    idf, rare = weights(counts)
    content = [int(rare[i].sum()) for i in bench.items]
    first = [k for k, c in enumerate(content) if c >= LEAST_CONTENT]
    second = [k for k, c in enumerate(content) if c < LEAST_CONTENT and len(bench.items[k])]
    if first:
        yield first, np.where(rare, idf, 0.0), False, True
    if second:
        own_idf, own_rare = weights(recounted(second))
        repeated = [k for k in second if own_rare[bench.items[k]].sum() >= LEAST_CONTENT]
        if repeated:
            held = np.zeros(len(counts), bool)
            held[np.concatenate([bench.items[k] for k in repeated])] = True
            yield repeated, np.where(held & own_rare, own_idf, 0.0), False, False
        plain = [k for k in second if own_rare[bench.items[k]].sum() < LEAST_CONTENT]
        if plain:
            held = np.zeros(len(counts), bool)
            for k in plain:
                held[sorted(set(bench.items[k].tolist()), key=lambda w: (counts[w], w))[:RAREST]] = True
            yield plain, np.where(held, idf, 0.0), True, False


def latent_space(numbered: DataFrame, weight: np.ndarray, dtype: str, scaled: bool, seed: int = 2) -> np.ndarray:
    """(words, rank) vectors of words: right singular vectors by weight, divided by the roots of the singular values or not."""
    context = numbered.sparkSession.sparkContext
    size = (len(weight), min(RANK + EXTRA, len(weight)))
    basis = np.random.default_rng(seed).standard_normal(size)
    for _ in range(2):
        basis, _ = np.linalg.qr(basis)
        vectors = context.broadcast((basis * weight[:, None]).astype(np.float32))
        held = context.broadcast(weight)

        def add(batch: pa.RecordBatch, total: np.ndarray, vectors=vectors, held=held) -> None:
            blocks = _Blocks(_rows(batch, dtype), held.value)
            blocks.add_transposed(blocks.passages(blocks.sums(vectors.value)), total)

        image = _total(numbered, size, add) * weight[:, None]  # AᵀA basis
        last, basis = basis, image
    square, turn = np.linalg.eigh(last.T @ image)
    best = np.argsort(-square)[: min(RANK, size[1])]
    best = best[square[best] > 1e-5 * max(square.max(), 1e-300)]  # sums are of single precision
    vectors = last @ turn[:, best] * weight[:, None]
    return (vectors / square[best] ** 0.25 if scaled else vectors).astype(np.float32)


class Search:
    """What a task needs to find the items of a block: their latent vectors and their words that carry weight."""

    def __init__(self, bench: Benchmark, held: list[int], vectors: np.ndarray, weight: np.ndarray, plain: bool):
        self.vectors, self.weight, self.plain = vectors, weight, plain
        self.ids = [bench.ids[k] for k in held]
        whole, answers = [bench.items[k] for k in held], [bench.answers[k] for k in held]
        items = whole if plain else [i[weight[i] > 0] for i in whole]
        answers = [a if plain or not (weight[a] > 0).any() else a[weight[a] > 0] for a in answers]
        self.sizes, self.spans = [len(i) for i in items], [len(i) for i in whole]
        self.masks, self.answers = [masks(i) for i in items], [(masks(a), len(a)) for a in answers]
        self.least = LEAST_COSINE_COMMON if plain else LEAST_COSINE
        queries = np.stack([vectors[i].sum(axis=0) for i in whole])
        norms = np.linalg.norm(queries, axis=1)
        if not plain:  # the items of each word, and how many shared words a window of so many blocks needs
            pairs = np.unique(np.concatenate([np.stack([i, np.full(len(i), k)]) for k, i in enumerate(items)], axis=1), axis=1)
            self.of_word, self.from_word = pairs[1], np.searchsorted(pairs[0], np.arange(len(weight) + 1))
            self.need = np.array([max(1, int(np.ceil(PARAPHRASE * n - 1e-9))) for n in self.sizes])
            self.blocks = np.array([BLOCKS + 2 + n // BLOCK for n in self.spans])
        self.unit = np.where(norms[:, None] > 0, queries / np.maximum(norms, 1e-30)[:, None], 0).T.copy()

    def check(self, i: int, text: np.ndarray) -> tuple[float, float] | None:
        """Shares of item i and of its answer that the text has in order, if they make a match."""
        known, n = self.masks[i], self.sizes[i]
        text = [w for w in (text if self.plain else text[self.weight[text] > 0]).tolist() if w in known]
        copy, paraphrase = (PLAIN_COPY, PLAIN_COPY) if self.plain else (COPY, PARAPHRASE)
        if not n or len(text) < paraphrase * n:
            return None
        share = common_subsequence(known, text) / n
        if share < paraphrase:
            return None
        mask, m = self.answers[i]
        answer = common_subsequence(mask, text) / max(1, m)
        return (share, answer) if share >= copy or answer >= ANSWER else None

    def sharing(self, blocks: _Blocks) -> Iterator[tuple[int, int]]:
        """(block, item): where windows begin that share with an item as many words of weight as a match needs."""
        if self.plain or not len(blocks.word):
            return
        first = self.from_word[blocks.word]
        times = self.from_word[blocks.word + 1] - first
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item, block = self.of_word[np.repeat(first, times) + inside], np.repeat(blocks.block, times)
        order = np.argsort(item, kind="stable")
        item, block = item[order], block[order]
        at = np.arange(len(item))
        last = at + self.need[item] - 1
        at, last = at[last < len(item)], last[last < len(item)]
        enough = (item[at] == item[last]) & (blocks.doc[block[at]] == blocks.doc[block[last]]) & (block[last] - block[at] < self.blocks[item[at]])
        yield from dict.fromkeys(zip(block[at[enough]].tolist(), item[at[enough]].tolist()))

    def found(self, docs: list[np.ndarray]) -> Iterator[tuple]:
        """(document, item, cosine, share of item, share of answer, first word): the best match of each pair."""
        blocks = _Blocks(docs, self.weight)
        latent = blocks.passages(blocks.sums(self.vectors))
        size = np.linalg.norm(latent, axis=1)
        live = np.flatnonzero(size > 0)
        best: dict[tuple[int, int], tuple] = {}
        for row, i in self.sharing(blocks):
            d = int(blocks.doc[row])
            start = (row - int(blocks.first[d])) * BLOCK
            held = self.check(i, docs[d][start : start + (BLOCKS + 2) * BLOCK + self.spans[i]])
            if held:
                rows = np.arange(row, min(row + self.blocks[i], blocks.first[d + 1]))
                cosine = (latent[rows] @ self.unit[:, i] / np.maximum(size[rows], 1e-30)).max()
                new = (held[0], float(cosine), held[1], -start)
                best[d, i] = max(best.get((d, i), new), new)
        for at in range(0, len(live), 2048):
            rows = live[at : at + 2048]
            near = (latent[rows] / size[rows, None]) @ self.unit
            for p, i in zip(*(x.tolist() for x in np.nonzero(near >= self.least))):
                row = int(rows[p])
                d = int(blocks.doc[row])
                start = max(0, row - int(blocks.first[d]) - 1) * BLOCK
                held = self.check(i, docs[d][start : start + (BLOCKS + 2) * BLOCK + self.spans[i]])
                if held:
                    new = (held[0], float(near[p, i]), held[1], -start)
                    best[d, i] = max(best.get((d, i), new), new)
        for (d, i), (share, cosine, answer, start) in best.items():
            yield d, i, cosine, share, answer, -start


def _blocks_of(items: DataFrame) -> Iterator[list[tuple]]:
    rows = (tuple(r) for r in items.toLocalIterator())
    while block := list(islice(rows, ITEMS)):
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """One row for each document and benchmark item found in it.

    Columns: key, item, cosine (latent), item_share and answer_share (words in order), start_word, kind
    (copy or paraphrase).
    """
    spark = batches.ready(docs.sparkSession)
    item_type = benchmark.schema[item].dataType
    schema = f"id {docs.schema[key].dataType.simpleString()}, item {item_type.simpleString()}, cosine double, item_share double, answer_share double, start_word long"
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    items = benchmark.select(item, item_text, F.col(answer) if answer else F.lit(None).cast("string"))
    parts = []
    for block in _blocks_of(items):
        bench = Benchmark(block)
        n = len(bench.vocabulary)
        if not n:
            continue
        dtype = "<u2" if n < 65_535 else "<u4"
        numbered = materialize(_numbered(docs, bench, dtype), "numbered")
        counts = word_counts(numbered, n, dtype)
        again = lambda held, now=(numbered, bench, counts, dtype): outside_copies(*now[:2], held, *now[2:])
        for held, weight, plain, scaled in groups(bench, counts, again):
            vectors = latent_space(numbered, weight, dtype, scaled)
            shared = spark.sparkContext.broadcast(Search(bench, held, vectors, weight, plain))

            def run(it: Iterator[pa.RecordBatch], shared=shared, dtype=dtype) -> Iterator[pa.RecordBatch]:
                search = shared.value
                for batch in it:
                    found = list(zip(*search.found(_rows(batch, dtype)))) or [()] * 6
                    ids = batch.column("id").take(pa.array([int(d) for d in found[0]], pa.int64()))
                    named = pa.array([search.ids[i] for i in found[1]], to_arrow_type(item_type))
                    numbers = [pa.array(x, pa.float64()) for x in found[2:5]] + [pa.array(found[5], pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [ids, named, *numbers], names=["id", "item", "cosine", "item_share", "answer_share", "start_word"]
                    )

            parts.append(materialize(numbered.mapInArrow(run, schema), "contaminated"))
    if not parts:
        parts = [docs.limit(0).select("id", *[F.lit(None).cast(t).alias(c) for c, t in
                 (x.split() for x in schema.split(", ")[1:])])]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("id").alias(key), F.col("item").alias(item), "cosine", "item_share", "answer_share", "start_word",
        F.when(F.col("item_share") >= COPY, "copy").otherwise("paraphrase").alias("kind"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of docs in which no benchmark item was found, columns unchanged."""
    found = contaminated(docs, benchmark, key, text, **names).select(F.col(key).alias("__found")).distinct()
    return docs.join(found, F.col(key) == F.col("__found"), "left_anti")
