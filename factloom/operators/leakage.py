"""Near-duplicate texts between splits, by the ratio of matching blocks.

The ratio of two texts is twice the characters in their matching blocks (the longest block
first, then on either side of it) over the characters of both, as ``difflib`` computes it.
Texts that are equal in lower case are one class, so copies are compared once and counted.

All pairs of classes count, and a ratio of 0.8 leaves matching blocks as short as two
characters, so no index on words or long runs finds them all. Instead classes are packed into
blocks of bounded size by split and length, a block meets only those blocks whose lengths the
ratio allows, and a pair of blocks is one row. Inside, bounds that no matching can beat sort
out nearly all pairs, each over many pairs at once:

1. the lengths; 2. the characters that both hold; 3. the pairs of neighbouring characters that
both must hold; 4. the longest common subsequence, bit-parallel. The exact ratio is computed
for what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.curation import SPLITS
from factloom.session import materialize

#: Ratios from which a pair is a near duplicate, and a borderline case.
NEAR, BORDERLINE = 0.88, 0.80
#: Classes and characters of a block, on average.
BLOCK_TEXTS, BLOCK_CHARS = 512, 1 << 17
#: Characters, and pairs of them, are counted by their remainder: what falls together can only raise a bound.
_CHARS, _PAIRS = 61, 251
#: Pairs of texts that go through the bounds together.
_TOGETHER = 4096


class _Texts:
    """Texts of a block with what the bounds need."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) for t in texts]
        self.length = np.array([len(p) for p in points], np.int64)
        self.code = np.zeros((len(texts), max(1, int(self.length.max(initial=0)))), np.int16)
        self.chars = np.zeros((len(texts), _CHARS), np.int32)
        self.pairs = np.zeros((len(texts), _PAIRS), np.int32)
        for k, p in enumerate(points):
            self.code[k, : len(p)] = p % _CHARS
            self.chars[k] = np.bincount(p % _CHARS, minlength=_CHARS)
            self.pairs[k] = np.bincount((p[:-1] * 31 + p[1:]) % _PAIRS, minlength=_PAIRS)

    def masks(self) -> np.ndarray:
        """(text, character, word): a bit for each place where the character stands."""
        words = -(-self.code.shape[1] // 64)
        out = np.zeros((len(self.texts), _CHARS, words), np.uint64)
        for k, n in enumerate(self.length.tolist()):
            at = np.arange(n)
            np.bitwise_or.at(out[k], (self.code[k, :n], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        return out


def _common(masks: np.ndarray, other: _Texts, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs (i, j); zero bits mark its characters."""
    order = np.argsort(-other.length[j], kind="stable")
    i, j = i[order], j[order]
    words = max(1, -(-int(length[i].max(initial=0)) // 64))
    masks = masks[:, :, :words]
    steps = other.length[j]
    state = np.full((words, len(i)), np.uint64(2**64 - 1))
    for k in range(int(steps.max(initial=0))):
        m = int(np.searchsorted(-steps, -k))  # the pairs whose other text has a character here
        hit = masks[i[:m], other.code[j[:m], k]].T
        carry = np.zeros(m, np.uint64)
        for w in range(words):
            now = state[w, :m]
            met = now & hit[w]
            up = now + met
            total = up + carry
            carry = ((up < now) | (total < up)).astype(np.uint64)
            state[w, :m] = total | (now & ~met)
    size = length[i]
    out = np.zeros(len(i), np.int64)
    for w in range(words):
        inside = np.clip(size - 64 * w, 0, 64)
        kept = np.where(inside == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(inside, 63).astype(np.uint64)) - np.uint64(1))
        out += np.bitwise_count(~state[w] & kept)
    back = np.empty_like(out)
    back[order] = out
    return back


def similar(left: list[str], right: list[str], least: float) -> list[tuple[int, int, float]]:
    """All (i, j, ratio) of left and right texts with a ratio of at least ``least``."""
    a, b = _Texts(left), _Texts(right)
    both = a.length[:, None] + b.length
    needed = least / 2 * both - 1e-9  # characters in matching blocks
    fits = np.minimum(a.length[:, None], b.length) >= needed
    shared = np.zeros(both.shape, np.int32)
    for c in range(_CHARS):
        if a.chars[:, c].any() and b.chars[:, c].any():
            shared += np.minimum(a.chars[:, c, None], b.chars[:, c])
    i, j = np.nonzero(fits & (shared >= needed))
    masks, out, matcher = None, [], SequenceMatcher()
    for at in range(0, len(i), _TOGETHER):
        x, y = i[at : at + _TOGETHER], j[at : at + _TOGETHER]
        # blocks are parted by characters outside them, so there are at most (those outside) + 1
        held = np.minimum(a.pairs[x], b.pairs[y]).sum(axis=1) >= 3 * needed[x, y] - both[x, y] - 1
        x, y = x[held], y[held]
        if not len(x):
            continue
        masks = a.masks() if masks is None else masks
        held = _common(masks, b, x, y, a.length) >= needed[x, y]
        for p, q in sorted(zip(y[held].tolist(), x[held].tolist())):
            if matcher.b is not right[p]:
                matcher.set_seq2(right[p])
            matcher.set_seq1(left[q])
            ratio = matcher.ratio()
            if ratio >= least:
                out.append((q, p, ratio))
    return sorted(out)


_RESULT = "split_a string, split_b string, a string, b string, copies_a long, copies_b long, ratio double"


def _matched(it: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _RESULT.split(", ")]
    for batch in it:
        for k in range(batch.num_rows):
            split_a, split_b = (batch.column(c)[k].as_py() for c in ("split_a", "split_b"))
            left, right = (batch.column(c).slice(k, 1).flatten() for c in ("left", "right"))
            found = similar(left.field("text").to_pylist(), right.field("text").to_pylist(), least)
            i, j = (pa.array([f[x] for f in found], pa.int64()) for x in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([split_a] * len(found), pa.string()), pa.array([split_b] * len(found), pa.string()),
                 left.field("key").take(i), right.field("key").take(j), left.field("copies").take(i), right.field("copies").take(j),
                 pa.array([f[2] for f in found], pa.float64())],
                names=names,
            )


def near_leakage(rows: DataFrame, key: str, least: float = BORDERLINE, near: float = NEAR) -> DataFrame:
    """Pairs of classes of texts in two splits with a ratio of ``least`` or more: rows(split, text, key).

    One row per pair of classes: the splits in the order of SPLITS, the smallest key (as text) and the number of
    rows of each class in its split, the ratio of the first split's text to the second's, and ``band``: near, or
    borderline under ``near``. Rows with a null text or split take no part; an empty text equals only empty ones.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    place = F.coalesce(*[F.when(F.col("split") == s, k) for k, s in enumerate(SPLITS)])
    classes = (
        rows.select(place.alias("place"), F.lower("text").alias("text"), F.col(key).cast("string").alias("key"))
        .where("place is not null and text is not null")
        .groupBy("place", "text").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"))
    )
    # lengths of a pair differ by at most this factor, so partners are in the same or the next band of lengths
    factor = (2 - least) / least
    length = F.char_length("text")
    classes = classes.withColumn("span", F.when(length == 0, -1).otherwise(F.floor(F.log(length.cast("double")) / float(np.log(factor)) + 1e-9)).cast("int"))
    classes = materialize(classes, "classes")
    sizes = classes.groupBy("place", "span").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_TEXTS), F.sum(length) / F.lit(BLOCK_CHARS))).alias("blocks")
    )
    sizes = materialize(sizes, "sizes")
    item = F.struct("text", "key", "copies")
    packed = (
        classes.join(sizes, ["place", "span"]).withColumn("block", F.pmod(F.xxhash64("text"), F.greatest("blocks", F.lit(1))))
        .groupBy("place", "span", "block").agg(F.collect_list(item).alias("items"))
    )
    packed = materialize(packed, "blocks")
    # rows for blocks, not texts: every block of an earlier split meets those of a later one in the next spans
    later = sizes.select(F.col("place").alias("place_b"), F.col("span").alias("span_b"), F.greatest("blocks", F.lit(1)).alias("blocks_b"))
    ahead = F.explode(F.sequence(F.col("place") + 1, F.lit(len(SPLITS) - 1)))
    met = (
        packed.where(F.col("place") < len(SPLITS) - 1).select("place", "span", F.col("items").alias("left"), ahead.alias("place_b"))
        .select("place", "left", "place_b", F.explode(F.array(*[F.col("span") + d for d in (-1, 0, 1)])).alias("span_b"))
        .join(later, ["place_b", "span_b"])
        .select("place", "left", "place_b", "span_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_b") - 1)).alias("block_b"))
    )
    right = packed.select(*[F.col(c).alias(f"{c}_b") for c in ("place", "span", "block")], F.col("items").alias("right"))
    name = lambda c: F.element_at(F.array(*map(F.lit, SPLITS)), F.col(c) + 1)
    cells = met.join(right, ["place_b", "span_b", "block_b"]).select(name("place").alias("split_a"), name("place_b").alias("split_b"), "left", "right")
    found = cells.mapInArrow(lambda it: _matched(it, least), _RESULT)
    return found.withColumn("band", F.when(F.col("ratio") >= near, "near").otherwise("borderline"))


def near_leakage_counts(pairs: DataFrame) -> DataFrame:
    """Pairs of rows, and of classes, by pair of splits and band."""
    return pairs.groupBy("split_a", "split_b", "band").agg(
        F.sum(F.col("copies_a") * F.col("copies_b")).alias("pairs"), F.count(F.lit(1)).alias("class_pairs")
    )
