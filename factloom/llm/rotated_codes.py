"""Operator 6: embedding near-duplicates by randomised-rotation binary codes.

A vector is turned by random rotations and the signs of its coordinates are its codes.
Bits of the codes are cut into bands; vectors with the same label that share a band meet.
A code with its correction factor, the inner product of the vector and the code's own
vector, gives an unbiased estimate of an inner product with an error bound: pairs whose
estimate and bound lie under the threshold are settled, all others are computed again in
double precision, so none is linked by its estimate alone.

The bits of a band follow the logarithm of the largest label's size, so the vectors that
meet stay few, and the number of bands is such that a pair at the threshold shares none
with a probability of MISSED at most. Equal vectors are one class and hot bands are cut
into blocks of which pairs meet. A block pair gives a count of links for each vector,
each pair counted in the first band that it shares, and links that span its components;
pairs are never written out.

Defined results: vectors that are null, empty, zero or hold null or non-finite values
are linked with nothing, like those with a null label or id (an id of null stays null);
vectors of different lengths are linked with nothing; rows that repeat an id and vector
count as linked to each other; other columns are not used.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import batches
from factloom.llm.components import components
from factloom.session import materialize

MISSED = 1e-7
#: Standard deviations of the estimate's error that its bound spans.
CONFIDENCE = 6.0
BLOCK = 512


def bands_for(largest: int, cosine: float) -> tuple[int, int]:
    """(bits of a band, number of bands) for the largest label's number of vectors."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = min(60, max(8, math.ceil(math.log2(max(largest, 2))) + 3))
    return bits, math.ceil(math.log(MISSED) / math.log1p(-(agree**bits)))


def rotations(dim: int, count: int) -> np.ndarray:
    """(count, dim, dim) random rotations, the same in every task."""
    rng = np.random.default_rng([6, dim])
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


class Codes:
    """Rotations, codes and band keys for vectors of one length."""

    def __init__(self, dim: int, bits: int, bands: int):
        self.bits, self.bands, self.dim = bits, bands, dim
        self.turn = rotations(dim, -(-bits * bands // dim))
        self.power = np.uint64(1) << np.arange(bits, dtype=np.uint64)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, bands) band keys; they hold the number of the band."""
        signs = np.concatenate([unit @ t.T >= 0 for t in self.turn], axis=1)[:, : self.bits * self.bands]
        keys = signs.reshape(len(unit), self.bands, self.bits).astype(np.uint64) @ self.power
        return (keys * np.uint64(self.bands) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signs under the first rotation and correction factors."""
        turned = unit @ self.turn[0].T
        return turned >= 0, np.abs(turned).sum(axis=1) / math.sqrt(self.dim)

    def estimate(self, signs: np.ndarray, factor: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(coded, others) unbiased estimates of inner products, and each coded vector's bound."""
        turned = unit @ self.turn[0].T
        value = ((2.0 * signs - 1) / math.sqrt(self.dim)) @ turned.T / factor[:, None]
        spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(self.dim - 1, 1))
        return value, CONFIDENCE * spread


_codes: dict[tuple[int, int, int], Codes] = {}


def codes_for(dim: int, bits: int, bands: int) -> Codes:
    if (dim, bits, bands) not in _codes:
        if len(_codes) > 8:
            _codes.clear()
        _codes[dim, bits, bands] = Codes(dim, bits, bands)
    return _codes[dim, bits, bands]


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles with a hash; null where nothing can be linked."""
    for batch in it:
        out, names, dims = [], [], []
        for values, label in zip(batch.column("vector").to_pylist(), batch.column("label").to_pylist()):
            v = None
            if values and label is not None and None not in values:
                v = np.array(values, np.float64) + 0.0
                if not np.isfinite(v).all() or not v.any():
                    v = None
            out.append(None if v is None else v.tobytes())
            names.append(None if v is None else hashlib.blake2b(out[-1], digest_size=16).digest())
            dims.append(0 if v is None else len(v))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(dims), pa.array(names, pa.binary()), pa.array(out, pa.binary())],
            names=["id", "label", "dim", "name", "vector"],
        )


def _banded(bits: int, bands: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            dims = np.array(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(rows))
                vectors = np.frombuffer(b"".join(part.column("vector").to_pylist())).reshape(-1, dim)
                keys = codes_for(dim, bits, bands).keys(_unit(vectors))
                again = pa.array(np.repeat(np.arange(len(rows)), bands))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(again) for c in ("id", "label", "dim")] + [pa.array(keys.ravel())],
                    names=["id", "label", "dim", "band"],
                )

    return run


def _cell(cosine: float, bits: int, bands: int):
    """Counts of links and spanning links of a pair of blocks (or of one block)."""

    def run(group: pa.Table) -> pa.Table:
        dim, band = group.column("dim")[0].as_py(), group.column("band")[0].as_py()
        none = pa.table({"id": group.column("id").slice(0, 0), "n": pa.array([], pa.int64()), "to": group.column("id").slice(0, 0)})
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        own, weight = np.array(group.column("own")), np.array(group.column("m"))
        vectors = np.frombuffer(b"".join(group.column("vector").to_pylist())).reshape(-1, dim)
        unit, codes = _unit(vectors), codes_for(dim, bits, bands)
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        value, bound = codes.estimate(*codes.code(unit[left]), unit[right])
        linked = np.zeros(value.shape, bool)
        i, j = np.nonzero(value + bound[:, None] >= cosine)  # the bound rules pairs out; every link is computed
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        for at in range(0, len(i), 1 << 15):
            a, b = left[i[at : at + (1 << 15)]], right[j[at : at + (1 << 15)]]
            exact = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norm[a] * norm[b])
            linked[i[at : at + (1 << 15)], j[at : at + (1 << 15)]] = exact >= cosine
        linked &= left[:, None] < right[None] if x == y else True
        i, j = np.nonzero(linked)
        if not len(i):
            return none
        # a link counts in the first band that its rows share: only linked rows need all their keys
        met = np.unique(np.concatenate([left[i], right[j]]))
        keys = codes.keys(unit[met])
        a, b = np.searchsorted(met, left[i]), np.searchsorted(met, right[j])
        first = np.zeros(linked.shape, bool)
        for at in range(0, len(i), 1 << 15):
            p, q = keys[a[at : at + (1 << 15)]], keys[b[at : at + (1 << 15)]]
            first[i[at : at + (1 << 15)], j[at : at + (1 << 15)]] = p[np.arange(len(p)), (p == q).argmax(axis=1)] == band
        count = np.zeros(len(own), np.int64)
        np.add.at(count, left, (first * weight[right][None]).sum(axis=1))
        np.add.at(count, right, (first * weight[left][:, None]).sum(axis=0))
        root = np.arange(len(own))
        while True:  # the smallest row that can be reached
            low = root.copy()
            np.minimum.at(low, left, np.where(linked, root[right][None], len(own)).min(axis=1, initial=len(own)))
            np.minimum.at(low, right, np.where(linked, root[left][:, None], len(own)).min(axis=0, initial=len(own)))
            low = low[low]
            if (low == root).all():
                break
            root = low
        held = np.flatnonzero((count > 0) | (root != np.arange(len(own))))
        ids = group.column("id").combine_chunks()
        return pa.table({"id": ids.take(pa.array(held)), "n": pa.array(count[held]), "to": ids.take(pa.array(root[held]))})

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per row of vectors: key, n_links, component_id (smallest key reachable), kept."""
    batches.ready(vectors.sparkSession)
    kind, group = (vectors.schema[c].dataType.simpleString() for c in (key, label))
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.mapInArrow(_read, f"id {kind}, label {group}, dim long, name binary, vector binary")
    rows = materialize(rows, "vectors")
    valid = rows.where("vector is not null and id is not null")
    # the vector follows from its name: any of a class will do
    classes = valid.groupBy("label", "dim", "name").agg(
        F.min("id").alias("id"), F.count("*").alias("m"), F.first("vector").alias("vector")
    )
    classes = materialize(classes, "classes")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    bits, bands = bands_for(largest, cosine)
    banded = classes.select("id", "label", "dim", "vector").mapInArrow(_banded(bits, bands), f"id {kind}, label {group}, dim long, band long")
    banded = materialize(banded, "bands")
    where = ["label", "dim", "band"]
    full = banded.groupBy(*where).agg(F.count("*").alias("k")).where("k > 1")
    dealt = banded.join(full, where).withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y")),
    )
    dealt = dealt.select("id", *where, "own", F.explode(cells).alias("cell")).select("id", *where, "own", "cell.*")
    dealt = dealt.join(classes.select("id", "m", "vector", "label", "dim"), ["id", "label", "dim"])
    met = dealt.groupBy(*where, "x", "y").applyInArrow(_cell(cosine, bits, bands), f"id {kind}, n long, to {kind}")
    met = materialize(met, "met")
    counts = met.groupBy("id").agg(F.sum("n").alias("others")).withColumnRenamed("id", "class")
    joined = components(met.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "class")
    classed = (
        classes.select("label", "dim", "name", F.col("id").alias("class"), "m")
        .join(counts, "class", "left").join(joined, "class", "left")
        .select("label", "dim", "name", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n"),
                F.coalesce("component", "class").alias("component"))
    )
    out = rows.drop("vector").join(classed, ["label", "dim", "name"], "left").select(
        F.col("id").alias(key), F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(key).isNull() | (F.col(key) == F.col("component_id")))
