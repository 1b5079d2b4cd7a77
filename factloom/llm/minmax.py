"""Operator 4: near-duplicate documents by min-max hashing.

A signature keeps both the smallest and the largest value of a document's shingles
under each permutation. Either end agrees between two documents with a probability
equal to their Jaccard similarity, so a signature of 160 values needs 80 permutations.
A band has the two ends of two permutations; two documents with a similarity of 0.75
share none of the 40 bands with a probability of (1 - 0.75^4)^40, about 2.5e-7.

1. Documents with equal shingle sets are one class; classes go on, not copies.
2. Every class is compared on full shingle sets with the leading class of each of its
   bands, the one that meets the most others. Links give components. In most bands all classes are then in one component.
3. In the other bands, a class asks about every other component with a class whose
   signature agrees with its own in 0.6 of the values, and is compared with the members
   of that component on full sets until one is similar. Hot bands and components are cut
   into blocks; pairs of blocks meet, and what they give is links, never pairs.

Every link is confirmed on full sets and none between components is left out by a cap.

Defined results: a text that is null or has no words has no shingles and is linked with
nothing; one with fewer than five words has one shingle, its whole sequence; a row
without a key is linked with nothing and kept; rows that repeat a key are one document
and give one row (where their texts differ, one of them is compared, so a key should
name one text). Other columns are not used. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import batches, words
from factloom.llm.components import components
from factloom.session import materialize

WIDTH = 5
BANDS = 40
PERMUTATIONS = 2 * BANDS
#: Share of equal signature values under which two classes aren't compared on full sets: more than four
#: standard deviations below 0.75; for small sets, whose ends depend on each other, five of a larger one.
LEAST_AGREEMENT, LEAST_AGREEMENT_SMALL, SMALL = 0.6, 0.5, 64
#: Classes of a band that one block holds.
BLOCK = 256

_rng = np.random.default_rng(4)
_MULTIPLY = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64, endpoint=False) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64, endpoint=False)
_TOP = np.uint64(32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """(2, PERMUTATIONS) upper halves of the smallest and of the largest value under each permutation."""
    low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 1024):
        values = np.multiply.outer(_MULTIPLY, shingles[at : at + 1024])
        values += _ADD[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.stack([low >> _TOP, high >> _TOP]).astype("<u4")


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys of (rows, 2, PERMUTATIONS) signatures."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), 2, BANDS, 2)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), BANDS))
    for end in range(2):
        for k in range(2):
            key = words.mix(key ^ (parts[:, end, :, k] + np.uint64(0x632BE59BD9B4E019)))
    return key.view(np.int64)


def _sets(texts: list[str]) -> Iterator[np.ndarray]:
    for _, word, ends in words.of_texts(texts):
        yield from words.shingles(word, ends, WIDTH)


def _signed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = np.uint64(0xD6E8FEB86659FD93)
    for batch in it:
        n, a, b, sig = [], [], [], []
        for s in _sets(batches.texts(batch, "text")):
            n.append(len(s))
            a.append(int(words.mix(s).sum().astype(np.int64)) if len(s) else 0)
            b.append(int(words.mix(s ^ salt).sum().astype(np.int64)) if len(s) else 0)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
             pa.array(sig, pa.binary())],
            names=["id", "n", "set_a", "set_b", "sig"],
        )


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, 2, PERMUTATIONS)


def _banded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        keys = band_keys(_signatures(batch.column("sig")))
        ids = np.repeat(np.arange(batch.num_rows), BANDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel()), batch.column("id").take(pa.array(ids))], names=["band", "id"]
        )


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([a, b]))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    few, many = sorted((len(a), len(b)))
    both = _shared(a, b) if few and 100 * few >= percent * many else 0
    return both > 0 and 100 * both >= percent * (few + many - both)


def _confirmed(percent: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = batches.texts(batch, "text_a"), batches.texts(batch, "text_b")
            distinct = {t: k for k, t in enumerate(dict.fromkeys(b))}
            second = list(_sets(list(distinct)))
            keep = [_similar(x, second[distinct[t]], percent) for x, t in zip(_sets(a), b)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    a = held.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = held.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    kind = held.schema["id"].dataType.simpleString()
    return materialize(joined.mapInArrow(_confirmed(percent), f"a {kind}, b {kind}"), "links")


def _asked(group: pa.Table) -> pa.Table:
    """Which classes of a block pair may be similar to one of which other component: (class, component)."""
    sig = _signatures(group.column("sig").combine_chunks())
    flat, size = sig.reshape(len(sig), -1), np.array(group.column("n"))
    out, names = np.array(group.column("out")), group.column("label").to_pylist()
    order = {name: k for k, name in enumerate(sorted(set(names)))}
    label = np.array([order[name] for name in names])
    both_out = group.column("kind")[0].as_py() == "oo"
    rows = np.flatnonzero(out)
    others = rows if both_out else np.flatnonzero(~out)
    a, c = [], []
    for i in rows.tolist():
        near = others[label[others] < label[i]] if both_out else others[label[others] != label[i]]
        least = LEAST_AGREEMENT_SMALL if size[i] < SMALL else LEAST_AGREEMENT
        near = near[(flat[near] == flat[i]).mean(axis=1) >= least]
        for k in np.unique(label[near], return_index=True)[1].tolist():
            a.append(i)
            c.append(int(near[k]))
    take = lambda name, at: group.column(name).combine_chunks().take(pa.array(at, pa.int64()))
    return pa.table({"a": take("id", a), "c": take("label", c)})


def _answered(percent: int):
    """A link for each asking class that is similar to a member of the component, on full sets."""

    def run(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("asks"))
        sets = list(_sets([t or "" for t in group.column("text").to_pylist()]))
        sig = _signatures(group.column("sig").combine_chunks()).reshape(len(sets), -1)
        size = np.array([len(s) for s in sets])
        members = np.flatnonzero(~asks)
        a, b = [], []
        for i in np.flatnonzero(asks).tolist():
            agree = (sig[members] == sig[i]).mean(axis=1)
            least = LEAST_AGREEMENT_SMALL if size[i] < SMALL else LEAST_AGREEMENT
            for k in np.argsort(-agree, kind="stable").tolist():
                if agree[k] < least:
                    break
                if _similar(sets[i], sets[members[k]], percent):
                    a.append(i)
                    b.append(int(members[k]))
                    break
        ids = group.column("id").combine_chunks()
        return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})

    return run


def _grid(own: str, mine: str, theirs: str, turned: bool):
    """Cells of a grid of blocks that a row of block ``own`` belongs to, as (x, y)."""
    x = F.pmod(F.xxhash64(own), F.col(mine)).cast("int")
    cell = lambda y: F.struct((y if turned else x).alias("x"), (x if turned else y).alias("y"))
    return F.explode(F.transform(F.sequence(F.lit(0), F.col(theirs) - 1), cell)).alias("cell")


def _blocks(n: str):
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")


def _questions(members: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    """(a, c): classes and components of their bands that they may be linked to but aren't yet."""
    per_band = members.groupBy("band").agg(
        F.sum(F.col("out").cast("long")).alias("n_out"), F.sum((~F.col("out")).cast("long")).alias("n_in")
    ).where("n_out > 0 and n_out + n_in > 2").withColumn("outs", _blocks("n_out")).withColumn("ins", _blocks("n_in"))
    rows = members.join(per_band, "band").select("band", "id", "out", "label", "outs", "ins")
    named = lambda k, rows: rows.select(F.lit(k).alias("kind"), "band", "id", "out", "label", "cell.*")
    outs = rows.where("out").withColumn("own", F.pmod(F.xxhash64("id"), F.col("outs")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("outs") - 1),
        lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y")),
    )
    dealt = named("oo", outs.select("*", F.explode(pairs).alias("cell")))
    dealt = dealt.unionByName(named("oi", rows.where("out").select("*", _grid("id", "outs", "ins", False))))
    dealt = dealt.unionByName(named("oi", rows.where("not out").select("*", _grid("id", "ins", "outs", True))))
    dealt = dealt.join(classes, "id")
    asked = dealt.groupBy("kind", "band", "x", "y").applyInArrow(_asked, f"a {kind}, c {kind}")
    return materialize(asked.distinct(), "questions")


def _answers(questions: DataFrame, held: DataFrame, labelled: DataFrame, classes: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links (a, b) of asking classes with members of the components they ask about."""
    size = labelled.join(questions.select("c").distinct(), labelled["label"] == F.col("c"), "left_semi")
    size = size.groupBy("label").agg(F.count("*").alias("n_in")).withColumnRenamed("label", "c")
    counts = questions.groupBy("c").agg(F.count("*").alias("n_q")).join(size, "c")
    counts = materialize(counts.withColumn("asking", _blocks("n_q")).withColumn("held", _blocks("n_in")), "counts")
    asks = questions.withColumnRenamed("a", "id").join(counts, "c").select(
        "c", "id", F.lit(True).alias("asks"), _grid("id", "asking", "held", False)
    )
    members = labelled.withColumnRenamed("label", "c").join(counts, "c").select(
        "c", "id", F.lit(False).alias("asks"), _grid("id", "held", "asking", True)
    )
    rows = asks.unionByName(members).select("c", "id", "asks", "cell.*").join(held, "id").join(classes.drop("n"), "id")
    return materialize(rows.groupBy("c", "x", "y").applyInArrow(_answered(percent), f"a {kind}, b {kind}"), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable by links), kept.

    Links join documents with 100 * intersection >= percent * union of their five-word shingles.
    """
    batches.ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = f"id {kind}, n long, set_a long, set_b long, sig binary"
    signed = materialize(docs.mapInArrow(_signed, schema), "signatures")
    same = ["n", "set_a", "set_b"]
    sets = materialize(
        signed.where("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("id")), "sets"
    )
    classes = materialize(signed.join(sets, ["id", *same]).dropDuplicates(["id", *same]).select("id", "n", "sig"), "classes")
    bands = materialize(classes.mapInArrow(_banded, f"band long, id {kind}"), "bands")
    shared = bands.groupBy("band").agg(F.count("*").alias("k")).where("k > 1")
    shared = materialize(bands.join(shared, "band"), "shared")
    # the class that meets the most others leads a band: of near copies, the text they were made from
    met = shared.groupBy("id").agg(F.sum("k").alias("met"))
    leaders = shared.join(met, "id").groupBy("band").agg(F.max_by("id", "met").alias("leader"))
    members = materialize(shared.drop("k").join(leaders, "band"), "members")
    # a merge join at every size: texts move once, in proportion to the input
    held = docs.join(met.select("id").hint("merge"), "id", "left_semi").dropDuplicates(["id"])
    held = materialize(held, "texts")
    first = members.where("id != leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    labels = components(_linked(first, held, percent))

    by = lambda c, out: labels.select(F.col("node").alias(c), F.col("component").alias(out))
    named = members.join(by("id", "label"), "id", "left").join(by("leader", "theirs"), "leader", "left").select(
        "band", "id", "leader", F.coalesce("label", "id").alias("label"),
        (F.coalesce("label", "id") != F.coalesce("theirs", "leader")).alias("out"),
    )
    questions = _questions(materialize(named, "members"), classes, kind)
    labelled = held.select("id").join(by("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    found = _answers(questions, held, materialize(labelled, "labelled"), classes, percent, kind)
    between = found.join(by("a", "x"), "a", "left").join(by("b", "y"), "b", "left").select(
        F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")
    )
    merged = components(between).select(F.col("node").alias("label"), F.col("component").alias("merged"))
    classed = sets.withColumnRenamed("id", "class").join(by("class", "label"), "class", "left").withColumn(
        "label", F.coalesce("label", "class")
    )
    classed = classed.join(merged, "label", "left").select(*same, F.coalesce("merged", "label").alias("component"))
    rows = signed.select("id", *same).join(classed, same, "left")
    out = rows.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    ).dropDuplicates([key, "component_id"])
    return out.withColumn("kept", F.col(key).isNull() | (F.col(key) == F.col("component_id")))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The rows of docs that are kept, one for each key; columns unchanged.

    Rows without a key all stay; of rows that repeat a key, one does.
    """
    rows = near_duplicates(docs, key, text, percent).where("not kept").select(F.col(key).alias("__copy"))
    kept = docs.join(rows, F.col(key) == F.col("__copy"), "left_anti")
    return kept.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.where(F.col(key).isNull()))
