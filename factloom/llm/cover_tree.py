"""Operator 12: hard negatives by cover trees over norm-augmented candidates.

A vector of integers gets one more component that lifts all of a tree to the same norm; for an
anchor (with 0 there) the order of distances is then the order of inner products. Candidates
are dealt into trees of a bounded size. A cover tree's nodes are the distinct vectors: those of
a level are more than half the level's radius apart, each has its parent on a coarser level
within that level's radius, and each node holds the covering radius of what lies under it. So
distance to a node bounds the inner products under it from both sides.

Anchors, in blocks, descend the trees of a shelf together, best bound first: a node is skipped
when for every window of every anchor the bounds under it end below the window or the k-th best
found so far, or begin above the window. Inner products themselves are computed exactly.

Two descents: the first finds each anchor's best rows of its own label (positives); each gives
a window of inner products, and the second finds the best rows of other labels in each window.
Every anchor block meets every shelf, cut into cells of bounded size; no pair of rows is
written but what a cell found. A label with many rows gets trees of its own, labels with few
share trees, so no tree follows one label's size.

Defined results: rows with a null id, label or vector, or a null or non-finite component take
no part; a shorter vector counts as filled up with zeros; equal vectors are one node that keeps
all ids; rows that repeat an id are rows of their own, save that exact repeats of an anchor are
one anchor, and no row with an anchor's id is its partner; ties go by smaller id; an empty
table, or one without anchors or other labels, gives an empty result; columns of other names
aren't used. Products beyond 2^53 are computed in whole numbers and cut at 64 bits.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import batches
from factloom.session import materialize

#: Vectors of a tree, on average, trees of a shelf, and anchors of a block: what a task holds at a time follows these.
TREE = 1024
SHELF = 32
ANCHORS = 256
#: Nodes taken from the frontier at first and at most.
FIRST_NODES, MOST_NODES = 32, 1024
LEAST, MOST = -(2**63), 2**63 - 1


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as held:
        return dict(held)


def _small(vectors: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(vectors).max(initial=0)
    return vectors.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def _filled(rows: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones are filled up with zeros."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _widened(vectors: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(vectors.astype(np.float64), ((0, 0), (0, dim - vectors.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, cut at 64 bits."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in b]
    return np.array([[min(max(sum(map(int.__mul__, map(int, row), other)), LEAST), MOST) for other in whole] for row in a], np.int64).reshape(len(a), len(b))


def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree; its nodes are the distinct (label, vector), children of a node are neighbours."""
    n = len(ids)
    vectors = np.ascontiguousarray(vectors, np.float64) + 0.0  # no negative zeros
    raw = np.concatenate([np.ascontiguousarray(labels, "<i8").view(np.uint8).reshape(n, 8), vectors.view(np.uint8).reshape(n, -1)], axis=1)
    _, first, node = np.unique(np.ascontiguousarray(raw).view(f"V{raw.shape[1]}").ravel(), return_index=True, return_inverse=True)
    points, m = vectors[first], len(first)
    square = (points**2).sum(axis=1)
    top = square.max(initial=0)
    lifted = np.column_stack([points, np.sqrt(top - square)])

    def distances(p: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 * (top - lifted @ lifted[p]), 0))

    # farthest point first: the points taken while the distance is over r are a net of radius r
    parent, apart, depth = np.full(m, -1), np.zeros(m), np.zeros(m, np.int64)
    distance, near = distances(0), np.zeros(m, np.int64)
    coarser, radius = near.copy(), distance.max()
    distance[0] = -1
    for _ in range(m - 1):
        p = int(distance.argmax())
        if 0 < distance[p] <= radius / 2:
            coarser = near.copy()
            radius /= 2.0 ** np.floor(np.log2(radius / distance[p]))
        parent[p] = coarser[p]
        depth[p] = depth[parent[p]] + 1
        new = distances(p)
        apart[p] = new[parent[p]]
        near[new < distance] = p
        distance = np.minimum(distance, new)
        distance[p] = -1
    order, place = [np.zeros(1, np.int64)], np.zeros(m, np.int64)
    for d in range(1, int(depth.max()) + 1):  # by depth, children of a node together
        at = np.flatnonzero(depth == d)
        order.append(at[np.argsort(place[parent[at]], kind="stable")])
        place[order[-1]] = sum(map(len, order[:-1])) + np.arange(len(at))
    order = np.concatenate(order)
    cover, pure, label = np.zeros(m), np.ones(m, bool), labels[first]
    below, above = np.arange(m), parent.copy()
    while len(below := below[above[below] >= 0]):
        a = above[below]
        np.maximum.at(cover, a, np.sqrt(np.maximum(2 * (top - (lifted[below] * lifted[a]).sum(axis=1)), 0)))
        np.logical_and.at(pure, a, label[below] == label[a])
        above[below] = parent[a]
    children = np.bincount(place[parent[order[1:]]], minlength=m)
    by_node = np.lexsort((ids, place[node]))
    return {
        "vectors": _small(points[order]), "label": label[order], "pure": pure[order], "cover": cover[order], "apart": apart[order],
        "parent": np.append(-1, place[parent[order[1:]]]), "children": children, "first_child": np.cumsum(children) - children + 1,
        "ids": ids[by_node], "first_id": np.append(0, np.cumsum(np.bincount(place[node], minlength=m))), "top": np.array([top]),
    }


class Forest:
    """The trees of a shelf as one set of nodes."""

    def __init__(self, trees: list[dict[str, np.ndarray]], dim: int):
        self.vectors = np.concatenate([_widened(t["vectors"], dim) for t in trees])
        for name in ("label", "pure", "cover", "apart", "children", "ids"):
            setattr(self, name, np.concatenate([t[name] for t in trees]))
        sizes = [len(t["label"]) for t in trees]
        base = np.cumsum([0, *sizes])
        self.roots = base[:-1]
        self.parent = np.concatenate([np.where(t["parent"] < 0, -1, t["parent"] + b) for t, b in zip(trees, base)])
        self.first_child = np.concatenate([t["first_child"] + b for t, b in zip(trees, base)])
        ends = np.cumsum([0, *(len(t["ids"]) for t in trees)])
        self.first_id = np.concatenate([*(t["first_id"][:-1] + e for t, e in zip(trees, ends)), ends[-1:]])
        self.top = np.repeat([t["top"][0] for t in trees], sizes)


class Found:
    """The k best (score, id) of each window of each anchor."""

    def __init__(self, anchors: int, windows: int, k: int):
        self.k = k
        self.score = np.full((anchors * windows, k), LEAST, np.int64)
        self.id = np.full((anchors * windows, k), MOST, np.int64)
        self.full = np.zeros(anchors * windows, bool)
        self.shape = (anchors, windows)

    def worst(self) -> np.ndarray:
        """What a score must reach to be of use, (anchors, windows)."""
        return np.where(self.full, self.score[:, -1], LEAST).reshape(self.shape)

    def take(self, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        touched = np.unique(slot)
        used = self.id[touched] != MOST
        slot = np.concatenate([slot, np.repeat(touched, self.k)[used.ravel()]])
        score = np.concatenate([score, self.score[touched][used]])
        row = np.concatenate([row, self.id[touched][used]])
        order = np.lexsort((row, ~score, slot))  # ~score: descending, without overflow
        slot, score, row = slot[order], score[order], row[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        held = rank < self.k
        slot, rank = slot[held], rank[held]
        self.score[slot, rank], self.id[slot, rank] = score[held], row[held]
        self.full[slot[rank == self.k - 1]] = True

    def rows(self) -> tuple[np.ndarray, ...]:
        """anchor, window, score, id of all found."""
        slot, rank = np.nonzero(self.id != MOST)
        return slot // self.shape[1], slot % self.shape[1], self.score[slot, rank], self.id[slot, rank]


class OwnIds:
    """How often an anchor's own id is among a node's ids."""

    def __init__(self, forest: Forest, ids: np.ndarray):
        self.nodes = len(forest.label)
        at = np.flatnonzero(np.isin(forest.ids, ids))
        node = np.searchsorted(forest.first_id, at, side="right") - 1
        order = np.argsort(ids, kind="stable")
        a, b = (np.searchsorted(ids[order], forest.ids[at], side=s) for s in ("left", "right"))
        spread = np.repeat(np.arange(len(at)), b - a)
        anchor = order[np.repeat(a, b - a) + np.arange(len(spread)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]
        self.key, self.count = np.unique(anchor * self.nodes + node[spread], return_counts=True)

    def of(self, anchor: np.ndarray, node: np.ndarray) -> np.ndarray:
        want = anchor * self.nodes + node
        at = np.searchsorted(self.key, want)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == want, self.count[at], 0) if len(self.key) else np.zeros(len(want), np.int64)


def descend(forest: Forest, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> Found:
    """The k best rows of each window [low, high] (anchors, windows), of the anchor's label or of others."""
    found = Found(len(anchors), low.shape[1], k)
    square = (anchors**2).sum(axis=1)
    waiting, bound = forest.roots, np.full(len(forest.roots), np.inf)
    held: dict[int, np.ndarray] = {}  # distances of anchors to nodes with children
    most, own = FIRST_NODES, OwnIds(forest, ids)
    floor_low, floor_high = low.astype(np.float64), high.astype(np.float64)

    def bounds(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds and need (nodes, anchors) of what lies under nodes, from their parents' distances."""
        total = square + forest.top[nodes][:, None]
        up, down = np.full((len(nodes), len(anchors)), np.inf), np.full((len(nodes), len(anchors)), -np.inf)
        inner = np.flatnonzero(forest.parent[nodes] >= 0)
        if len(inner):
            far = np.stack([held[p] for p in forest.parent[nodes[inner]].tolist()])
            reach = (forest.apart + forest.cover)[nodes[inner], None]
            slack = 1e-9 * total[inner] + 1
            up[inner] = (total[inner] - np.maximum(far - reach, 0) ** 2) / 2 + slack
            down[inner] = (total[inner] - (far + reach) ** 2) / 2 - slack
        least = np.maximum(floor_low, found.worst())
        need = np.zeros(up.shape, bool)
        for w in range(low.shape[1]):
            need |= (up >= least[:, w]) & (down <= floor_high[:, w])
        alike = forest.label[nodes][:, None] == labels
        need &= ~forest.pure[nodes][:, None] | (alike if same else ~alike)
        return up, need

    while len(waiting):
        if len(waiting) > most:
            best = np.argpartition(-bound, most)
            nodes, waiting, bound = waiting[best[:most]], waiting[best[most:]], bound[best[most:]]
        else:
            nodes, waiting, bound = waiting, waiting[:0], bound[:0]
        most = min(2 * most, MOST_NODES)
        nodes = nodes[bounds(nodes)[1].any(axis=1)]
        if not len(nodes):
            continue
        score = products(anchors, forest.vectors[nodes])
        alike = labels[:, None] == forest.label[nodes]
        fits = alike if same else ~alike
        worst = np.maximum(found.worst(), low)
        hits = [(*np.nonzero(fits & (score >= worst[:, w, None]) & (score <= high[:, w, None])), w) for w in range(low.shape[1])]
        a = np.concatenate([h[0] for h in hits])
        if len(a):
            c = np.concatenate([h[1] for h in hits])
            slot = a * low.shape[1] + np.repeat(np.arange(low.shape[1]), [len(h[0]) for h in hits])
            first = forest.first_id[nodes[c]]
            # a node's ids ascend: the first k count, besides the anchor's own
            count = np.minimum(forest.first_id[nodes[c] + 1] - first, k + own.of(a, nodes[c]))
            hit = np.repeat(np.arange(len(a)), count)
            row = forest.ids[first[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)]
            hit, row = hit[row != ids[a[hit]]], row[row != ids[a[hit]]]
            found.take(slot[hit], score[a[hit], c[hit]], row)
        parents = nodes[forest.children[nodes] > 0]
        if len(parents):
            at = np.flatnonzero(forest.children[nodes] > 0)
            total = square[:, None] + forest.top[parents]
            away = np.sqrt(np.maximum(total - 2.0 * score[:, at], 0)).T
            held.update(zip(parents.tolist(), away))
            count = forest.children[parents]
            new = np.repeat(forest.first_child[parents] - np.cumsum(count) + count, count) + np.arange(count.sum())
            for k0 in range(0, len(new), MOST_NODES):
                part = new[k0 : k0 + MOST_NODES]
                up, need = bounds(part)
                part, up, need = part[need.any(axis=1)], up[need.any(axis=1)], need[need.any(axis=1)]
                waiting = np.concatenate([waiting, part])
                bound = np.concatenate([bound, np.where(need, up, -np.inf).max(axis=1, initial=-np.inf)])
    return found


def _rows(it: Iterator[pa.RecordBatch], scale: float, moved: int, classes: int) -> Iterator[pa.RecordBatch]:
    """Rows that take part: id, label, vector (bytes of doubles that are whole numbers)."""
    for batch in it:
        vectors, lists = [], batch.column("vector")
        values = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan), np.float64)
        with np.errstate(over="ignore"):
            whole = np.floor(scale * values) + 0.0
        ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(whole))))
        for a, b, there in zip([0, *ends[:-1].tolist()], ends.tolist(), lists.is_valid().to_pylist()):
            vectors.append(whole[a:b].tobytes() if there and bad[a] == bad[b] else None)
        ids, labels = batch.column("id"), batch.column("label")
        held = pa.array(np.array([v is not None for v in vectors], bool) & np.asarray(ids.is_valid()) & np.asarray(labels.is_valid()))
        rows = pa.RecordBatch.from_arrays([ids, labels, pa.array(vectors, pa.binary())], names=["id", "label", "vector"]).filter(held)
        ids, labels = np.asarray(rows.column("id"), np.int64), np.asarray(rows.column("label"), np.int64)
        labels = np.where(ids % moved == 0, (labels + 1) % classes, labels) if moved else labels
        yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(labels), rows.column("vector")], names=["id", "label", "vector"])


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = _filled([np.frombuffer(v) for v in table.column("vector").to_pylist()])
    return np.asarray(table.column("id"), np.int64), np.asarray(table.column("label"), np.int64), vectors


def _tree(key: tuple, table: pa.Table) -> pa.Table:
    bucket, salt = (k.as_py() for k in key)
    return pa.table({"bucket": [bucket], "shelf": [salt // SHELF], "tree": pa.array([_packed(**build(*_arrays(table)))], pa.binary())})


def _block(table: pa.Table) -> bytes:
    ids, labels, vectors = _arrays(table)
    return _packed(ids=ids, labels=labels, vectors=_small(vectors))


def _cell(table: pa.Table, block: dict[str, np.ndarray]) -> tuple[Forest, np.ndarray]:
    trees = [_unpacked(t) for t in table.column("tree").to_pylist()]
    dim = max(block["vectors"].shape[1], *(t["vectors"].shape[1] for t in trees))
    return Forest(trees, dim), _widened(block["vectors"], dim)


def hard_negatives(
    rows: DataFrame, anchor_step: int, positives: int, negatives: int, low_percent: int, high_percent: int,
    scale: float = 256.0, moved: int = 0, classes: int = 1, key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """For each anchor (id divisible by ``anchor_step``) and each of its positives, the best rows of other labels.

    A negative's score is between low_percent and high_percent of the positive's. ``scale`` makes components
    whole numbers; labels of rows with an id divisible by ``moved`` go up by one modulo ``classes`` first.
    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = batches.ready(rows.sparkSession)
    named = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    plain = materialize(
        named.mapInArrow(lambda it: _rows(it, scale, moved, classes), "id long, label long, vector binary"), "vectors"
    )

    # labels of many rows have a bucket each, the others share buckets; salts cut buckets into trees
    counts = plain.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("id") % anchor_step == 0).alias("anchors"))
    counts = materialize(counts, "labels")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pool = F.concat(F.lit("pool "), F.pmod(F.xxhash64("label"), F.lit(max(1, -(-total // TREE)))))
    bucket = F.when(F.col("n") < TREE, pool).otherwise(F.concat(F.lit("label "), F.col("label")))
    buckets = counts.withColumn("bucket", bucket)
    sizes = buckets.groupBy("bucket").agg(F.sum("n").alias("in_bucket"), F.sum("anchors").alias("in_blocks"))
    sizes = sizes.select("bucket", F.ceil(F.col("in_bucket") / TREE).alias("trees"), F.ceil(F.col("in_blocks") / ANCHORS).alias("blocks"))
    deal = materialize(buckets.select("label", "bucket").join(sizes, "bucket"), "buckets")

    salted = plain.join(deal, "label").withColumn("salt", F.pmod(F.xxhash64("id", "vector"), "trees"))
    trees = materialize(salted.groupBy("bucket", "salt").applyInArrow(_tree, "bucket string, shelf long, tree binary"), "trees")

    anchors = plain.where(F.col("id") % anchor_step == 0).dropDuplicates(["id", "label", "vector"]).join(deal, "label")
    anchors = anchors.withColumn("salt", F.pmod(F.xxhash64("id", "vector"), F.greatest("blocks", F.lit(1))))

    def block(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"bucket": [key[0].as_py()], "block": [key[1].as_py()], "anchors": pa.array([_block(table)], pa.binary())})

    blocks = materialize(anchors.groupBy("bucket", "salt").applyInArrow(block, "bucket string, block long, anchors binary"), "anchors")
    # names of shelves and blocks, numbered: rows without vectors, one for SHELF trees or ANCHORS anchors
    shelves = sizes.select("bucket", F.explode(F.sequence(F.lit(0), ((F.col("trees") - 1) / SHELF).cast("long"))).alias("shelf"))
    shelves = materialize(shelves.withColumn("s", F.row_number().over(Window.orderBy("bucket", "shelf"))), "shelves")
    met = sizes.where("blocks > 0").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    met = materialize(met.withColumn("b", F.row_number().over(Window.orderBy("bucket", "block"))), "blocks")

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _empty(near_schema)
        held = _unpacked(right.column("anchors")[0].as_py())
        forest, vectors = _cell(left, held)
        shape = (len(vectors), 1)
        found = descend(forest, vectors, held["ids"], held["labels"], np.full(shape, LEAST), np.full(shape, MOST), True, positives)
        a, _, score, row = found.rows()
        return _table(near_schema, right.column("bucket")[0].as_py(), right.column("block")[0].as_py(), a, row, score)

    near_schema = {"bucket": pa.string(), "block": pa.int64(), "a": pa.int64(), "id": pa.int64(), "score": pa.int64()}
    left = trees.join(met, "bucket").groupBy("bucket", "shelf", "block")
    right = blocks.join(shelves, "bucket").groupBy("bucket", "shelf", "block")
    near = left.cogroup(right).applyInArrow(find_positives, "bucket string, block long, a long, id long, score long")
    best = Window.partitionBy("bucket", "block", "a").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)

    def with_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _empty(asked_schema)
        held = _unpacked(left.column("anchors")[0].as_py())
        a, place = np.asarray(right.column("a"), np.int64), np.asarray(right.column("place"), np.int64) - 1
        shape = (len(held["ids"]), positives)
        window = {"low": np.ones(shape, np.int64), "high": np.zeros(shape, np.int64), "positive": np.zeros(shape, np.int64), "score": np.zeros(shape, np.int64)}
        score = np.asarray(right.column("score"), np.int64)
        for name, values in (("low", -_share(-score, low_percent)), ("high", _share(score, high_percent)), ("positive", right.column("id")), ("score", score)):
            window[name][a, place] = np.asarray(values, np.int64)
        return _table(asked_schema, left.column("bucket")[0].as_py(), left.column("block")[0].as_py(), [_packed(**held, **window)])

    asked_schema = {"bucket": pa.string(), "block": pa.int64(), "anchors": pa.binary()}
    asked = blocks.groupBy("bucket", "block").cogroup(near.groupBy("bucket", "block"))
    asked = materialize(asked.applyInArrow(with_windows, "bucket string, block long, anchors binary"), "windows")

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _empty(found_schema)
        held = _unpacked(right.column("anchors")[0].as_py())
        forest, vectors = _cell(left, held)
        found = descend(forest, vectors, held["ids"], held["labels"], held["low"], held["high"], False, negatives)
        a, place, score, row = found.rows()
        return _table(found_schema, right.column("b")[0].as_py(), a, place, held["ids"][a], held["positive"][a, place], row, held["score"][a, place], score)

    columns = ("b", "a", "place", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
    found_schema = dict.fromkeys(columns, pa.int64())
    left = trees.join(shelves, ["bucket", "shelf"]).select("s", F.explode(F.sequence(F.lit(1), F.lit(max(1, met.count())))).alias("b"), "tree")
    right = asked.join(met, ["bucket", "block"]).select("b", F.explode(F.sequence(F.lit(1), F.lit(max(1, shelves.count())))).alias("s"), "anchors")
    found = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(find_negatives, ", ".join(f"{c} long" for c in columns))
    best = Window.partitionBy("b", "a", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _share(score: np.ndarray, percent: int) -> np.ndarray:
    """The whole part (downwards) of a percentage, without overflow."""
    return score // 100 * percent + score % 100 * percent // 100


def _empty(schema: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array([], t) for n, t in schema.items()})


def _table(schema: dict[str, pa.DataType], *values) -> pa.Table:
    """Columns of a schema; single values stand on every row."""
    rows = next(len(v) for v in values if isinstance(v, (list, np.ndarray)))
    return pa.table({
        n: pa.array(v if isinstance(v, (list, np.ndarray)) else [v] * rows, t) for (n, t), v in zip(schema.items(), values, strict=True)
    })
