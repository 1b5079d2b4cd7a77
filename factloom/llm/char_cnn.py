"""Operator 10: secret scans by a character convolutional network.

Every candidate, a rule's finding or a long run of token characters with a digit, is
judged with its surroundings by a small network in numpy: characters as classes, one
convolution, the largest value of each filter over the candidate and over its context,
one layer to a probability. It is trained on labelled findings of the corpus: what the
rules found is a secret; candidates that no rule matches, and failing matches of a rule,
are not. Keywords before a secret are masked in part of the examples, so the candidate's
own shape counts as well. Probabilities are calibrated on findings held out from the
training (Platt's sigmoid), and the threshold is the highest that keeps RECALL of them.

Findings of the rules stay whatever the network says; it adds the candidates over the
threshold that overlap none of them.

Training takes every different finding of the corpus: a quarter of them, by hash, is for
calibration, the rest is dealt by hash into shares of about SHARE. In each epoch every
share trains a copy of the network, and the copies and their Adam moments are averaged.
Calibration counts all held-out findings by their logits, in steps of 1 / STEPS.
Scanning covers whole texts. Defined results: a null or empty text has no findings;
without examples of both kinds the network adds nothing; repeated rows are scanned each;
other columns pass unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import batches, sums
from factloom.session import materialize

#: Labelled findings of one share of the training, about.
SHARE = 6000
#: Logits are calibrated in these steps, up to this size.
STEPS, LARGEST = 1024, 30
RECALL = 0.98
BEFORE, TOKEN, AFTER = 24, 48, 12
WIDTH, FILTERS, EPOCHS = 5, 24, 12
#: Shortest candidate that no rule found.
LEAST = 16

# The rules' patterns, as the results are defined by them.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
KINDS = ("assign", "access", "hex")


def base_findings(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """(start, end, kind) by start, then kind as listed; and the secrets' spans of matches that failed."""
    found, failed = [], []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[1]) >= 6:
                found.append((m.start(), m.end(), "assign"))
            else:
                failed.append(m.span(1))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                found.append((m.start(), m.end(), "access"))
            else:
                failed.append(m.span())
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2]))), failed


def candidates(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Long runs of token characters with a letter and a digit that overlap no finding."""
    out = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            if not any(a < end and start < b for start, end, _ in found):
                out.append((a, b))
    return out


_CLASSES = 12


def _classes() -> np.ndarray:
    """Class of each character below 128; others are letters of other scripts (the last class)."""
    table = np.full(129, 9, np.int64)
    for k, chars in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "=:", "\"'", " \t\r\n", "+/_-.")):
        table[[ord(c) for c in chars]] = k
    table[128] = 10
    return table


_CLASS = _classes()


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character classes before, in and after a candidate; the last class is padding.

    Of a longer candidate, its head and tail are seen.
    """
    if end - start > TOKEN:
        inside = text[start : start + TOKEN // 2] + text[end - TOKEN // 2 : end]
    else:
        inside = text[start:end]
    parts = ((text[max(0, start - BEFORE) : start], BEFORE, True), (inside, TOKEN, False), (text[end : end + AFTER], AFTER, False))
    out = []
    for part, size, right in parts:
        ids = _CLASS[np.minimum([ord(c) for c in part], 128)] if part else np.zeros(0, np.int64)
        pad = np.full(size - len(ids), _CLASSES - 1)
        out += [pad, ids] if right else [ids, pad]
    return np.concatenate(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Network:
    """The network's arrays; ``logits`` judges windows, ``train`` fits them by Adam."""

    def __init__(self, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.kernel = rng.standard_normal((WIDTH * _CLASSES, FILTERS)) * 0.3
        self.bias = np.zeros(FILTERS)
        self.out = rng.standard_normal(2 * FILTERS) * 0.1
        self.shift = np.zeros(1)
        self.platt, self.threshold = (1.0, 0.0), 2.0
        self.moments = [[np.zeros_like(p), np.zeros_like(p)] for p in self._arrays()]
        self.step = 0.0

    def _arrays(self) -> tuple[np.ndarray, ...]:
        return self.kernel, self.bias, self.out, self.shift

    def values(self) -> np.ndarray:
        """All that training changes, in one row: arrays, Adam's moments and steps."""
        parts = [*self._arrays(), *(x for pair in self.moments for x in pair)]
        return np.concatenate([*(x.ravel() for x in parts), [self.step]])

    def put(self, values: np.ndarray) -> None:
        at = 0
        for x in (*self._arrays(), *(x for pair in self.moments for x in pair)):
            x[...] = values[at : at + x.size].reshape(x.shape)
            at += x.size
        self.step = float(values[at])

    def _forward(self, windows: np.ndarray):
        n, length = windows.shape
        hot = np.eye(_CLASSES)[windows]
        strips = np.lib.stride_tricks.sliding_window_view(hot, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - WIDTH + 1, -1)
        value = np.maximum(strips @ self.kernel + self.bias, 0)
        inner = slice(BEFORE - WIDTH // 2, BEFORE + TOKEN)
        rest = np.r_[0 : BEFORE - WIDTH // 2, BEFORE + TOKEN : value.shape[1]]
        a, b = value[:, inner].argmax(axis=1) + inner.start, rest[value[:, rest].argmax(axis=1)]
        rows = np.arange(n)[:, None]
        pooled = np.concatenate([value[rows, a, np.arange(FILTERS)], value[rows, b, np.arange(FILTERS)]], axis=1)
        return strips, a, b, pooled

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(w)[3] @ self.out + self.shift for w in np.array_split(windows, -(-len(windows) // 512))]) if len(windows) else np.zeros(0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return _sigmoid(a * self.logits(windows) + b)

    def epoch(self, windows: np.ndarray, label: np.ndarray, share: float, seed: tuple[int, ...]) -> None:
        """One pass over the examples; ``share`` is that of secrets among all examples."""
        rng = np.random.default_rng(seed)
        weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share))
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            w = windows[rows].astype(np.int64)
            w[np.ix_(rng.random(len(rows)) < 0.5, range(BEFORE))] = _CLASSES - 1  # masked keywords
            strips, a, b, pooled = self._forward(w)
            error = (_sigmoid(pooled @ self.out + self.shift) - label[rows]) * weight[rows] / len(rows)
            back = np.outer(error, self.out) * (pooled > 0)
            grads = [np.zeros_like(self.kernel), np.zeros(FILTERS), pooled.T @ error, error.sum(keepdims=True)]
            for half, at_ in ((back[:, :FILTERS], a), (back[:, FILTERS:], b)):
                seen = strips[np.arange(len(rows))[:, None], at_]  # rows, filters, inputs
                grads[0] += np.einsum("rfk,rf->kf", seen, half)
                grads[1] += half.sum(axis=0)
            self.step += 1
            for p, g, s in zip(self._arrays(), grads, self.moments):
                s[0][...] = 0.9 * s[0] + 0.1 * g
                s[1][...] = 0.999 * s[1] + 0.001 * g * g
                p -= 0.01 * (s[0] / (1 - 0.9**self.step)) / (np.sqrt(s[1] / (1 - 0.999**self.step)) + 1e-8)

    def calibrate(self, x: np.ndarray, label: np.ndarray, n: np.ndarray) -> None:
        """Platt's sigmoid, and the highest threshold (0.5 at least) that keeps RECALL of the secrets.

        ``n`` findings have the logit and label.
        """
        good, bad = n[label > 0].sum(), n[label <= 0].sum()
        target = np.where(label > 0, (good + 1) / (good + 2), 1 / (bad + 2))

        def loss(ab) -> float:
            z = ab[0] * x + ab[1]
            return float((n * (np.logaddexp(0, z) - target * z)).sum())

        ab = np.array([1.0, 0.0])
        for _ in range(50):
            p = _sigmoid(ab[0] * x + ab[1])
            g = np.array([(n * (p - target) * x).sum(), (n * (p - target)).sum()])
            v = n * (p * (1 - p) + 1e-9)
            h = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + 1e-6 * np.eye(2)
            move = np.linalg.solve(h, g)
            while loss(ab - move) > loss(ab) and np.abs(move).max() > 1e-9:
                move = move / 2
            ab = ab - move
        self.platt = (float(ab[0]), float(ab[1]))
        p = _sigmoid(ab[0] * x[label > 0] + ab[1])
        order = np.argsort(p)
        upto = np.cumsum(n[label > 0][order])
        self.threshold = max(0.5, float(p[order][np.searchsorted(upto, int((1 - RECALL) * good), side="right")]))


def labelled_findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """Windows of findings with their labels: secret 1.0 or 0.0, and a hash of the window."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, labels = [], []
            for t in batches.texts(batch, text):
                found, failed = base_findings(t)
                for a, b, kind in found:
                    m = _ASSIGN.match(t, a) if kind == "assign" else None
                    rows.append(window(t, *(m.span(1) if m else (a, b))).astype(np.int8).tobytes())
                    labels.append(1.0)
                for a, b in failed + candidates(t, found) + _plain_tokens(t, found):
                    rows.append(window(t, a, b).astype(np.int8).tobytes())
                    labels.append(0.0)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(labels, pa.float64())], names=["window", "label"])

    return docs.select(text).mapInArrow(run, "window binary, label double")


_WORDY = re.compile(r"[A-Za-z0-9+/_.=@-]{12,}")


def _plain_tokens(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """A long word of the text that no rule found: what a secret is to be told from."""
    m = _WORDY.search(text, len(text) // 2)
    if not m or any(m.start() < end and start < m.end() for start, end, _ in found):
        return []
    return [m.span()]


def _examples(share: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and hashes of a share's findings, in the order of their hashes."""
    items = share.values
    windows = np.frombuffer(b"".join(items.field("window").to_pylist()), np.int8).reshape(len(items), -1)
    return windows, items.field("label").to_numpy(), items.field("h").to_numpy()


def _epoch(shares: DataFrame, network: Network, share: float, split: bool, number: int) -> None:
    """One epoch of every share from the same network, which becomes their average."""
    start = network.values()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(start) + 1)
        for batch in it:
            for name, items in zip(batch.column("share").to_pylist(), batch.column("items")):
                windows, label, h = _examples(items)
                used = h % 4 != 0 if split else np.ones(len(h), bool)
                if used.any():
                    copy = Network()
                    copy.put(start)
                    copy.epoch(windows[used], label[used], share, (11, number, name))
                    total += np.append(copy.values(), 1) * used.sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["values"])

    total = sums.merged(shares.mapInArrow(run, "values binary"), len(start) + 1)
    # in single precision, so that the order in which tasks are added up doesn't show
    network.put((total[:-1] / total[-1]).astype(np.float32).astype(np.float64))


def _logits(shares: DataFrame, network: Network, split: bool) -> DataFrame:
    """How many held-out findings have a logit (in steps) and label."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for items in batch.column("items"):
                windows, label, h = _examples(items)
                used = h % 4 == 0 if split else np.ones(len(h), bool)
                x = np.clip(network.logits(windows[used].astype(np.int64)), -LARGEST, LARGEST)
                keys, n = np.unique(np.stack([np.floor(x * STEPS), label[used]]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(n, pa.int64())], names=["x", "label", "n"])

    return shares.mapInArrow(run, "x double, label double, n long").groupBy("x", "label").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text") -> Network:
    """A network trained and calibrated on all different findings of the rows."""
    batches.ready(docs.sparkSession)
    found = labelled_findings(docs, text).distinct().withColumn("h", F.xxhash64("window"))
    found = materialize(found, "findings")
    count = {(r.label, r.held): r["count"] for r in found.groupBy("label", (F.pmod("h", F.lit(4)) == 0).alias("held")).count().collect()}
    network = Network()
    if len({label for label, _ in count}) < 2:
        return network
    split = len(count) == 4  # both kinds on both sides; else all findings serve for both
    used = {label: sum(n for (x, held), n in count.items() if x == label and not (split and held)) for label in (0.0, 1.0)}
    shares = -(-sum(count.values()) // SHARE)
    dealt = found.groupBy(F.pmod(F.shiftright("h", 8), F.lit(shares)).alias("share"))
    dealt = materialize(dealt.agg(F.array_sort(F.collect_list(F.struct("h", "window", "label"))).alias("items")), "shares")
    for number in range(EPOCHS):
        _epoch(dealt, network, used[1.0] / sum(used.values()), split, number)
    rows = sorted((r.x / STEPS, r.label, r.n) for r in _logits(dealt, network, split).collect())
    network.calibrate(*(np.array(column, float) for column in zip(*rows)))
    return network


def scan(network: Network, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each text by start; kind ``learned`` is the network's."""
    out, asked, windows = [], [], []
    for k, t in enumerate(texts):
        found, failed = base_findings(t)
        out.append(found)
        free = [f for f in failed if not any(f[0] < end and start < f[1] for start, end, _ in found)]
        for a, b in dict.fromkeys(candidates(t, found) + free):
            asked.append((k, a, b))
            windows.append(window(t, a, b))
    if asked:
        for (k, a, b), p in zip(asked, network.probabilities(np.stack(windows))):
            if p >= network.threshold:
                out[k].append((a, b, "learned"))
    order = {k: i for i, k in enumerate((*KINDS, "learned"))}
    return [sorted(f, key=lambda x: (x[0], order[x[2]])) for f in out]


def find(docs: DataFrame, network: Network, text: str = "text", out: str = "secrets") -> DataFrame:
    """The rows with their findings: array of (kind, start, end), in code points, end excluded."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in it:
            rows = [[{"kind": k, "start": a, "end": b} for a, b, k in f] for f in scan(network, batches.texts(batch, text))]
            yield batches.with_columns(batch, **{out: pa.array(rows, kind)})

    batches.ready(docs.sparkSession)
    return docs.mapInArrow(run, batches.schema_with(docs, **{out: "array<struct<kind:string,start:bigint,end:bigint>>"}))


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with spans, overlapping ones together, replaced."""
    out, at, covered = [], 0, -1
    for a, b, _ in sorted(spans):
        if a >= covered:
            out += [text[at:a], mark]
        covered = at = max(covered, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, network: Network, text: str = "text", length: str | None = None) -> DataFrame:
    """The rows with secrets replaced in their texts, and a column of text lengths brought up to date."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw = batch.column(text).to_pylist()
            found = scan(network, [t or "" for t in raw])
            new = [redacted(t, f) if f else t for t, f in zip(raw, found)]
            columns = {text: pa.array(new, batch.schema.field(text).type)}
            if length:
                old = batch.column(length).to_pylist()
                sizes = [len(t) if f else n for t, f, n in zip(new, found, old)]
                columns[length] = pa.array(sizes, batch.schema.field(length).type)
            yield batches.with_columns(batch, **columns)

    batches.ready(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
