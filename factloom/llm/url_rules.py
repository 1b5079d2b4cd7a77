"""Operator 3: URL filters by a bit-parallel wildcard automaton.

All rules are globs over a canonical URL (host and path). Their states are packed one
after the other into 64-bit words. A step takes one byte of every URL of a batch: the
states shift by one, those that the byte doesn't fit are masked out, and states before a
wildcard keep their bit (Shift-And with self-loops). The bits that carry over from one
word go into the next, so any number of rules is simulated at once.

Defined results: a null url, or one without ``://``, has an empty host and path and no
rule; a null or empty rule list leaves every url to the default; of several rules that
fit, the longest wins, then the one named first; repeated rows are judged each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm import batches

#: The verdict of the method where no rule fits.
DEFAULT = "allow"
#: URLs judged together; each needs a row of state words.
GROUP = 4096
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
_SMALL = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """A host and its subdomains, and what their paths begin with; ``text`` is how it is reported."""

    text: str
    verdict: str

    def globs(self) -> tuple[str, str]:
        """Over "host path": the host itself, and its subdomains; * in a host doesn't reach the path."""
        host, slash, path = self.text.partition("/")
        return f"{host}{slash}{path}*", f"*.{host}{slash}{path}*"


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    if not url or not (m := _PARTS.search(url)):
        return "", ""
    return m[1].translate(_SMALL), m[2]


class Automaton:
    """Globs in multiword masks. ``*`` is any run of bytes, within the host as long as no / was met."""

    def __init__(self, globs: list[str]):
        bits, step, loop, host_loop, self.first, self.last = 0, {}, [], [], [], []
        for glob in globs:
            self.first.append(bits)
            in_host = True
            for c in glob.encode():
                if c == ord("*"):
                    (host_loop if in_host else loop).append(bits)
                    continue
                in_host = in_host and c != ord("/")
                bits += 1
                step.setdefault(c, []).append(bits)
            self.last.append(bits)
            bits += 1
        self.words = max(1, -(-bits // 64))
        self.start = self._mask(self.first)
        self.step = np.zeros((256, self.words), np.uint64)
        for c, at in step.items():
            self.step[c] = self._mask(at)
        self.loop = np.repeat(self._mask(loop + host_loop)[None], 256, axis=0)
        self.loop[ord("/")] = self._mask(loop)

    def _mask(self, bits: list[int]) -> np.ndarray:
        mask = np.zeros(self.words, np.uint64)
        for b in bits:
            mask[b >> 6] |= np.uint64(1) << np.uint64(b & 63)
        return mask

    def accepted(self, texts: list[bytes]) -> np.ndarray:
        """(texts, globs) whether a glob fits the whole text."""
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        length = np.array([len(texts[k]) for k in order])
        state = np.repeat(self.start[None], len(texts), axis=0)
        flat = np.frombuffer(b"".join(texts[k] for k in order), np.uint8)
        begin = np.cumsum(length) - length
        one, top = np.uint64(1), np.uint64(63)
        for k in range(int(length.max(initial=0))):
            live = np.searchsorted(-length, -k)  # the texts with a byte here come first
            c, s = flat[begin[:live] + k], state[:live]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:live] = moved & self.step[c] | s & self.loop[c]
        out = np.zeros((len(texts), len(self.last)), bool)
        for g, b in enumerate(self.last):
            out[order, g] = (state[:, b >> 6] >> np.uint64(b & 63) & one) > 0
        return out


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per page: key, host, path, rule (null if none fits) and verdict."""
    batches.ready(pages.sparkSession)
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].text), k))
    automaton = Automaton([g for k in order for g in rules[k].globs()])
    best = [rules[k] for k in order]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                split = [canonical(u) for u in part.column(url).to_pylist()]
                fits = automaton.accepted([(h + p).encode("utf-8", "surrogatepass") if h else b"" for h, p in split])
                fits = fits.reshape(len(split), len(best), 2).any(axis=2)
                first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1).tolist() if best else [-1] * len(split)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array([h for h, _ in split]), pa.array([p for _, p in split]),
                     pa.array([best[k].text if k >= 0 else None for k in first], pa.string()),
                     pa.array([best[k].verdict if k >= 0 else default for k in first])],
                    names=[key, "host", "path", "rule", "verdict"],
                )

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url).mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")
