"""Words of many texts at once, as 64-bit hashes.

Words are what lies between the six ASCII white-space bytes, A-Z lower-cased. A
word's hash is a polynomial over random byte values modulo 2^64, taken from
prefix sums over the whole buffer, so the cost is a few array passes for each
byte. Equal words have equal hashes in every task and run; two different words
collide with a probability near 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at a time.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers


def spaces(buffer: bytes) -> np.ndarray:
    """Whether each byte is white space."""
    return _SPACE[np.frombuffer(buffer, np.uint8)]


def hashed(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of a lower-cased buffer that ends in white space."""
    b = np.frombuffer(buffer, np.uint8)
    n = len(b)
    power, inverse = _power_tables(n + 1)
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if n and not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[b] * power[:n], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * inverse[start])


#: A-Z lower-cased, as for plain words, and ASCII punctuation turned into spaces.
BARE = bytes(32 if 32 < c < 128 and not chr(c).isalnum() else c + 32 * (65 <= c <= 90) for c in range(256))


def of_texts(texts: list[str], table: bytes | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of consecutive texts: the first one's number, the word hashes, and each text's end among them.

    ``table`` maps the bytes first (BARE for words without punctuation); else A-Z are lower-cased.
    """
    group, size, first = [], 0, 0
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        raw = raw.translate(table) if table else raw.lower()  # bytes.lower() changes A-Z only
        group.append(raw)
        size += len(raw) + 1
        if size >= CHUNK_BYTES or k == len(texts) - 1:
            start, word = hashed(b"\n".join(group) + b"\n")
            ends = np.cumsum([len(g) + 1 for g in group])
            yield first, word, np.searchsorted(start, ends)
            group, size, first = [], 0, k + 1


def of_text(text: str, table: bytes | None = None) -> np.ndarray:
    return next(of_texts([text], table))[1]


def shingles(word: np.ndarray, ends: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of ``width`` words.

    A text with fewer words has one: its whole sequence. A text without words has none.
    """
    weight = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(word)
    if n >= width:
        runs = word[: n - width + 1] * weight[0]
        for k in range(1, width):
            runs += word[k : n - width + 1 + k] * weight[k]
        runs = mix(runs)
    at = 0
    for end in ends.tolist():
        count = end - at
        if count >= width:
            s = np.sort(runs[at : end - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif count:
            yield mix((word[at:end] * weight[:count]).sum(keepdims=True) + np.uint64(count))
        else:
            yield word[:0]
        at = end
