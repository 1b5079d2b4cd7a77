"""Operator 11: token counts by a compiled finite-state tokenizer.

Two deterministic transducers stand for a byte-level BPE tokenizer, and no token is made.

The *splitter* reads code points by class and emits where a piece (pre-token) begins, at this
code point or, with one symbol's delay, at the one before. A run of texts is cut into chunks;
each chunk's map from every state it may be entered in to the state it is left in is taken for
all chunks at once, the maps compose through a parallel prefix scan, and a second pass emits.

The *merger* reads the bytes of a piece. A transition carries how many tokens the piece so far
has more (or fewer) than before. What can still happen depends on the places where a token may
yet begin, the token before each, and the tokens counted up to there: that is a state, so
different beginnings meet in one state once they can no longer differ. A sequence of tokens is
an encoding exactly if each pair of neighbours is one, which gives the last token of every
beginning. States are made when first met and kept by the worker; all pieces of a batch step
together.

Defined results: a null text is the empty text (no bytes, no tokens); special tokens' strings
inside a text count as one token each, as the library takes them; texts are whole, pieces of
any length take one step a byte; repeated rows and rows without a key are counted each; an
empty table gives an empty result; other columns of whatever name aren't used. Tokenizers
with a normalizer, another pre-tokenizer than byte level, dropout or special tokens that
swallow white space are refused.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from factloom.llm import batches

#: Code points of a chunk of the splitter.
CHUNK = 64
#: States of the merger that a worker keeps; beyond it starts anew with the next batch.
MAX_STATES = 1 << 18
#: Pieces left in step below which each is followed on its own.
FEW = 8
#: Lone surrogates, which no Arrow text holds: end of a text, and a special token's place.
_END, _SPECIAL = "\ud800", "\ud801"

# classes of code points
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, ONE, R_V, E, L, BREAK = range(11)
# states: begin anew; in a run of letters, numbers, others; one blank; one other space; more than one, by the last;
# a quote that began a piece, and such a quote with r or v, or l, after it
ANEW, LETTERS, NUMBERS, OTHERS, BLANK1, SPACE1, BLANKS, SPACES, QUOTED, QUOTED_RV, QUOTED_L = range(11)
HERE, BEFORE = 1, 2
_IS_LETTER = (LETTER, ONE, R_V, E, L)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(class, state) -> next state, and what is emitted: a piece begins HERE, or BEFORE.

    The pattern: 's 't 'm 'd 're 've 'll | optional blank and letters, numbers, or others |
    white space up to its last character | white space.
    """
    fresh = {NUMBER: NUMBERS, OTHER: OTHERS, BLANK: BLANK1, SPACE: SPACE1, QUOTE: QUOTED, BREAK: ANEW}
    fresh |= dict.fromkeys(_IS_LETTER, LETTERS)
    run = {LETTERS: _IS_LETTER, NUMBERS: (NUMBER,), OTHERS: (OTHER, QUOTE)}
    step, emit = np.zeros((11, 11), np.uint8), np.zeros((11, 11), np.uint8)

    def after(c: int, s: int) -> tuple[int, int]:
        for target, classes in run.items():
            if c in classes and s in (target, BLANK1):
                return target, 0
            if c in classes and s == BLANKS:
                return target, BEFORE
        if c in (BLANK, SPACE) and s in (BLANK1, SPACE1, BLANKS, SPACES):
            return (BLANKS if c == BLANK else SPACES), 0
        if s == SPACES and c != BREAK:
            return fresh[c], HERE | BEFORE
        if s == QUOTED and c in (OTHER, QUOTE):
            return OTHERS, 0
        if s == QUOTED and c in (ONE, R_V, L):
            return {ONE: ANEW, R_V: QUOTED_RV, L: QUOTED_L}[c], 0
        if s in (QUOTED_RV, QUOTED_L):
            if c == (E if s == QUOTED_RV else L):
                return ANEW, 0
            target, out = after(c, LETTERS)  # no contraction: the letter began a run
            return target, out | BEFORE
        return fresh[c], HERE

    for c in range(11):
        for s in range(11):
            step[c, s], emit[c, s] = after(c, s)
    return step, emit


STEP, EMIT = _splitter()


def splits(classes: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point, given the classes of texts that end in BREAK."""
    n, states = len(classes), STEP.shape[1]
    count = -(-n // CHUNK)
    grid = np.full(count * CHUNK, BREAK, np.int32)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(count, CHUNK).T) * states
    step, emit = STEP.reshape(-1), EMIT.reshape(-1)
    maps = np.tile(np.arange(states, dtype=np.uint8), (count, 1))
    for row in grid:
        maps = step[row[:, None] + maps]
    shift = 1
    while shift < count:  # after each round a map reaches over twice as many chunks
        reach = maps.copy()
        reach[shift:] = np.take_along_axis(maps[shift:], maps[:-shift], axis=1)
        maps, shift = reach, 2 * shift
    state = np.full(count, ANEW, np.uint8)
    state[1:] = maps[:-1, ANEW]
    out = np.empty((CHUNK, count), np.uint8)
    for k, row in enumerate(grid):
        at = row + state
        out[k], state = emit[at], step[at]
    out = out.T.reshape(-1)[:n]
    begins = (out & HERE) > 0
    begins[:-1] |= (out[1:] & BEFORE) > 0
    return begins


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code point, letters and numbers as the library knows them."""
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    number = np.frombuffer(points.encode("utf-32-le"), "<u4")
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        inside = np.ones(len(points), bool)
        for _, (a, b) in Split(Regex(pattern), "removed").pre_tokenize_str(points):
            inside[a:b] = False
        table[number[inside]] = c
    for chars, c in ((" ", BLANK), ("'", QUOTE), ("stmd", ONE), ("rv", R_V), ("e", E), ("l", L), (_END + _SPECIAL, BREAK)):
        table[[ord(x) for x in chars]] = c
    return table


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merger:
    """The transducer over the bytes of a piece, made state by state."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.id = vocabulary
        self.bytes = {i: t for t, i in vocabulary.items()}
        self.merges = {(vocabulary[a], vocabulary[b]): (r, vocabulary[a + b]) for r, (a, b) in enumerate(merges)}
        self.beginnings = {t[:k] for t in vocabulary for k in range(len(t))}
        self.own = {t for t, i in vocabulary.items() if self._merged(t) == [i]}  # tokens that their own bytes give
        self._restart()

    def _restart(self) -> None:
        self.pairs: dict[tuple[int, int], bool] = {}
        self.number: dict[tuple, int] = {}
        self.state: list[tuple] = []
        self.moves: dict[int, int] = {}
        self.keys = np.full(1 << 16, -1, np.int64)
        self.values = np.zeros(1 << 16, np.int64)
        self.start = self._numbered((b"", ((0, -1, 0),)))

    def _numbered(self, state: tuple) -> int:
        k = self.number.setdefault(state, len(self.state))
        if k == len(self.state):
            self.state.append(state)
        return k

    def _merged(self, raw: bytes) -> list[int]:
        """Ids of a short byte string, merged one pair after the other."""
        ids = [self.id[raw[k : k + 1]] for k in range(len(raw))]
        while len(ids) > 1:
            rank, k, made = self._lowest(ids)
            if rank is None:
                break
            ids[k : k + 2] = [made]
        return ids

    def _lowest(self, ids: list[int]) -> tuple:
        """Rank, place and result of the first merge, or three times None."""
        best = (None, None, None)
        for k, pair in enumerate(zip(ids, ids[1:])):
            merge = self.merges.get(pair)
            if merge and (best[0] is None or merge[0] < best[0]):
                best = (merge[0], k, merge[1])
        return best

    def _follows(self, a: int, b: int) -> bool:
        """Whether token b can stand after token a in an encoding."""
        got = self.pairs.get((a, b))
        if got is None:
            got = self.pairs[a, b] = self._merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return got

    def move(self, key: int) -> int:
        """The transition of (state << 8 | byte): next state << 16 | tokens gained + 32768.

        A state is the bytes from the first place where a token may yet begin, and for each such
        place its distance, the token that ends there, and the tokens up to there less those of now.
        """
        tail, places = self.state[key >> 8]
        tail += bytes([key & 255])
        n = len(tail) - 1
        for distance, token, tokens in places:
            last = tail[n - distance :]
            if last in self.own and (token < 0 or self._follows(token, self.id[last])):
                break
        gained = tokens + 1
        open_places = [(d + 1, t, c - gained) for d, t, c in places if tail[n - d :] in self.beginnings]
        open_places.append((0, self.id[last], 0))
        into = self._numbered((tail[len(tail) - open_places[0][0] :], tuple(open_places)))
        self.moves[key] = packed = into << 16 | gained + 32768
        return packed

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        if 2 * len(self.moves) > len(self.keys):
            size = 4 * len(self.keys)
            self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int64)
            keys = np.fromiter(self.moves.keys(), np.int64, len(self.moves))
            values = np.fromiter(self.moves.values(), np.int64, len(self.moves))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            stays = self.keys[slot] == keys
            self.values[slot[stays]] = values[stays]
            keys, values, slot = keys[~stays], values[~stays], (slot[~stays] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = self.values[slot]
        off = np.flatnonzero(held != keys)
        if len(off):
            want, at, missing = keys[off], slot[off], []
            while len(off):
                empty = self.keys[at] < 0
                if empty.any():
                    missing.append(off[empty])
                    off, want, at = off[~empty], want[~empty], at[~empty]
                at = (at + 1) & (len(self.keys) - 1)
                hit = self.keys[at] == want
                out[off[hit]] = self.values[at[hit]]
                off, want, at = off[~hit], want[~hit], at[~hit]
            if missing:
                rows = np.concatenate(missing)
                new, back = np.unique(keys[rows], return_inverse=True)
                made = np.array([self.move(k) for k in new.tolist()], np.int64)
                out[rows] = made[back]
                self._put(new, made)
        return out

    def counts(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of the pieces data[start:end]."""
        if len(self.state) > MAX_STATES:
            self._restart()
        length = end - start
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        flat = np.frombuffer(data, np.uint8)
        state = np.full(len(order), self.start, np.int64)
        tokens = np.zeros(len(order), np.int64)
        live = np.searchsorted(-length, -np.arange(int(length.max(initial=0)) + 1))  # pieces longer than k bytes
        k = 0
        while k < len(live) and live[k] >= FEW:
            m = live[k]
            moved = self._find(state[:m] << 8 | flat[start[:m] + k])
            state[:m] = moved >> 16
            tokens[:m] += (moved & 65535) - 32768
            k += 1
        get = self.moves.get
        for lane in range(int(live[k]) if k < len(live) else 0):
            s, gained = int(state[lane]), 0
            for b in data[start[lane] + k : start[lane] + length[lane]]:
                moved = get(s << 8 | b) or self.move(s << 8 | b)
                s = moved >> 16
                gained += (moved & 65535) - 32768
            tokens[lane] += gained
        out = np.empty_like(tokens)
        out[order] = tokens
        return out


class Counter:
    """A compiled tokenizer, as one Python worker holds it."""

    def __init__(self, content: bytes, classes: bytes):
        described = json.loads(content)
        model, cut = described["model"], described["pre_tokenizer"] or {}
        special = described["added_tokens"]
        plain = model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
        )
        whole = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
        if not plain or not whole or described["normalizer"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError("only byte-level BPE with its own pattern and plain special tokens can be compiled")
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        strings = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, strings))) if strings else None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merger = Merger(
            {raw(t): i for t, i in model["vocab"].items() if t not in strings}, [(raw(a), raw(b)) for a, b in pairs]
        )
        self.classes = np.frombuffer(classes, np.uint8)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if self.special:
            texts = [self.special.sub(_SPECIAL, t) for t in texts]
        joined = "".join([t + _END for t in texts])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        width = np.ones(len(points), np.int64)
        for limit in (0x7F, 0x7FF, 0xFFFF):
            width += points > limit
        begin = np.flatnonzero(splits(self.classes[points]))
        offset = np.cumsum(width) - width
        first = points[begin]
        start = offset[begin]
        end = np.append(start[1:], offset[-1] + width[-1] if len(points) else 0)
        end, piece = end[: len(start)], (first != ord(_END)) & (first != ord(_SPECIAL))
        tokens = (first == ord(_SPECIAL)).astype(np.int64)
        tokens[piece] = self.merger.counts(joined.encode("utf-8", "surrogatepass"), start[piece], end[piece])
        sums = np.concatenate(([0], np.cumsum(tokens)))[np.flatnonzero(first == ord(_END))]
        return np.diff(sums, prepend=0)


_counters: dict[str, Counter] = {}


def counter_for(content: bytes, classes: bytes) -> Counter:
    """The worker's compiled tokenizer; built once for each worker."""
    key = hashlib.sha256(content + classes).hexdigest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(content, classes)
    return _counters[key]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes (UTF-8), n_tokens, over_limit (more tokens than the limit)."""
    spark = batches.ready(docs.sparkSession)
    with open(tokenizer_path, "rb") as f:  # a vocabulary file and a table of code points: both of fixed size
        held = spark.sparkContext.broadcast((f.read(), class_table().tobytes()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(*held.value)
        for batch in it:
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("n_bytes"), pa.array(counter.count(batches.texts(batch, text)))],
                names=[key, "n_bytes", "n_tokens"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
