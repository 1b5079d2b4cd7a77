"""Operator 1: byte-level BPE encoding and decoding.

Merges are taken from a hierarchical-bitmap rank queue. Each merge rank has a
bucket of positions of the linked list of symbols; a two-level bitmap over the
ranks gives the lowest rank that has a bucket (find-first-set at each level).
An entry whose pair has changed since it was put in is stale and skipped when it
comes out. The cost of a pre-token of n bytes is O(n) queue steps, so one of a
hundred thousand bytes is no trouble.

Defined results: a null text is encoded as the empty text (no ids); texts are
whole; repeated rows are encoded each; other columns pass through unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from factloom.llm import batches

#: Entries that a Python worker keeps of pre-tokens, and of chunks, met before; a cache is emptied when full.
CACHE_ENTRIES = 500_000
#: Bytes of pre-tokens that share one queue; a longer pre-token has one to itself.
GROUP_BYTES = 1 << 14
#: Longest chunk, in characters, that is worth a place in a cache.
CACHE_CHARS = 64
#: Unicode white space as patterns see it; str.split() knows four control characters more.
SPACE = "\t-\r \x85\xa0  -     　"
_SPACE_BEFORE_SPACE = regex.compile(f"[{SPACE}] ")
_CHUNK = regex.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


#: Ranks under one word of the lower bitmap level. Python's integers have no fixed width, so two levels reach far.
WORD_BITS = 256


def _keep(cache: dict[str, bytes], new: dict[str, bytes]) -> None:
    if len(cache) + len(new) > CACHE_ENTRIES:
        cache.clear()
    cache.update((k, v) for k, v in new.items() if len(k) <= CACHE_CHARS)


class Encoder:
    """Encoding by a table of ranks, as one Python worker holds it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.vocab = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.words = [0] * (len(self.vocab) // WORD_BITS + 1)  # all zero between two pre-tokens
        self.by_piece: dict[str, bytes] = {}
        self.by_chunk: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, as little-endian 32-bit integers.

        The pre-tokens lie one after the other in one linked list and share one queue; ``before``
        is -1 where one begins, and no pair reaches across. ``top`` has a bit for each word of
        ``words`` that isn't zero, and a word has a bit for each rank with a bucket.
        """
        ranks, get, words, top = self.ranks, self.ranks.get, self.words, 0
        data = b"".join(pieces)
        n = len(data)
        buckets: dict[int, list[int]] = {}
        after, before = list(range(1, n + 2)), list(range(-1, n))
        now: list[int | None] = list(map(get, map(data.__getitem__, map(slice, range(n), range(2, n + 2)))))
        starts, at = [], 0  # now: rank of the pair that begins at a position, as of now
        for piece in pieces:
            starts.append(at)
            before[at] = -1
            at += len(piece)
            now[at - 1] = None
        before[n] = -1
        now.append(None)
        fresh = [(i, r) for i, r in enumerate(now) if r is not None]
        while True:
            for i, r in fresh:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    w = r >> 8
                    words[w] |= 1 << (r & 255)
                    top |= 1 << w
            if not top:
                break
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = (w << 8) + (word & -word).bit_length() - 1
            words[w] = word = word & (word - 1)
            if not word:
                top &= top - 1
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()
            fresh, least = [], rank
            for at, i in enumerate(positions):
                if now[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[j]
                now[i] = now[j] = None
                after[i] = k
                p = before[i]
                if before[k] >= 0:
                    before[k] = i
                    r = get(data[i : after[k]])
                    if r is not None:
                        now[i] = r
                        fresh.append((i, r))
                        if r < least:
                            least = r
                if p >= 0:
                    now[p] = r = get(data[p:k])
                    if r is not None:
                        fresh.append((p, r))
                        if r < least:
                            least = r
                if least < rank:  # the new pair goes before the rest of this rank
                    fresh += [(q, rank) for q in positions[at + 1 :] if now[q] == rank]
                    break
        out = []
        for i, piece in zip(starts, pieces):
            end, ids = i + len(piece), []
            while i < end:
                ids.append(ranks[data[i : after[i]]])
                i = after[i]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def _merge_new(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens not met before; long lists are worked off in groups."""
        out: dict[str, bytes] = {}
        group: list[str] = []
        data: list[bytes] = []
        size = 0
        for k, piece in enumerate(pieces):
            raw = piece.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                out[piece] = struct.pack("<I", whole)
            else:
                group.append(piece)
                data.append(raw)
                size += len(raw)
            if group and (size >= GROUP_BYTES or k == len(pieces) - 1):
                out.update(zip(group, self.merge(data)))
                group, data, size = [], [], 0
        return out

    def _new_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        cut = [self.pieces(chunk) for chunk in chunks]
        known = self.by_piece
        missing = {p for pieces in cut for p in pieces if p not in known}
        made = self._merge_new(list(missing))
        out = {c: b"".join([known.get(p) or made[p] for p in pieces]) for c, pieces in zip(chunks, cut)}
        _keep(known, made)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers.

        A text is first cut where no match of the pattern can reach across: before a space
        that follows something other than white space. Chunks met before are looked up.
        """
        known = self.by_chunk
        cut, found, missing = [], [], set()
        for text in texts:
            if _SPACE_BEFORE_SPACE.search(text):
                chunks = _CHUNK.findall(text)
            else:
                chunks = text.replace(" ", "\0 ").split("\0") if "\0" not in text else _CHUNK.findall(text)
            ids = list(map(known.get, chunks))
            cut.append(chunks)
            found.append(ids)
            if None in ids:
                missing.update([c for c, x in zip(chunks, ids) if x is None])
        made = self._new_chunks(list(missing))
        _keep(known, made)
        return [
            b"".join(ids if None not in ids else [made[c] if x is None else x for c, x in zip(chunks, ids)])
            for chunks, ids in zip(cut, found)
        ]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from the text of a .tiktoken file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


_encoders: dict[str, Encoder] = {}


def encoder_for(content: bytes, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary; built once for each worker."""
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(read_ranks(content), pattern)
    return _encoders[key]


def _mapped(docs: DataFrame, vocab_path: str, pattern: str, schema: str, per_batch: Callable) -> DataFrame:
    spark = batches.ready(docs.sparkSession)
    with open(vocab_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary file; its size is that of the vocabulary

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(content.value, pattern)
        for batch in it:
            yield per_batch(encoder, batch)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, vocab_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add a column of token ids (array of int) to every row; a column of that name is replaced."""

    def per_batch(encoder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [np.frombuffer(x, "<i4") for x in encoder.encode(batches.texts(batch, text))]
        ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
        flat = np.concatenate(got) if got else np.zeros(0, "<i4")
        return batches.with_columns(batch, **{ids: pa.ListArray.from_arrays(ends, flat)})

    return _mapped(docs, vocab_path, pattern, batches.schema_with(docs, **{ids: "array<int>"}), per_batch)


def decode(encoded: DataFrame, vocab_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that a column of ids stands for (binary); null ids give no bytes."""

    def per_batch(encoder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [b"".join(map(encoder.vocab.__getitem__, x or ())) for x in batch.column(ids).to_pylist()]
        return batches.with_columns(batch, **{out: pa.array(rows, pa.binary())})

    return _mapped(encoded, vocab_path, pattern, batches.schema_with(encoded, **{out: "binary"}), per_batch)


def digest(docs: DataFrame, vocab_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode the ids again, and return counts and digests of both."""

    def per_batch(encoder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b = [], [], []
        for ids in encoder.encode(batches.texts(batch, text)):
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(key), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
            names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs.select(key, text), vocab_path, pattern, schema, per_batch)
