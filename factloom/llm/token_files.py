"""Operator 8: token ids as binary files of patched frame-of-reference blocks.

A shard is a run of documents in ascending key order. Its ids lie in blocks of 256. A
block subtracts its minimum and packs the differences at a width that holds nine tenths
of them, as bit planes; those that don't fit are patched from an exception list. The
header gives the start of every block, so one can be read without those before it. A
shard file is written as a row of a Parquet table by Spark's own committer, so a lost
task leaves no half file; its documents' starts are in an index table beside it.

Shard bytes (little-endian): b"PFR1", ids u32, blocks u32, then for each block its start
u32; a block is: minimum u32, width u8, exceptions u16, planes (32 bytes for each bit),
positions of exceptions u8 each, their differences u32 each.

Defined results: special tokens' strings inside a text are those tokens, as the library takes them
by default; a null text is the empty text, which gives the end id alone; rows that
repeat a key are written each, next to one another; rows without a key come first;
other columns are not used. An empty table gives no shards and an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import batches, words
from factloom.session import write_shared

BLOCK = 256
#: Share of a block's differences that its width must hold.
HELD = 0.9
#: Ids after which a shard is closed.
SHARD_IDS = 1 << 20
CACHE_ENTRIES = 500_000
#: Words that go through the tokenizer as one text.
WORDS_TOGETHER = 256
_MAGIC = b"PFR1"
#: What a word can be made of here; a chunk with anything else goes through the tokenizer as it is.
_PLAIN = regex.compile("[!-~¡-ſ]+")
_WORD_OR_BREAK = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")


def _lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray) -> bytes:
    """A shard's bytes."""
    n = len(ids)
    count = -(-n // BLOCK)
    grid = np.zeros((count, BLOCK), np.uint32)
    grid.reshape(-1)[:n] = ids
    if count:
        grid.reshape(-1)[n:] = grid[-1, : n - (count - 1) * BLOCK].min()
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    width = _lengths(np.sort(rest, axis=1)[:, int(HELD * BLOCK) - 1])
    planes: list[bytes] = [b""] * count
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        bits = [np.packbits((rest[rows] >> np.uint32(k) & 1).astype(np.uint8), axis=1) for k in range(w)]
        packed = np.concatenate(bits, axis=1) if w else np.zeros((len(rows), 0), np.uint8)
        for row, data in zip(rows.tolist(), packed):
            planes[row] = data.tobytes()
    over = rest >> width[:, None].astype(np.uint32) > 0
    at, position = np.nonzero(over)
    ends = np.searchsorted(at, np.arange(count + 1))
    position, patch = position.astype(np.uint8), rest[over].astype("<u4")
    body, starts, size = [], [], 12 + 4 * count
    for row in range(count):
        a, b = ends[row], ends[row + 1]
        block = struct.pack("<IBH", low[row], width[row], b - a) + planes[row] + position[a:b].tobytes() + patch[a:b].tobytes()
        starts.append(size)
        size += len(block)
        body.append(block)
    return _MAGIC + struct.pack("<II", n, count) + np.array(starts, "<u4").tobytes() + b"".join(body)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks first to last (excluded) of a shard, or all."""
    if data[:4] != _MAGIC:
        raise ValueError("not a shard")
    n, count = struct.unpack_from("<II", data, 4)
    starts = np.frombuffer(data, "<u4", count, 12)
    last = count if last is None else min(last, count)
    heads = [struct.unpack_from("<IBH", data, s) for s in starts[first:last].tolist()]
    out = np.zeros((max(0, last - first), BLOCK), np.uint32)
    width = np.array([h[1] for h in heads], np.int64)
    raw = np.frombuffer(data, np.uint8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            at = starts[first + rows].astype(np.int64)[:, None] + 7 + np.arange(32 * w)
            bits = np.unpackbits(raw[at].reshape(len(rows), w, 32), axis=2)
            values = np.zeros((len(rows), BLOCK), np.uint32)
            for k in range(w):
                values |= bits[:, k].astype(np.uint32) << np.uint32(k)
            out[rows] = values
    for row, (low, w, exceptions) in enumerate(heads):
        if exceptions:
            at = int(starts[first + row]) + 7 + 32 * w
            out[row, raw[at : at + exceptions]] = np.frombuffer(data, "<u4", exceptions, at + exceptions)
        out[row] += np.uint32(low)
    return out.reshape(-1)[: max(0, n - first * BLOCK)] if last == count else out.reshape(-1)


class Encoder:
    """Encoding by a tokenizer of the tokenizers library; chunks between white space met before are looked up.

    Chunks of many texts are hashed at once (64 bits, see ``words``) and found in a table of open addresses that
    points into a pool of ids.
    """

    def __init__(self, content: bytes):
        self.tokenizer = Tokenizer.from_str(content.decode())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a word
        self.last[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.slots = np.zeros(4 * CACHE_ENTRIES, np.int64)  # number of an entry, 0 for none
        self.hashes = np.zeros(2 * CACHE_ENTRIES, np.uint64)
        self.start = np.zeros(2 * CACHE_ENTRIES + 1, np.int64)
        self.pool = np.zeros(8 * CACHE_ENTRIES, np.uint32)
        self.entries, self.pooled = 0, 0

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in encoded]

    def _plain(self, chunks: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and sizes of chunks of Latin letters: many go through the tokenizer as one text, cut by their numbers of words."""
        # a line break keeps the chunks apart, so one search cuts them all
        cut = _WORD_OR_BREAK.findall("\n".join(chunks).lower() + "\n")
        lengths = np.diff(np.flatnonzero(np.array(cut) == "\n"), prepend=-1) - 1
        groups = [slice(k, k + WORDS_TOGETHER) for k in range(0, len(chunks), WORDS_TOGETHER)]
        flat, sizes = [], []
        for group, ids in zip(groups, self._direct([" ".join(chunks[g]) for g in groups])):
            ends, count = np.flatnonzero(self.last[ids]) + 1, lengths[group]
            if len(ends) == count.sum() and count.all():
                flat.append(ids)
                sizes.append(np.diff(ends[np.cumsum(count) - 1], prepend=0))
            else:
                each = self._direct(chunks[group])
                flat += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        return flat, sizes

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry numbers of hashes; 0 where there is none."""
        at = (hashes % np.uint64(len(self.slots))).astype(np.int64)
        found = self.slots[at]
        open_ = np.flatnonzero((found > 0) & (self.hashes[found - 1] != hashes))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slots)
            found[open_] = self.slots[at[open_]]
            open_ = open_[(found[open_] > 0) & (self.hashes[found[open_] - 1] != hashes[open_])]
        return found

    def _add(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        first, last, pooled = self.entries, self.entries + len(size), self.pooled + len(ids)
        if pooled > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(pooled, np.uint32)])
        if last > len(self.hashes):  # a very long text has more chunks than the table is made for
            self.hashes = np.concatenate([self.hashes, np.zeros(last, np.uint64)])
            self.start = np.concatenate([self.start, np.zeros(last, np.int64)])
            self.slots = np.zeros(3 * len(self.hashes), np.int64)
            self._place(np.arange(1, first + 1))
        self.hashes[first:last] = hashes
        self.pool[self.pooled : pooled] = ids
        self.start[first + 1 : last + 1] = self.pooled + np.cumsum(size)
        self.entries, self.pooled = last, pooled
        self._place(np.arange(first + 1, last + 1))

    def _place(self, number: np.ndarray) -> None:
        at = (self.hashes[number - 1] % np.uint64(len(self.slots))).astype(np.int64)
        while len(number):
            free = self.slots[at] == 0
            self.slots[at[free]] = number[free]  # of several for one place the last stays
            rest = self.slots[at] != number
            number, at = number[rest], (at[rest] + 1) % len(self.slots)

    def _encoded(self, hashes: np.ndarray, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks' hashes in the order in which they were encoded, all ids, and how many each has."""
        fits = np.array([_PLAIN.fullmatch(c) is not None for c in chunks], bool)
        flat, sizes = self._plain([chunks[k] for k in np.flatnonzero(fits).tolist()])
        other = self._direct([chunks[k] for k in np.flatnonzero(~fits).tolist()])
        flat += other
        sizes.append(np.array([len(x) for x in other], np.int64))
        return np.concatenate([hashes[fits], hashes[~fits]]), np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate(sizes)

    def _together(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(raw) + b"\n"
        begin, hashes = words.hashed(data)
        if self.entries > CACHE_ENTRIES or self.pooled > len(self.pool) // 2:
            self._empty()
        entry = self._find(hashes)
        missing = np.flatnonzero(entry == 0)
        if len(missing):
            space = np.flatnonzero(words.spaces(data))
            new, first = np.unique(hashes[missing], return_index=True)
            at = begin[missing[first]]
            until = space[np.searchsorted(space, at)]
            chunks = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at.tolist(), until.tolist())]
            self._add(*self._encoded(new, chunks))
            entry = self._find(hashes)
        size = self.start[entry] - self.start[entry - 1]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.start[entry - 1] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.searchsorted(begin, np.cumsum([len(r) + 1 for r in raw]))
        cut = np.concatenate(([0], ends))[cut].tolist()
        packed = ids.astype("<u4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip([0, *cut], cut)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, without special tokens.

        The tokenizer drops white space and joins nothing across it, so chunks are encoded on their own. A special
        token's string in a text is that token, wherever it stands; such texts go through the tokenizer whole.
        """
        whole = [any(t in text for t in self.special) if "<" in text else False for text in texts]
        out: list = [b""] * len(texts)
        group, size = [], 0
        for k, text in enumerate(texts):
            if whole[k]:
                out[k] = self._direct([text])[0].astype("<u4").tobytes()
                continue
            group.append(k)
            size += len(text)
            if size >= words.CHUNK_BYTES // 2:
                for g, ids in zip(group, self._together([texts[g] for g in group])):
                    out[g] = ids
                group, size = [], 0
        if group:
            for g, ids in zip(group, self._together([texts[g] for g in group])):
                out[g] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder_for(content: bytes) -> Encoder:
    key = hashlib.sha256(content).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(content)
    return _encoders[key]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> str:
    """Encode every text, append the end id, write shards in ascending key order; returns the table's path.

    Columns: part, shard (number in its part), data (the shard's bytes), docs (key and count of ids of
    each document, in order), n_ids.
    """
    spark = batches.ready(docs.sparkSession)
    with open(tokenizer_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary file; its size is that of the vocabulary
    kind = docs.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = encoder_for(content.value), TaskContext.get().partitionId(), 0
        ids, keys, counts, size = [], [], [], 0
        end = struct.pack("<I", end_id)

        def close() -> pa.RecordBatch:
            pairs = pa.StructArray.from_arrays([pa.concat_arrays(keys), pa.array(counts, pa.int64())], ["key", "n"])
            listed = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)
            data = pack(np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([shard]), pa.array([data], pa.binary()), listed, pa.array([size])],
                names=["part", "shard", "data", "docs", "n_ids"],
            )

        for batch in it:
            for k, got in enumerate(encoder.encode(batches.texts(batch, text))):
                ids.append(got + end)
                keys.append(batch.column(key).slice(k, 1))
                counts.append(len(got) // 4 + 1)
                size += counts[-1]
                if size >= SHARD_IDS:
                    yield close()
                    shard += 1
                    ids, keys, counts, size = [], [], [], 0
        if ids:
            yield close()

    ordered = docs.select(key, text).repartitionByRange(key).sortWithinPartitions(key)
    schema = f"part long, shard long, data binary, docs array<struct<key:{kind},n:bigint>>, n_ids long"
    return write_shared(ordered.mapInArrow(run, schema), "token-files")


def read_token_files(files: DataFrame, kind: str) -> DataFrame:
    """One row per document from shards: key, ids (array of int), start in its shard, part, shard."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shard, listed, counts, ids in _documents(it):
            ends = np.cumsum([0, *counts])
            yield pa.RecordBatch.from_arrays(
                [listed.field("key"), pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.int32)),
                 pa.array(ends[:-1]), pa.array([part] * len(counts), pa.int64()), pa.array([shard] * len(counts), pa.int64())],
                names=["key", "ids", "start", "part", "shard"],
            )

    return files.select("part", "shard", "data", "docs").mapInArrow(
        run, f"key {kind}, ids array<int>, start long, part long, shard long"
    )


def _documents(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in it:
        for k in range(batch.num_rows):
            listed = batch.column("docs").slice(k, 1).flatten()
            counts = listed.field("n").to_numpy(zero_copy_only=False)
            yield (batch.column("part")[k].as_py(), batch.column("shard")[k].as_py(), listed, counts,
                   unpack(batch.column("data")[k].as_py()))


def digests(path: str, spark, kind: str) -> DataFrame:
    """Read shards back: key, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shard, listed, counts, ids in _documents(it):
            ends, raw = np.cumsum([0, *counts]), ids.astype("<u4")
            crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [listed.field("key"), pa.array(ends[:-1]), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()),
                 pa.array([part] * n, pa.int64()), pa.array([shard] * n, pa.int64())],
                names=["key", "inside", "n_tokens", "ids_crc32", "part", "shard"],
            )

    rows = files.select("part", "shard", "data", "docs").mapInArrow(
        run, f"key {kind}, inside long, n_tokens long, ids_crc32 long, part long, shard long"
    )
    sizes = files.groupBy("part", "shard").agg(F.sum("n_ids").alias("n"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base"))
    starts = sizes.select("part", "shard", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("before")).join(parts, "part")
    return rows.join(starts, ["part", "shard"]).select(
        "key", (F.col("base") + F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
