"""Operator 7: information-theoretic sanitisation of personal data.

Rules find e-mail addresses, IP addresses, card and phone numbers: the protected
entities. What stands near them may reveal them after they are gone, so the corpus tells
how strongly: for a word t near an entity e, the pointwise mutual information of the two
divided by what e is worth, log(p(t, e) / (p(t) p(e))) / -log p(e). It is 1 if t occurs
only with e and 0 if they are independent. Words that occur with e in LEAST contexts
(different ones: copies of a text count once) and reach DISCLOSED are removed wherever
they stand near e, or are generalised to what kind of word they are.

1. Each text gives its base spans and, for each, the hashes of the words around it.
2. Words around entities set bits in a filter of fixed size; the words of all texts that
   have their bit set are counted, so counts cover the corpus and stay in proportion.
3. Pairs over the thresholds are joined to the contexts they occur in, by document, and
   their words' places become spans.

Defined results: a null or empty text has no spans; without a key, or where a key stands
for several texts, base spans are found all the same, and words are added by (key, base
spans); repeated rows are each sanitised; other columns pass unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import batches, words
from factloom.session import materialize

#: Words before and after an entity that count as its context.
NEAR = 8
LEAST, DISCLOSED = 3, 0.8
FILTER_BITS = 1 << 24
SUMS = 16

# The rules' patterns, as the results are defined by them.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(values[::2] + [v * 2 - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ to both sides: one pass whatever the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1) if start == at else done
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def contexts(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """(entity, context's number, places of the words near it) for each span."""
    taken = sorted((a, b) for _, a, b in spans)
    for kind, start, end in spans:
        left = list(_WORD.finditer(text, max(0, start - 40 * NEAR), start))[-NEAR:]
        right = [m for m, _ in zip(_WORD.finditer(text, end, min(len(text), end + 40 * NEAR)), range(NEAR))]
        near = [m.span() for m in left + right]
        free = [(a, b) for a, b in near if not any(a < y and x < b for x, y in taken)]
        yield f"{kind}:{text[start:end].lower()}", free


def _hashes(texts: list[str]) -> np.ndarray:
    """Hashes of single words (the same as of words in running text)."""
    if not texts:
        return np.zeros(0, np.int64)
    return np.concatenate([w for _, w, _ in words.of_texts(texts)]).view(np.int64)


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _span_array(rows: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], _SPAN)


def _found(text: str, with_rest: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            base, near = [], []
            for t in batches.texts(batch, text):
                spans = base_spans(t)
                base.append(spans)
                rows = []
                for entity, free in contexts(t, spans):
                    hashes = _hashes([t[a:b] for a, b in free]).tolist()
                    context = hash_of(hashes)
                    name = hash_of([entity])
                    rows += [{"entity": name, "context": context, "word": h, "start": a, "end": b} for h, (a, b) in zip(hashes, free)]
                near.append(rows)
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("entity", "context", "word", "start", "end")]))
            keep = [batch.column(c) for c in with_rest]
            yield pa.RecordBatch.from_arrays([*keep, _span_array(base), pa.array(near, kind)], names=[*with_rest, "base", "near"])

    return run


def hash_of(values: list) -> int:
    """A 64-bit hash of a list, the same in every task."""
    return int(words.of_text("\x1f".join(map(str, values)).replace(" ", "\x1e") or "\x1e")[0].astype(np.int64))


def _bits(words_: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits with those of the words set; its size doesn't follow the data."""

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in it:
            if "bits" in batch.schema.names:
                for x in batch.column("bits"):
                    held |= np.frombuffer(x.as_buffer(), np.uint8)
            else:
                at = np.array(batch.column("word")).view(np.uint64) % np.uint64(FILTER_BITS)
                np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["bits"])

    # dealt by hash, so as many filters as slots are made and merged, whatever the number of words
    dealt = words_.select("word", (F.pmod("word", F.lit(SUMS))).alias("slot")).repartition(SUMS, "slot").select("word")
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in dealt.mapInArrow(fill, "bits binary").toLocalIterator():
        held |= np.frombuffer(row.bits, np.uint8)
    return held


def _counts(docs: DataFrame, text: str, held: np.ndarray) -> DataFrame:
    """(word, n): occurrences in all texts of the words in the filter; word null: all words."""
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, total = shared.value, 0
        for batch in it:
            parts = [np.zeros(0, np.uint64)]
            for _, w, _ in words.of_texts(batches.texts(batch, text)):
                total += len(w)
                at = w % np.uint64(FILTER_BITS)
                parts.append(w[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1) > 0])
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["word", "n"])

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, near: DataFrame, text: str = "text") -> DataFrame:
    """(word, entity, disclosure): the pairs over the thresholds; near has entity, context and word."""
    pairs = near.groupBy("entity", "word").agg(F.countDistinct("context").alias("both"), F.count("*").alias("times"))
    pairs = materialize(pairs.where(F.col("both") >= LEAST), "pairs")
    entities = near.groupBy("entity").agg(F.countDistinct("context").alias("of_entity"))
    counts = materialize(_counts(docs, text, _bits(pairs.select("word").distinct())), "counts")
    total = counts.where("word is null").first()
    n = max(total.n if total else 0, 1)
    rows = pairs.join(entities, "entity").join(counts.where("word is not null"), "word")
    p = lambda c: F.col(c) / F.lit(float(n))
    # repeats of one context count as one occurrence of the word, too
    seen = F.greatest(F.col("n") - F.col("times") + F.col("both"), F.col("both"))
    value = F.log(p("both") / ((seen / F.lit(float(n))) * p("of_entity"))) / -F.log(p("of_entity"))
    return rows.select("word", "entity", value.alias("disclosure")).where(F.col("disclosure") >= DISCLOSED)


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, base (spans by rule), spans (base and disclosing words)."""
    batches.ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    near = "array<struct<entity:bigint,context:bigint,word:bigint,start:bigint,end:bigint>>"
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        _found("text", ["key"]), f"key {kind}, base {_SPANS}, near {near}"
    )
    found = materialize(found, "spans")
    flat = found.where(F.size("near") > 0).select("key", "base", F.explode("near").alias("x")).select("key", "base", "x.*")
    bad = disclosing(docs, flat, text)
    more = flat.join(bad, ["word", "entity"]).groupBy("key", "base").agg(
        F.array_sort(F.collect_set(F.struct(F.lit("term").alias("kind"), "start", "end"))).alias("added")
    )
    plain = found.where(F.size("near") == 0).select("key", "base", F.col("base").alias("spans"))
    held = found.where(F.size("near") > 0).select("key", "base")
    joined = held.join(
        more.withColumnsRenamed({"key": "k", "base": "b"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("base") == F.col("b")), "left"
    )
    spans = F.concat("base", F.coalesce("added", F.array().cast(_SPANS)))
    return plain.unionByName(joined.select("key", "base", spans.alias("spans"))).withColumnRenamed("key", key)


def generalised(word: str) -> str:
    """What is left of a disclosing word: the kind of word it is."""
    if any(c.isdigit() for c in word):
        return "[NUMBER]"
    return "[NAME]" if word[:1].isupper() else "[TERM]"


def sanitised(text: str, spans: list[tuple[str, int, int]], remove_terms: bool = False) -> str:
    """The text with entities replaced by their kind, and terms removed or generalised."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a < at:
            at = max(at, b)
            continue
        new = f"[{kind.upper()}]" if kind != "term" else "" if remove_terms else generalised(text[a:b])
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", remove_terms: bool = False) -> DataFrame:
    """The rows with sanitised texts; rows without personal data are as they were.

    A key must name one text; rows that repeat it with the same text are each kept.
    """
    held = personal_data(docs, key, text).where(F.size("spans") > 0).select(F.col(key).alias("__key"), F.col("spans").alias("__spans"))
    joined = docs.join(held.dropDuplicates(["__key"]), F.col(key) == F.col("__key"), "left").drop("__key")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, spans = batch.column(text).to_pylist(), batch.column("__spans").to_pylist()
            new = [sanitised(t, [(s["kind"], s["start"], s["end"]) for s in f], remove_terms) if f else t for t, f in zip(raw, spans)]
            yield batches.with_columns(batch, **{text: pa.array(new, batch.schema.field(text).type)}).drop_columns(["__spans"])

    return joined.mapInArrow(run, docs.schema)
