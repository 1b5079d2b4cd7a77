"""Text layer: normalisation with offsets, page quality, layout from tokens, provenance."""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import rules
from factloom.functions import arrow_rows

SEGMENT = 4096
SKIP = "\uffff"


@functools.cache
def _nfc_changes() -> dict[str, str]:
    """Single code points that NFC rewrites on their own (no composition across characters)."""
    out = {}
    for cp in range(0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        new = unicodedata.normalize("NFC", ch)
        if new != ch:
            out[ch] = new
    return out


def _kept_chars(raw: Column) -> Column:
    """array<struct<c, at>>: output characters with the raw position each comes from."""
    table = _nfc_changes()
    nfc = F.map_from_arrays(F.split(F.lit("|".join(table)), r"\|"), F.split(F.lit("|".join(table.values())), r"\|"))
    # the LF of a CRLF is marked with a noncharacter of the same length, then dropped
    chars = F.split(F.replace(raw, F.lit("\r\n"), F.lit("\r" + SKIP)), "")
    zero_width = F.array(*[F.lit(z) for z in rules.ZERO_WIDTH])
    pairs = F.transform(
        chars,
        lambda c, i: F.struct(
            F.when(c == "\r", "\n").otherwise(c).alias("c"), i.alias("at"),
        ),
    )
    kept = F.filter(pairs, lambda p: (p["c"] != SKIP) & ~F.array_contains(zero_width, p["c"]) & (p["c"] != ""))
    special = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(table)) + "]"
    expand = F.flatten(
        F.transform(
            kept,
            lambda p: F.transform(
                F.split(F.coalesce(F.try_element_at(nfc, p["c"]), p["c"]), ""),
                lambda d: F.struct(d.alias("c"), p["at"].alias("at")),
            ),
        )
    )
    simple = F.transform(kept, lambda p: F.struct(p["c"].alias("c"), p["at"].alias("at")))
    return F.when(raw.rlike(special), expand).otherwise(simple)


def normalize_text(texts: DataFrame) -> DataFrame:
    """texts(text_id, text) + ``norm_text`` and ``offset_map`` in chunks of 50 normalised characters."""
    kept = texts.withColumn("_k", _kept_chars(F.col("text")))
    n = F.size("_k")
    step = rules.OFFSET_CHUNK
    chunks = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>")),
        lambda s: F.struct(
            s.alias("norm_start"), F.least(s + step, n).alias("norm_end"),
            F.element_at("_k", s + 1)["at"].alias("raw_start"),
            (F.element_at("_k", F.least(s + step, n))["at"] + 1).alias("raw_end"),
        ),
    )
    return kept.select(
        *texts.columns, F.array_join(F.transform("_k", lambda k: k["c"]), "").alias("norm_text"), chunks.alias("offset_map")
    )


def clean_text(text: Column) -> Column:
    """Only the normalised text for the common case: line ends and zero-width characters."""
    lf = F.regexp_replace(text, r"\r\n?", "\n")
    return F.translate(lf, "".join(rules.ZERO_WIDTH), "")


def _positions(text: str, odd: re.Pattern, longer: dict[str, int]) -> tuple[list[int], list[int], int]:
    """Where stretches of characters that are kept one by one begin, in the normalised and in the raw text, and how long
    the normalised text is. Only characters that are dropped or become several begin a new stretch."""
    norm, raw, count, at = [0], [0], 0, 0
    for m in odd.finditer(text):
        here = m.start()
        count += here - at
        if m[0] == "\r\n":
            count += 1
        for k in range(longer.get(m[0], 0)):
            norm.append(count)
            raw.append(here)
            count += 1
        at = m.end()
        norm.append(count)
        raw.append(at)
    return norm, raw, count + len(text) - at


def _raw_spans(longer: dict[str, int]):
    odd = re.compile("\r\n|[" + "".join(re.escape(c) for c in [*rules.ZERO_WIDTH, SKIP, *longer]) + "]")

    def work(texts, starts, ends):
        out, last, found = [], None, None
        for text, start, end in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            if text is None or start is None or end is None:
                out.append(None)
                continue
            if text is not last:
                if text != last:
                    found = _positions(text, odd, longer)
                last = text
            norm, raw, n = found
            if not (0 <= start < end <= n):
                out.append(None)
                continue
            place = lambda q: raw[(k := bisect.bisect_right(norm, q) - 1)] + q - norm[k]
            to = place(end - 1)
            out.append((place(start), to + (2 if text.startswith("\r\n", to) else 1)))
        return out

    return work


def map_span_to_raw(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """spans(text_id, norm_start, norm_end) -> raw [start, end) of each normalised span."""
    longer = {c: len(new) for c, new in _nfc_changes().items() if len(new) != 1}
    kind = pa.struct([("raw_start", pa.int32()), ("raw_end", pa.int32())])
    found = arrow_rows.column(
        _raw_spans(longer), kind, F.col("text"), F.col("norm_start").cast("long"), F.col("norm_end").cast("long")
    )
    j = spans.join(texts.select("text_id", "text"), "text_id").withColumn("_raw", found)
    return j.where(F.col("_raw").isNotNull()).select(*spans.columns, "_raw.raw_start", "_raw.raw_end")


def page_quality(pages: DataFrame) -> DataFrame:
    """pages(evidence_id, page_no, text, token_confidence?, has_raster?, is_native?, page_area?) + metrics and state."""
    have = set(pages.columns)
    opt = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    text = F.col("text")
    chars = F.length(text)
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    known = F.array(*[F.lit(w) for w in rules.DISPUTE_WORDS])
    native, raster, area = opt("is_native", True), opt("has_raster", False), opt("page_area", 1.0)
    conf = F.col("token_confidence") if "token_confidence" in have else F.lit(None).cast("double")
    one = pages.withColumns({"_w": words, "raw_character_count": chars})
    share = lambda num, den: F.when(den > 0, num / den).otherwise(0.0)
    two = one.withColumns({
        "word_count": F.size("_w"),
        "_alnum": share(F.regexp_count(text, F.lit(r"(?U)[\p{L}\p{N}]")), chars),
        "_dict": share(F.size(F.filter("_w", lambda w: F.array_contains(known, F.lower(w)))), F.size("_w")),
        "_conf": F.coalesce(conf, F.when(native & (chars > 0), 1.0).otherwise(0.0)),
        "suspected_glyph_substitution_count": F.regexp_count(text, F.lit("[\\x{FFFD}\\x{0}]")),
        "is_scanned_page": native & ((chars == 0) | ((share(chars, area) < rules.MIN_CHAR_DENSITY) & raster)),
    })
    state = quality_state(
        native, F.col("is_scanned_page"), share(F.col("suspected_glyph_substitution_count"), chars), F.col("_conf"), F.col("_alnum")
    )
    return two.select(
        *pages.columns, "raw_character_count", "word_count", F.round("_alnum", 4).alias("alphanumeric_ratio"),
        F.round("_dict", 4).alias("dictionary_word_ratio"), F.round("_conf", 4).alias("mean_token_confidence"),
        "suspected_glyph_substitution_count", "is_scanned_page", state.alias("quality_state"),
    )


def quality_state(native, scanned, glyph_rate, confidence, alnum) -> Column:
    return (
        F.when(native & scanned, "OCR_RECOMMENDED")
        .when(native & (glyph_rate > rules.MAX_GLYPH_RATE), "OCR_RECOMMENDED")
        .when((confidence < rules.MIN_TOKEN_CONFIDENCE) | (alnum < rules.MIN_ALNUM_RATIO), "REVIEW_NEEDED")
        .otherwise("PASS")
    )


def document_quality(pages: DataFrame) -> DataFrame:
    """Roll-up of ``page_quality`` rows per document."""
    return pages.groupBy("evidence_id").agg(
        F.when(F.bool_or(F.col("quality_state") == "REVIEW_NEEDED"), "REVIEW_NEEDED").otherwise("PASS").alias("quality_state"),
        F.sum("raw_character_count").alias("raw_character_count"), F.sum("word_count").alias("word_count"),
        F.round(F.avg("alphanumeric_ratio"), 4).alias("alphanumeric_ratio"),
        F.round(F.avg("mean_token_confidence"), 4).alias("mean_token_confidence"),
        F.bool_or("is_scanned_page").alias("is_scanned_page"), F.count(F.lit(1)).alias("page_count"),
    )


def assemble_documents(pages: DataFrame) -> DataFrame:
    """Pages joined by a blank line, in page order. A document is one row by definition."""
    return pages.groupBy("evidence_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n\n"
        ).alias("text"),
        F.count(F.lit(1)).alias("page_count"),
    )


def page_offsets(pages: DataFrame) -> DataFrame:
    """Start of each page in the assembled text."""
    before = Window.partitionBy("evidence_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return pages.select(
        "evidence_id", "page_no", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("int").alias("page_start"),
        F.length("text").alias("page_length"),
    )


def clean_ocr_tokens(tokens: DataFrame) -> DataFrame:
    """Drop blank or rejected words, confidence to [0, 1], boxes to a 0..1000 grid.

    tokens(evidence_id, page_no, word_ix, block_no, line_no, word, confidence,
    left, top, width, height, page_width, page_height)
    """
    grid = lambda v, full: F.round(v / F.col(full) * 1000.0, 1)
    return tokens.withColumn("word", F.trim("word")).where((F.col("word") != "") & (F.col("confidence") >= 0)).select(
        "evidence_id", "page_no", "word_ix", "block_no", "line_no", "word",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") / 100.0)).alias("confidence"),
        F.array(
            grid(F.col("left"), "page_width"), grid(F.col("top"), "page_height"),
            grid(F.col("left") + F.col("width"), "page_width"), grid(F.col("top") + F.col("height"), "page_height"),
        ).alias("box"),
    )


def token_offsets(tokens: DataFrame) -> DataFrame:
    """Character position of each token in its page (words joined by one character)."""
    before = Window.partitionBy("evidence_id", "page_no").orderBy("block_no", "line_no", "word_ix").rowsBetween(
        Window.unboundedPreceding, -1
    )
    start = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)).cast("int")
    return tokens.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("word"))


def lines_from_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("evidence_id", "page_no", "block_no", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_ix", "word"))), lambda t: t["word"]), " ").alias("text"),
        F.avg("confidence").alias("line_confidence"), F.count(F.lit(1)).alias("words"), F.sum("confidence").alias("_sum"),
    )


def layout_from_tokens(tokens: DataFrame) -> DataFrame:
    """Page text from tokens: words by blank, lines and blocks by newline; mean token confidence."""
    lines = lines_from_tokens(tokens)
    return lines.groupBy("evidence_id", "page_no").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("block_no", "line_no", "text"))), lambda t: t["text"]), "\n"
        ).alias("text"),
        F.countDistinct("block_no").alias("blocks"), F.count(F.lit(1)).alias("lines"),
        (F.sum("_sum") / F.sum("words")).alias("token_confidence"),
    )


def route_pages(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pages whose native text is unusable take the OCR text; without one they need review."""
    o = ocr.select("evidence_id", "page_no", F.struct("text", "quality_state").alias("_ocr"))
    j = native.join(o, ["evidence_id", "page_no"], "left")
    poor = F.col("quality_state") == "OCR_RECOMMENDED"
    use = poor & F.col("_ocr").isNotNull()
    return j.select(
        "evidence_id", "page_no", F.when(use, F.col("_ocr.text")).otherwise(F.col("text")).alias("text"),
        F.when(use, F.col("_ocr.quality_state")).when(poor, "REVIEW_NEEDED").otherwise(F.col("quality_state")).alias("quality_state"),
        F.when(use, "OCR").otherwise("NATIVE_PDF").alias("method"),
    )


def _segments(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / SEGMENT), F.floor(last / SEGMENT)))


def attach_pages(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Page of each span(evidence_id, start, ...): first page that contains the start, else 1.

    Pages and spans meet in fixed segments of the text, so a long document is not
    one all-against-all group.
    """
    p = page_offsets(pages).withColumn("_seg", _segments(F.col("page_start"), F.col("page_start") + F.col("page_length")))
    near = p.groupBy("evidence_id", "_seg").agg(F.array_sort(F.collect_list(F.struct("page_no", "page_start", "page_length"))).alias("_near"))
    inside = lambda page: (page["page_start"] <= F.col("start")) & (F.col("start") <= page["page_start"] + page["page_length"])
    # a segment's pages are one row, so spans are read once, however long they took to find
    joined = spans.withColumn("_seg", F.floor(F.col("start") / SEGMENT)).join(near, ["evidence_id", "_seg"], "left")
    return (
        joined.withColumn("_p", F.try_element_at(F.filter("_near", inside), F.lit(1)))
        .withColumn("page_number", F.coalesce("_p.page_no", F.lit(1)))
        .withColumn("page_relative_start", F.col("start") - F.coalesce("_p.page_start", F.lit(0)))
        .drop("_seg", "_near", "_p")
    )


def attach_bbox(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Union box of the tokens that a page-relative span(evidence_id, page_no, start, end) overlaps."""
    t = token_offsets(tokens).withColumn("_seg", _segments(F.col("char_start"), F.col("char_end")))
    s = spans.withColumn("_key", F.xxhash64(*spans.columns))
    cut = s.withColumn("_seg", _segments(F.col("start"), F.col("end")))
    met = cut.join(t.select("evidence_id", "page_no", "_seg", "char_start", "char_end", "box"), ["evidence_id", "page_no", "_seg"]).where(
        F.greatest("char_start", "start") < F.least("char_end", "end")
    )
    side = lambda i: F.element_at("box", i)
    boxes = met.groupBy("evidence_id", "page_no", "_key").agg(
        F.round(F.min(side(1)), 1).alias("x0"), F.round(F.min(side(2)), 1).alias("y0"),
        F.round(F.max(side(3)), 1).alias("x1"), F.round(F.max(side(4)), 1).alias("y1"),
    )
    return s.join(boxes, ["evidence_id", "page_no", "_key"], "left").drop("_key")


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate of trimmed texts, four digits."""
    ref, hyp = F.trim(reference), F.trim(hypothesis)
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(
        F.round(F.levenshtein(ref, hyp) / F.length(ref), 4)
    )


def cer_report(rows: DataFrame) -> DataFrame:
    """rows(sample_id, reference, baseline, improved) + both rates, their difference and a verdict."""
    a, b = cer(F.col("reference"), F.col("baseline")), cer(F.col("reference"), F.col("improved"))
    delta = F.round(a - b, 4)
    return rows.select(
        "sample_id", a.alias("baseline_cer"), b.alias("improved_cer"), delta.alias("cer_delta"),
        F.when(delta > 0, "IMPROVED").when(delta < 0, "DEGRADED").otherwise("UNCHANGED").alias("verdict"),
    )
