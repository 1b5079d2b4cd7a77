"""Typed, normalised, source-grounded mentions.

``annotate`` adds one array column per document and needs no shuffle: whole texts
are read in Arrow batches, every pattern is matched in one pass over a text
(``functions.mention_search``). ``mentions`` turns the array into rows, ``extract``
finds single patterns with built-in functions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import rules
from factloom.functions import arrow_rows, mention_search, refs
from factloom.functions.spans import SPAN, quote, spans

_CUR = "|".join(quote(k) for k in sorted(rules.CURRENCIES, key=lambda k: (-len(k), k)))
_NUM = r"\d{1,3}(?:[,\s]\d{2,3})*(?:\.\d{1,4})?|\d+(?:\.\d{1,4})?"
_SEP = r"[\-_:\s#]+"


def _id_pattern(prefixes: list[str], more: str) -> str:
    return rf"(?iU)\b(?:{'|'.join(prefixes)}){_SEP}[A-Za-z0-9][A-Za-z0-9\-_]{more}\b"


PATTERNS = {
    "email": r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,7}\b",
    "url": r"(?iU)\bhttps?://[A-Za-z0-9.\-]+(?::\d+)?(?:/[^\s<>'\"`]*)?",
    "money_prefix": rf"(?iU)(?<![A-Za-z0-9])(?:{_CUR})\s*(?:{_NUM})\b",
    "money_suffix": rf"(?iU)(?<![A-Za-z0-9])(?:{_NUM})\s*(?:{_CUR})(?![A-Za-z0-9])",
    "invoice": _id_pattern(rules.INVOICE_PREFIXES, "{2,23}"),
    "refund": _id_pattern(rules.REFUND_PREFIXES, "{2,23}"),
    "order": _id_pattern(rules.ORDER_PREFIXES, "{2,23}"),
    "txn": _id_pattern(rules.TXN_PREFIXES, "{3,31}"),
    "utr": r"(?iU)\bUTR[A-Za-z0-9]{10,20}\b",
    "txn_ocr": rf"(?iU)\bTXN{_SEP}[A-Za-z0-9]{{5,20}}\b",
    "phone": r"(?U)(?<!\w)(?:\+\d{1,3}[\s\-]?)?(?:\(?\d{2,4}\)?[\s\-]?)?\d{3,5}[\s\-]?\d{3,5}(?!\w)",
    "speaker": r"(?mdU)((?:^|\n)\s*\d{1,2}:\d{2}(?::\d{2})?\s*[–—\-•\s]*\s*)([A-Za-z][A-Za-z0-9\s]{1,40}?)(\s*[:\n]|\s*$)",
    "date_iso": r"(?U)\b(?:20\d\d|19\d\d)[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])\b",
    "date_month_first": rf"(?iU)\b{rules.MONTH_WORD}\s+[0-3]?\d(?:st|nd|rd|th)?,?\s+(?:20\d\d|19\d\d)\b",
    "date_day_first": rf"(?iU)\b[0-3]?\d(?:st|nd|rd|th)?[\s\-_]+{rules.MONTH_WORD}[\s\-_]+(?:20\d\d|19\d\d)\b",
    "date_numeric": r"(?U)\b[0-3]?\d[-/][0-3]?\d[-/](?:20\d\d|19\d\d)\b",
    "time": r"(?U)\b(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?:\s*[APap][Mm])?\b",
    "relative": r"(?iU)\b(?:yesterday|today|tomorrow|just now|(?:[0-9]+|a|one|two|three|few)\s+(?:minutes?|hours?|days?|weeks?|months?)\s+ago)\b",
    "address": (
        r"(?iU)\b\d{1,4}[,\s]+[A-Za-z0-9\s,\-]+(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Nagar|Colony|Sector\s*\d+)"
        r"[,\s]+[A-Za-z\s]+(?:\d{5,6})?\b"
    ),
}
ETYPE = {
    "email": "EMAIL", "url": "URL", "money_prefix": "MONETARY_AMOUNT", "money_suffix": "MONETARY_AMOUNT",
    "invoice": "INVOICE_ID", "refund": "REFUND_ID", "order": "ORDER_ID", "txn": "TRANSACTION_ID",
    "utr": "TRANSACTION_ID", "txn_ocr": "TRANSACTION_ID", "phone": "PHONE_NUMBER", "date_iso": "DATE",
    "date_month_first": "DATE", "date_day_first": "DATE", "date_numeric": "DATE", "time": "TIME",
    "relative": "RELATIVE_TIME", "address": "ADDRESS",
}
# cheap literal or pattern a text must contain before the full pattern is tried
GATES = {
    "email": "@", "url": "://", "time": ":", "speaker": ":",
    "address": r"~(?i)(?:street|st|road|rd|avenue|ave|lane|ln|nagar|colony|sector)",
    "utr": "~(?i)utr", "txn_ocr": "~(?i)txn", "phone": r"~(?U)\d", "money_prefix": r"~(?U)\d", "money_suffix": r"~(?U)\d",
    "date_iso": r"~(?U)\d", "date_month_first": r"~(?U)\d", "date_day_first": r"~(?U)\d", "date_numeric": r"~(?U)\d",
    "invoice": "~(?i)(?:inv|bill)", "refund": "~(?i)(?:rfd|ref|ret)", "order": "~(?i)(?:ord|od|po)",
    "txn": "~(?i)(?:txn|trx|utr|upi|trans|pay)",
}
# prefix words that are labels and not part of the id
LABEL_PREFIXES = {
    "invoice": ["INVOICE", "BILL"], "refund": ["REFUND", "RET"], "order": ["ORDER"], "txn": ["TRANSACTION", "TRANS"],
}
CONFIDENCE = {
    "email": 1.0, "url": 1.0, "money_prefix": 0.98, "money_suffix": 0.98, "invoice": 0.95, "refund": 0.95,
    "order": 0.95, "utr": 0.95, "date_iso": 0.99, "date_month_first": 0.98, "date_day_first": 0.98,
    "time": 0.95, "address": 0.88, "speaker_person": 0.95, "speaker_org": 0.95,
}


def find(text: Column, rule: str) -> Column:
    """All matches of one pattern, with its cheap gate."""
    found = spans(text, PATTERNS[rule], 2 if rule == "speaker" else 0)
    gate = GATES.get(rule)
    if gate is None:
        return found
    passes = text.rlike(gate[1:]) if gate.startswith("~") else F.contains(text, F.lit(gate))
    return F.when(passes, found).otherwise(F.array().cast(f"array<{SPAN}>"))


MENTION = pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("raw", pa.string()), ("etype", pa.string()), ("rule", pa.string()),
    ("method", pa.string()), ("confidence", pa.float64()), ("norm_text", pa.string()),
    ("money", pa.struct([("value", pa.decimal128(18, 4)), ("currency", pa.string())])),
    ("phone", pa.struct([("raw", pa.string()), ("country_code", pa.string()), ("e164", pa.string())])),
    ("candidate_dates", pa.list_(pa.string())),
    ("relative", pa.struct([("status", pa.string()), ("computed", pa.string()), ("confidence", pa.float64())])),
    ("is_ambiguous", pa.bool_()), ("grounded", pa.bool_()),
])


def _anchor_micros(anchor: Column) -> Column:
    """The stated reference date or time, without its offset, in microseconds since 1970; NULL when it is none."""
    return F.unix_micros(refs.explicit_timestamp(F.regexp_replace(anchor, r"(Z|[+-]\d\d:\d\d)$", "")))


def _mentions(gazetteer: list[tuple[str, str, float]] | None):
    terms = tuple(gazetteer or ())

    def work(texts, stated, at, country):
        columns = (c.to_pylist() for c in (texts, stated, at, country))
        return [[] if t is None else mention_search.mentions_of(t, s, a, c, terms) for t, s, a, c in zip(*columns)]

    return work


def annotate(
    docs: DataFrame, anchor: str | None = None, country: str | None = None,
    gazetteer: list[tuple[str, str, float]] | None = None,
) -> DataFrame:
    """docs(evidence_id, text, ...) -> docs with ``mentions``, ordered by start.

    ``anchor`` names a column with the stated reference date of the document,
    ``country`` a column with its country context.
    """
    anchor_c = F.col(anchor) if anchor else F.lit(None).cast("string")
    country_c = F.col(country) if country else F.lit(None).cast("string")
    found = arrow_rows.column(
        _mentions(gazetteer), pa.list_(MENTION), F.col("text"), anchor_c.isNotNull(), _anchor_micros(anchor_c), country_c
    )
    return docs.withColumn("mentions", found)


def mentions(annotated: DataFrame, etypes: list[str] | None = None) -> DataFrame:
    """One row per mention with a replayable id."""
    wanted = F.col("mentions")
    if etypes:
        wanted = F.filter(wanted, lambda m: m["etype"].isin(*etypes))
    rows = annotated.select("evidence_id", F.explode(wanted).alias("_m")).select("evidence_id", "_m.*")
    return rows.withColumn(
        "entity_id", refs.natural_id("ent_", F.col("evidence_id"), F.col("etype"), F.col("start"), F.col("end"))
    )


def _ruled(rule: str):
    return lambda s: F.struct(
        F.lit(rule).alias("rule"), s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw")
    )


def extract(docs: DataFrame, *patterns: str) -> DataFrame:
    """Raw matches of single patterns, without overlap rules: (evidence_id, rule, start, end, raw)."""
    parts = F.concat(*[
        F.transform(find(F.col("text"), r), _ruled(r))
        for r in patterns
    ])
    return docs.select("evidence_id", F.inline(parts))
