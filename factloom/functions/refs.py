"""References, stated times, amounts, identifiers and citations as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import rules

ISO_STAMP = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?)?$"
)


#: Decimal digits of all scripts in the basic plane but ASCII, and what they stand for.
_DIGITS = [chr(c) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Nd"]
_DIGIT_VALUES = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def ascii_digits(c: Column) -> Column:
    """Digits of any script as 0-9; text without such digits isn't searched for them."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(F.translate(c, "".join(_DIGITS), _DIGIT_VALUES))


_TO_ASCII = str.maketrans("".join(_DIGITS), _DIGIT_VALUES)


def digits_to_ascii(text: str) -> str:
    """The same for a Python string."""
    return text if text.isascii() else text.translate(_TO_ASCII)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_reference(ref: Column) -> Column:
    """Upper-case without blanks, dashes and underscores; NULL when short or a placeholder."""
    stripped = F.upper(F.trim(ref))
    clean = F.regexp_replace(stripped, r"[\s\-_]", "")
    usable = (F.length(clean) >= rules.MIN_REFERENCE_LENGTH) & ~stripped.isin(*rules.PLACEHOLDER_REFERENCES)
    return F.when(usable, clean)


def coalesced_reference(order_ref: Column, txn_ref: Column) -> Column:
    return F.coalesce(normalize_reference(order_ref), normalize_reference(txn_ref))


def explicit_timestamp(stated: Column) -> Column:
    """ISO date or date-time only (naive means UTC); anything else is NULL, never the ingest time."""
    iso = F.regexp_replace(F.trim(stated), "Z", "+00:00")
    # the short ISO forms: 20260105, T10, T10:30, +0530
    iso = F.regexp_replace(iso, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    iso = F.regexp_replace(iso, r"([T ]\d{2})(?=$|[+-])", "$1:00")
    iso = F.regexp_replace(iso, r"([T ]\d{2}:\d{2})(?=$|[+-])", "$1:00")
    iso = F.regexp_replace(iso, r"([T ].*[+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(iso.rlike(ISO_STAMP), F.try_to_timestamp(iso))


def iso_instant(ts: Column) -> Column:
    """Timestamp as ISO text with a UTC offset, fraction only when present."""
    return F.when(
        F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def finding_id(case_id: Column, kind: Column, discriminator: Column, *event_ids: Column) -> Column:
    """Stable id: same inputs give the same id whatever the partitioning or order of the pair."""
    ids = F.array_join(F.array_sort(F.array(*event_ids)), "|") if event_ids else F.lit("")
    raw = F.concat(case_id, F.lit("|"), kind, F.lit("|"), discriminator, F.lit("|"), ids)
    return F.concat(F.lit("fnd_"), F.substring(F.sha2(raw, 256), 1, 16))


def natural_id(prefix: str, *parts: Column) -> Column:
    """Replayable id of a row from its natural key."""
    raw = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(raw, 256), 1, 24))


def money_text(amount: Column) -> Column:
    """``1234.5`` -> ``1,234.50``."""
    return F.format_number(amount, 2)


def parse_amount(raw: Column) -> Column:
    """Lenient amount: NULL for blanks, 'none', 'null' and anything that is not a number."""
    text = F.trim(raw.cast("string"))
    return F.when(
        (text != "") & ~F.lower(text).isin("none", "null"), text.try_cast("decimal(18,4)")
    )


def title_words(c: Column) -> Column:
    """PAYMENT_MADE -> Payment Made."""
    return F.initcap(F.lower(F.replace(c, F.lit("_"), F.lit(" "))))


def spaced(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def page_suffix(page: Column) -> Column:
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(" (p. "), page.cast("string"), F.lit(")"))).otherwise("")


def citation(evidence_id, filename, page, start, end, trigger, event_id) -> Column:
    """Source citation; unusable page or offsets become NULL, 0..0 means 'not recorded'."""
    ok_start, ok_end = F.when(start >= 0, start), F.when(end >= 0, end)
    recorded = ~(F.coalesce(ok_start, F.lit(-1)).eqNullSafe(0) & F.coalesce(ok_end, F.lit(-1)).eqNullSafe(0))
    return F.struct(
        evidence_id.alias("evidence_id"),
        F.coalesce(blank_to_null(filename), evidence_id).alias("original_filename"),
        F.when(page >= 1, page).alias("page_number"),
        F.when(recorded, ok_start).alias("char_start"),
        F.when(recorded, ok_end).alias("char_end"),
        F.coalesce(blank_to_null(trigger), F.lit(rules.NO_TRIGGER_TEXT)).alias("trigger_raw_text"),
        event_id.alias("event_id"),
    )


CITATION_TYPE = (
    "struct<evidence_id:string,original_filename:string,page_number:int,char_start:int,"
    "char_end:int,trigger_raw_text:string,event_id:string>"
)
