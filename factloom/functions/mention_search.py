"""Mentions of one text: what ``entities.annotate`` does inside a row, in one pass over the text.

Spans are tuples (start, end, raw, rule, etype, confidence), in code points.
"""

from __future__ import annotations

import functools
import re
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation, localcontext

from factloom import rules
from factloom.functions.matching import MIXED, ODD, PLAIN, SPACES, Matcher, Text, starting
from factloom.functions.refs import digits_to_ascii
from factloom.functions.spans import quote

_SEP = r"[\-_:\s#]+"
_AGO = r"\s+(?:minutes?|hours?|days?|weeks?|months?)\s+ago"


@functools.cache
def _matchers() -> dict[str, Matcher]:
    from factloom.operators.entities import PATTERNS

    near = [*(n + _AGO for n in ("a", "one", "two", "three", "few")), *(f"{d}[0-9]*{_AGO}" for d in range(10))]
    plain = {"relative": starting(["yesterday", "today", "tomorrow", "just now", *near]) + r"\b"}
    return {rule: Matcher(java, plain.get(rule)) for rule, java in PATTERNS.items()}


_DIGIT = {PLAIN: re.compile(r"\d", re.A), MIXED: re.compile(r"\d"), ODD: re.compile(r"\d")}
_RUN = re.compile(r"\d+", re.A)
_STREETS = ("street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "nagar", "colony", "sector")
_CURRENCY_HEADS = tuple(sorted({k.rstrip(".") for k in rules.CURRENCIES}))
_MONTHS = tuple(rules.MONTHS)
#: What a plain text must contain, in lower case, for a rule to be tried.
_GATES = {
    "email": ("@",), "url": ("://",), "time": (":",), "speaker": (":",), "money_suffix": _CURRENCY_HEADS, "date_iso": ("-", "/"),
    "date_numeric": ("-", "/"), "date_day_first": _MONTHS, "relative": ("yesterday", "today", "tomorrow", "just now", "ago"), "address": _STREETS,
}
#: How a match begins in plain text, in lower case: with one of these ...
_HEADS = {
    "invoice": ("inv", "bill"), "refund": ("rfd", "refund", "ret"), "order": ("ord", "od", "po"),
    "txn": ("txn", "trx", "utr", "upi", "trans", "pay"), "utr": ("utr",), "txn_ocr": ("txn",), "date_month_first": _MONTHS,
    "money_prefix": _CURRENCY_HEADS,
}
_BLANK_OR_COMMA = frozenset("\t\n\x0b\x0c\r ,")
#: ... or with a run of digits, of which length and next character tell that it may be one.
_RUNS = {
    "money_suffix": lambda n, after: True,
    "date_iso": lambda n, after: n == 4 and after in "-/",
    "date_numeric": lambda n, after: n <= 2 and after in "-/",
    "date_day_first": lambda n, after: n <= 2,
    "time": lambda n, after: n <= 2 and after == ":",
    "address": lambda n, after: n <= 4 and after in _BLANK_OR_COMMA,
}


class Source(Text):
    """A text with its runs of digits that no letter or digit precedes: (start, length, next character)."""

    __slots__ = ("runs", "digits")

    def __init__(self, text: str):
        super().__init__(text)
        self.runs = []
        if self.kind == PLAIN:
            for m in _RUN.finditer(text):
                start, end = m.span()
                if start == 0 or not text[start - 1].isalnum():
                    self.runs.append((start, end - start, text[end:end + 1] or "\0"))
        self.digits = _DIGIT[self.kind].search(text) is not None


def _heads_in(low: str, heads: tuple) -> list[int]:
    """Where a plain lower-case text has one of the heads behind no letter or digit."""
    out = []
    for head in heads:
        at = low.find(head)
        while at >= 0:
            if at == 0 or not low[at - 1].isalnum():
                out.append(at)
            at = low.find(head, at + 1)
    out.sort()
    return out


def _phone_starts(t: Source) -> list[int]:
    out = []
    for start, _, _ in t.runs:
        if start and t.text[start - 1] in "+(":
            out.append(start - 1)
        out.append(start)
    return out


def _speaker_starts(t: Source) -> list[int]:
    """Beginnings of lines, with the blank ones before, whose first word may be a time."""
    out = []
    for start, n, after in t.runs:
        if n <= 2 and after == ":":
            k = start
            while k and t.text[k - 1] in SPACES:
                k -= 1
            if k:
                k = t.text.find("\n", k, start)
            if k >= 0:
                out.append(k)
    return out


def _any(low: str, words) -> bool:
    for w in words:
        if w in low:
            return True
    return False


_NEED_DIGIT = {"phone", "money_prefix", "money_suffix", "date_iso", "date_month_first", "date_day_first", "date_numeric"}


def _found(t: Source, rule: str) -> list[tuple]:
    """All matches of one pattern. In a plain text only places are tried where it can begin."""
    if not t.digits and rule in _NEED_DIGIT:
        return []
    matcher, text = _matchers()[rule], t.text
    if t.kind != PLAIN:
        group = 2 if rule == "speaker" else 0
        return [(*m.span(group), m[group]) for m in matcher.finditer(t)]
    gate = _GATES.get(rule)
    if gate is not None and not _any(t.low, gate):
        return []
    if rule in _HEADS:
        starts = _heads_in(t.low, _HEADS[rule])
    elif rule == "relative" and "ago" not in t.low:
        starts = _heads_in(t.low, gate)
    elif rule in _RUNS:
        fits = _RUNS[rule]
        starts = [start for start, n, after in t.runs if fits(n, after)]
    elif rule == "phone":
        starts = _phone_starts(t)
    elif rule == "speaker":
        starts = _speaker_starts(t)
    else:
        return [(m.start(), m.end(), text[m.start():m.end()]) for m in matcher.finditer(t)]
    out, last = [], 0
    match, where = matcher.form(PLAIN).match, t.low if matcher.folds else text
    for at in starts:
        if at < last:
            if rule != "speaker":
                continue
            at = last  # the line end before is part of the match before
        m = match(where, at)
        if m is not None:
            last = m.end()
            start, end = m.span(2) if rule == "speaker" else (at, last)
            out.append((start, end, text[start:end]))
    return out


def _labelled(found: list[tuple], rule: str, etype: str, conf: float | None) -> list[tuple]:
    return [(s, e, raw, rule, etype, conf) for s, e, raw in found]


def _not_covered(some: list[tuple], earlier: list[tuple]) -> list[tuple]:
    if not some or not earlier:
        return some
    return [c for c in some if not _covered(c[0], c[1], earlier)]


def _covered(start: int, end: int, by: list[tuple]) -> bool:
    for e in by:
        if e[0] <= start and e[1] >= end:
            return True
    return False


def _touched(start: int, end: int, by: list[tuple]) -> bool:
    for e in by:
        if (e[0] if e[0] > start else start) < (e[1] if e[1] < end else end):
            return True
    return False


@functools.cache
def _clean_pattern(prefixes: tuple[str, ...]) -> re.Pattern:
    # (?i) and (?U) as in the patterns that found the id, which lies inside one kind of text
    return re.compile(rf"^(?:{'|'.join(prefixes)}){_SEP}(.*)$", re.I | re.S)


def _clean_id(raw: str, prefixes: tuple[str, ...]) -> str:
    m = _clean_pattern(prefixes).match(raw)
    return m[1] if m else ""


_PREFIXES = {
    "invoice": tuple(rules.INVOICE_PREFIXES), "refund": tuple(rules.REFUND_PREFIXES),
    "order": tuple(rules.ORDER_PREFIXES), "txn": tuple(rules.TXN_PREFIXES),
}
_ALL_PREFIXES = tuple(p for some in _PREFIXES.values() for p in some)
_STOPWORDS = frozenset(rules.ID_STOPWORDS)


def _ids(found: list[tuple], rule: str, etype: str, conf: float | None, labels: frozenset) -> list[tuple]:
    """Shift label prefixes out of the span; drop ordinary words behind a blank separator."""
    out = []
    for s, e, raw in found:
        clean = _clean_id(raw, _PREFIXES[rule])
        head = raw[:len(raw) - len(clean)]
        if rule in ("refund", "order") and not any(c in "-_:#" for c in head) and clean.lower() in _STOPWORDS:
            continue
        if head.strip(" -_:#").upper() in labels:
            out.append((e - len(clean), e, clean, f"{rule}:bare", etype, conf))
        else:
            out.append((s, e, raw, rule, etype, conf))
    return out


_CUSTOMERS = frozenset(rules.CUSTOMER_SPEAKERS)


@functools.cache
def _term_matchers() -> list[tuple[str, Matcher, str, float]]:
    named = [(t, "ORGANIZATION", 0.92) for t in rules.ORGANIZATIONS] + [(t, "PERSON", 0.90) for t in rules.PERSONS]
    return [(t.lower(), Matcher(rf"(?iU)\b{quote(t)}\b", starting([quote(t)]) + r"\b"), e, c) for t, e, c in named]


def _dictionary(t: Text, gazetteer: tuple, address: list[tuple]) -> list[tuple]:
    """Dictionary terms in order; a term inside an earlier one is skipped."""
    text = t.text
    low = t.low if t.kind == PLAIN else text.lower()
    some = []
    for term, etype, conf in gazetteer:
        if term.lower() in low:
            some += [(m.start(), m.end(), m[0], "custom", etype, conf) for m in re.finditer(re.escape(term), text)]
    for term, matcher, etype, conf in _term_matchers():
        if term in low:
            some += [(*m.span(), text[m.start():m.end()], "dictionary", etype, conf) for m in matcher.finditer(t)]
    kept: list[tuple] = []
    for s in some + address:
        if s[3] == "custom" or not _covered(s[0], s[1], kept):
            kept.append(s)
    return kept


def _numeric_parts(raw: str) -> tuple[int, int, str]:
    a, b, y = re.split("[-/]", raw)
    return int(a), int(b), y


def _numeric_ok(raw: str) -> bool:
    """At least one reading as day and month exists."""
    a, b, _ = _numeric_parts(raw)
    return (a > 12 and 1 <= b <= 12) or (b > 12 and 1 <= a <= 12) or (1 <= a <= 12 and 1 <= b <= 12)


def _resolved(t: Source, gazetteer: tuple) -> list[tuple]:
    """Spans of all rules and the dictionary, overlaps resolved, as (start, end, raw, rule, etype, conf, method)."""
    from factloom.operators.entities import CONFIDENCE, ETYPE, LABEL_PREFIXES

    find = lambda rule: _found(t, rule)
    plain = lambda rule: _labelled(find(rule), rule, ETYPE[rule], CONFIDENCE.get(rule))
    first = plain("email")
    for s, _, raw, *rest in plain("url"):
        cut = raw.rstrip(".,;:!?)")
        first.append((s, s + len(cut), cut, *rest))
    first += plain("money_prefix")
    ids = []
    for rule in _PREFIXES:
        ids += _ids(find(rule), rule, ETYPE[rule], CONFIDENCE.get(rule), frozenset(LABEL_PREFIXES[rule]))
    days = plain("date_iso") + plain("date_month_first")
    found = first + _not_covered(plain("money_suffix"), first) + ids
    days = days + _not_covered(plain("date_day_first"), days)
    found = found + _not_covered(plain("utr"), found)
    days = days + [s for s in _not_covered(plain("date_numeric"), days) if _numeric_ok(s[2])]
    found = found + _not_covered(plain("txn_ocr"), found)
    clock = days + _not_covered(plain("time"), days) + plain("relative")
    phones = [
        (s, e, raw.strip(" "), "phone", "PHONE_NUMBER", 0.8) for s, e, raw in find("phone") if 7 <= sum(c.isdecimal() for c in raw) <= 15
    ]
    phones = [p for p in phones if not _touched(p[0], p[1], found)]
    people, shops = [], []
    for s, e, raw in find("speaker"):
        name = raw.strip(" ")
        who = name.lower()
        if who in _CUSTOMERS:
            people.append((s, e, name, "speaker_person", "PERSON", CONFIDENCE["speaker_person"]))
        elif _any(who, rules.MERCHANT_SPEAKER_WORDS):
            shops.append((s, e, name, "speaker_org", "ORGANIZATION", CONFIDENCE["speaker_org"]))
    ruled = found + phones + people + shops + clock
    ruled.sort(key=lambda s: (s[0], s[0] - s[1]))
    kept, last = [], -1
    for s in ruled:
        if s[0] >= last:
            kept.append(s)
            last = s[1]
    address = [(s, e, raw.strip(" "), "address", "ADDRESS", CONFIDENCE["address"]) for s, e, raw in find("address")]
    named: list[tuple] = []
    for s in _dictionary(t, gazetteer, address):
        if not _touched(s[0], s[1], kept) and not _touched(s[0], s[1], named):
            named.append(s)
    both = [(*s, "DETERMINISTIC_REGEX") for s in kept] + [(*s, "PRETRAINED_NLP") for s in named]
    both.sort(key=lambda s: (s[0], s[1], s[2], s[3], s[4]))
    return both


def _iso(y: str, m: int | None, d: int | None) -> str:
    return "-".join([y, *(f"{n:02d}" for n in (m, d) if n is not None)])


_WORD_DAY = re.compile(r"(?:^|[^\d])([0-3]?\d)(?!\d)", re.A)
_WORD_YEAR = re.compile(r"((?:20|19)\d\d)$", re.A)
_MONTH_IN = re.compile(f"({rules.MONTH_WORD})", re.I | re.A)


def _word_date(raw: str) -> str:
    month, day, year = _MONTH_IN.search(raw), _WORD_DAY.search(raw), _WORD_YEAR.search(raw)
    number = rules.MONTHS.index(month[1].lower()[:3]) + 1 if month else 0
    return _iso(year[1] if year else "", number, int(day[1]) if day else None)


def _numeric_date(raw: str) -> str | None:
    a, b, y = _numeric_parts(raw)
    if a > 12 and 1 <= b <= 12:
        return _iso(y, b, a)
    return _iso(y, a, b) if b > 12 and 1 <= a <= 12 else None


_CLOCK = re.compile(r"^(\d{1,2}):(\d\d)(?::(\d\d))?\s*([APap][Mm])?$", re.A)


def _clock(raw: str) -> str | None:
    m = _CLOCK.match(raw)
    if m is None:
        return None
    hour, half = int(m[1]), (m[4] or "").upper()
    if half == "PM" and hour < 12:
        hour += 12
    elif half == "AM" and hour == 12:
        hour = 0
    return f"{hour:02d}:{m[2]}:{m[3] or '00'}"


def _date_text(days: int) -> str:
    """A day counted from 1970 as yyyy-MM-dd, for any year."""
    z = days + 719468
    era, doe = divmod(z, 146097)
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    m = mp + 3 if mp < 10 else mp - 9
    y = yoe + era * 400 + (m <= 2)
    y = y if y > 0 else 1 - y
    return f"{'+' if y > 9999 else ''}{y:04d}-{m:02d}-{doy - (153 * mp + 2) // 5 + 1:02d}"


_NUMBER = re.compile(r"(\d+)", re.A)
_DAY_MICROS = 86_400_000_000


def resolve_relative(raw: str, stated: bool, at: int | None) -> tuple[str, str | None, float]:
    """Only unambiguous distances from a stated anchor (microseconds since 1970) are computed; nothing is guessed."""
    if not stated:
        return ("UNRESOLVED_NO_ANCHOR", None, 0.0)
    if at is None:
        return ("AMBIGUOUS_ANCHOR", None, 0.0)
    low = raw.strip(" ").lower()
    m = _NUMBER.search(low)
    n = int(m[1]) if m and int(m[1]) < 2**31 else 1
    day = at // _DAY_MICROS
    if low == "yesterday":
        day -= 1
    elif low == "tomorrow":
        day += 1
    elif "days ago" in low:
        day -= n
    elif "hours ago" in low:
        day = (at - n * 3_600_000_000) // _DAY_MICROS
    elif low != "today":
        return ("UNRESOLVED_NO_ANCHOR", None, 0.0)
    return ("RESOLVED_WITH_ANCHOR", _date_text(day), 0.95)


_CENT = Decimal("0.0001")
_MOST = Decimal(10) ** 14


@functools.cache
def _money_patterns() -> tuple[re.Pattern, re.Pattern]:
    from factloom.operators.entities import _CUR, _NUM

    return re.compile(f"({_CUR})", re.I | re.A), re.compile(rf"((?:{_NUM}))(?=\s*(?i:{_CUR})?$)")


def normalize_money(raw: str) -> tuple[Decimal, str]:
    """Exact decimal and currency code (USD when unknown); digits that do not parse give 0."""
    currency, number = _money_patterns()
    cur, num = currency.search(raw), number.search(raw)
    digits = digits_to_ascii(num[1].replace(",", "").replace(" ", "")) if num else ""
    try:
        with localcontext() as exact:
            exact.prec = 200
            value = Decimal(digits).quantize(_CENT, ROUND_HALF_UP) if digits.isascii() else Decimal(0)
    except InvalidOperation:
        value = Decimal(0)
    if not abs(value) < _MOST:
        value = Decimal(0)
    return (value, rules.CURRENCIES.get(cur[1].strip(" ").lower() if cur else "", "USD"))


_INTERNATIONAL = re.compile(r"^\+(\d{1,3})[\s\-]?(?:\(?\d{2,4}\)?[\s\-]?)?\d{3,5}[\s\-]?\d{3,5}$")


def normalize_phone(raw: str, country: str | None) -> tuple[str, str, str | None]:
    """E.164 from an explicit prefix or a known country; otherwise UNKNOWN."""
    digits = digits_to_ascii("".join(c for c in raw if c.isdecimal()))
    intl = _INTERNATIONAL.match(raw)
    if intl:
        return (raw, "+" + digits_to_ascii(intl[1]), "+" + digits)
    local = rules.COUNTRY_PREFIX.get(country)
    if local is not None and len(digits) == 10:
        return (raw, local, local + digits)
    return (raw, "UNKNOWN", None)


_OCR_SEP = re.compile(_SEP, re.A)
_BLANKS = re.compile(f"[{SPACES}]+")


def mentions_of(text: str, stated: bool, at: int | None, country: str | None, gazetteer: tuple = ()) -> list[tuple]:
    """All mentions of a text in order, in the fields of ``entities.MENTION``.

    ``stated`` tells whether the document states an anchor, ``at`` when that is.
    """
    guarded = text.translate(_GUARD) if "\x01" in text or "\x02" in text else text
    t = Source(guarded)
    out = []
    for start, end, raw, rule, etype, conf, method in _resolved(t, gazetteer):
        base = rule.removesuffix(":bare")
        norm = money = phone = dates = relative = None
        doubtful = False
        if base in ("txn", "txn_ocr", "utr", "order", "invoice", "refund") or etype in ("TRANSACTION_ID", "ORDER_ID", "INVOICE_ID", "REFUND_ID"):
            if base == "txn_ocr":
                clean = _OCR_SEP.split(raw)[-1]
                doubtful = any(c in "OIl|" for c in raw)
                conf = 0.7 if doubtful else 0.9
            elif base == "utr":
                clean = raw
            else:
                clean = raw if rule.endswith(":bare") else _clean_id(raw, _ALL_PREFIXES) or raw
                if base == "txn":
                    doubtful = any(c in "0123456789" for c in clean) and any(c in "OIl" for c in clean)
                    conf = 0.75 if doubtful else 0.95
            norm = clean.strip(" ").upper()
        elif base == "date_iso":
            norm = raw.replace("/", "-")
        elif base in ("date_month_first", "date_day_first"):
            norm = _word_date(raw)
        elif base == "date_numeric":
            norm = _numeric_date(raw)
            doubtful = norm is None
            conf = 0.75 if doubtful else 0.95
            if doubtful:
                a, b, y = _numeric_parts(raw)
                dates = [_iso(y, b, a), _iso(y, a, b)]
        elif base == "time":
            norm = _clock(raw)
        elif base == "relative":
            relative = resolve_relative(raw, stated, at)
            norm = relative[1]
            conf = 0.9 if relative[0] == "RESOLVED_WITH_ANCHOR" else 0.7
        elif base == "phone":
            phone = normalize_phone(raw, country)
            conf = 0.9 if raw.startswith("+") else 0.8
        elif etype == "EMAIL":
            norm = raw.lower()
        elif etype in ("PERSON", "ORGANIZATION", "ADDRESS"):
            norm = _BLANKS.sub(" ", raw).strip(" ")
        elif etype == "URL":
            norm = raw
        if etype == "MONETARY_AMOUNT":
            money = normalize_money(raw)
        out.append((start, end, raw, etype, rule, method, conf, norm, money, phone, dates, relative, doubtful, raw in text))
    return out


_GUARD = {1: "\x03", 2: "\x03"}
