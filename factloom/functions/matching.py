"""Java patterns on Python strings, with the same matches and code-point offsets.

The patterns of ``operators.entities`` and ``operators.events`` are Java patterns in which (?U) makes classes and
boundaries those of Unicode. A *plain* text has no letter, digit, mark or white space beyond ASCII: ASCII classes are
enough, its lower-case form has the same offsets, and a pattern without regard to case is matched there, which lets
the matcher skip to the first characters a match can have. A *mixed* text has only characters on whose class Java and
Python agree. For an *odd* one the classes are spelled out as Java defines them.
"""

from __future__ import annotations

import functools
import re
import unicodedata

PLAIN, MIXED, ODD = 0, 1, 2
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE_CLASS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What a plain text may have besides ASCII: marks that are no letter, digit or blank and have no case.
_BEYOND = re.compile(
    "[^\x00-\x1b -\x7f\u2013\u2014\u2018\u2019\u201c\u201d\u2022\u2026\u20ac\u20b9\xa3\xa5\xa7\xa9\xb0\ufffd]"
)


def _java_word(c: int) -> bool:
    """Java's \\w under UNICODE_CHARACTER_CLASS: alphabetic, mark, decimal digit, connector or joiner."""
    # letters in circles and squares are alphabetic symbols
    if 0x24B6 <= c <= 0x24E9 or 0x1F130 <= c <= 0x1F149 or 0x1F150 <= c <= 0x1F169 or 0x1F170 <= c <= 0x1F189:
        return True
    kind = unicodedata.category(chr(c))
    return kind[0] in "LM" or kind in ("Nl", "Nd", "Pc") or c in (0x200C, 0x200D)


def _ranges(inside) -> str:
    out, first = [], None
    for c in (*range(0x33480), *range(0xE0000, 0xE0200)):  # the other planes are private or not assigned
        yes = inside(c)
        if yes and first is None:
            first = c
        elif not yes and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


@functools.cache
def _word_class() -> str:
    return _ranges(_java_word)


@functools.cache
def _disagreed() -> re.Pattern:
    """Characters that are of a class in Java or in Python but not in both."""
    python = lambda ch: ch.isalnum() or ch == "_"
    return re.compile(f"[\\x1c-\\x1f{_ranges(lambda c: _java_word(c) != python(chr(c)))}]")


def kind_of(text: str) -> int:
    if _BEYOND.search(text) is None:
        return PLAIN
    return ODD if _disagreed().search(text) else MIXED


def _spelled_out(pattern: str) -> str:
    out, k, inside = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            e = pattern[k + 1]
            k += 2
            if e not in "bwWsS":
                out.append("\\" + e)
            elif e == "b":
                w = _word_class()
                out.append(f"(?-i:(?<=[{w}])(?![{w}])|(?<![{w}])(?=[{w}]))")
            else:
                members = _SPACE_CLASS if e in "sS" else _word_class()
                out.append(members if inside else f"(?-i:[{'^' if e in 'SW' else ''}{members}])")
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        k += 1
    return "".join(out)


def _lowered(pattern: str) -> str:
    return re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern, flags=re.S)


class Text:
    """A text with its kind and, if plain, its lower-case form."""

    __slots__ = ("text", "kind", "low")

    def __init__(self, text: str, kind: int | None = None):
        self.text = text
        self.kind = kind_of(text) if kind is None else kind
        self.low = text.lower() if self.kind == PLAIN else text


class Matcher:
    """One Java pattern. ``plain`` names an equal pattern for plain text, if one begins with fixed characters."""

    def __init__(self, java: str, plain: str | None = None):
        head = re.match(r"\(\?([a-zA-Z]+)\)", java)
        flags = head[1] if head else ""
        self.folds = "i" in flags
        self._body = java[head.end():] if head else java
        self._kept = (re.M if "m" in flags else 0) | (re.S if "s" in flags else 0)
        source = self._body if plain is None else plain
        self._forms = [re.compile(_lowered(source) if self.folds else source, self._kept | re.A), None, None]

    def form(self, kind: int) -> re.Pattern:
        if self._forms[kind] is None:
            source = _spelled_out(self._body) if kind == ODD else self._body
            self._forms[kind] = re.compile(source, self._kept | (re.I if self.folds else 0))
        return self._forms[kind]

    def finditer(self, t: Text):
        return self.form(t.kind).finditer(t.low if self.folds else t.text)

    def found(self, t: Text) -> bool:
        return self.form(t.kind).search(t.low if self.folds else t.text) is not None


def starting(words: list[str]) -> str:
    """``\\b(?:words)`` for plain text, by first characters, so that the matcher can skip to them.

    Words may be patterns that begin with a letter or digit; those with one first character keep their order.
    """
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0].lower(), []).append(w[1:])
    return "(?:" + "|".join(rf"{c}(?<!\w{c})(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")"
