"""The string rules of the Column functions for use inside page functions."""

from __future__ import annotations

import re

from ..functions import text as X

_LOWER = str.maketrans(X.LOWER_FROM, X.LOWER_TO)
_UPPER = str.maketrans(X.UPPER_FROM, X.UPPER_TO)
_BLANKS = "".join(map(chr, range(0x21)))
_ANCHOR = {ord(c): escaped for c, escaped in X.URL_ESCAPES if c != " "}
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)


def lower(s: str) -> str:
    return s.translate(_LOWER)


def upper(s: str) -> str:
    return s.translate(_UPPER)


def trim(s: str) -> str:
    return s.strip(_BLANKS)


def trim_right(s: str) -> str:
    return s.rstrip(_BLANKS)


def anchor_encode(s: str) -> str:
    """Blanks stay; characters above U+007F become their code point's low byte."""
    s = s.translate(_ANCHOR)
    return s if s.isascii() else "".join(c if c < "\x80" else f"%{ord(c) & 255:02X}" for c in s)


def anchor(heading: str) -> str:
    return anchor_encode(heading.replace(" ", "_"))


def split_top(s: str, most: int = -1) -> list[str]:
    """Parts between pipes that are not inside braces or brackets."""
    parts, begin, curly, square = [], 0, 0, 0
    for m in re.finditer(r"[|{}\[\]]", s):
        c = m[0]
        if c == "|":
            if not curly and not square and most != 0:
                parts.append(s[begin : m.start()])
                begin = m.end()
                most -= 1
        elif c in "{}":
            curly += 1 if c == "{" else -1
        else:
            square += 1 if c == "[" else -1
    return [*parts, s[begin:]]


def format_number(value: str, separator: str, compat: bool = True) -> str:
    """Groups of three digits; a sign in front of whole groups is set apart too with ``compat``."""
    point = "." if separator == "," else ","
    whole, sep, rest = value.partition(point)
    before = "." if compat else "[0-9]"
    return re.sub(f"(?s)(?<={before})(?=(?:[0-9]{{3}})+$)", separator, whole) + sep + rest
