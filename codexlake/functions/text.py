"""String functions of the archive as Column expressions: folding, codecs, trimming, keys.

Keys are built with ``translate`` over explicit letters rather than ``lower`` or a
collation: only ASCII and Latin-1 letters fold, and other engines can mirror it.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chinese import simplified_table

_UP = "".join(map(chr, range(0x41, 0x5B)))
#: U+00C0-U+00DE move by 0x20, the multiplication sign included.
LOWER_FROM = _UP + "".join(map(chr, range(0xC0, 0xDF)))
LOWER_TO = "".join(chr(ord(c) + 0x20) for c in LOWER_FROM)
#: Upper case stops at U+00EE.
UPPER_FROM = _UP.lower() + "".join(map(chr, range(0xE0, 0xEF)))
UPPER_TO = "".join(chr(ord(c) - 0x20) for c in UPPER_FROM)

# Latin-1 letters and the letter each is searched as.
_BASE = {
    "A": "ÀÁÂÃÄÅ", "C": "Ç", "E": "ÈÉÊË", "I": "ÌÍÎÏ", "D": "Ð", "N": "Ñ", "O": "ÒÓÔÕÖØ", "U": "ÙÚÛÜ", "Y": "Ý\x9f",
    "a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "d": "", "n": "ñ", "o": "òóôõöø", "u": "ùúûü", "y": "ý",
    "S": "\x8a", "Z": "\x8e", "s": "\x9a", "z": "\x9e",
}
DIACRITIC_FROM = "".join(_BASE.values())
DIACRITIC_TO = "".join(base * len(letters) for base, letters in _BASE.items())

#: Some traditional characters and their simplified forms, for use without a session; see ``chinese`` for all.
ZH_FROM = "亂並來倉個們偉側優傳債價兒內兩冊決凍劃動務勝勞區協卻厲參吳員問啟喬單嗎園國圍圖圓團塊場壞處備夠夢夾奪奮婦媽學寫寬實審寶對"
ZH_TO = "乱并来仓个们伟侧优传债价儿内两册决冻划动务胜劳区协却厉参吴员问启乔单吗园国围图圆团块场坏处备够梦夹夺奋妇妈学写宽实审宝对"

URL_ESCAPES = (("%", "%25"), (" ", "%20"), ("<", "%3C"), (">", "%3E"), ('"', "%22"), ("#", "%23"))

#: File extensions and their media types.
MIME_TYPES = {
    "html": "text/html", "htm": "text/html", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "png": "image/png", "css": "text/css", "au": "audio/basic", "wav": "audio/wav", "avi": "video/x-msvideo",
    "mpeg": "video/mpeg", "mpg": "video/mpeg", "mp4": "video/mp4", "mp3": "audio/mpeg", "svg": "image/svg+xml",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_lower(x) -> Column:
    return F.translate(_c(x), LOWER_FROM, LOWER_TO)


def to_upper(x) -> Column:
    return F.translate(_c(x), UPPER_FROM, UPPER_TO)


def fold_diacritics(x) -> Column:
    return F.translate(_c(x), DIACRITIC_FROM, DIACRITIC_TO)


def zh_table(pairs: Iterable[tuple[str, str]]) -> tuple[str, str]:
    """Two strings for ``translate``; the first of several pairs for a character counts."""
    first: dict[str, str] = {}
    for traditional, simplified in pairs:
        first.setdefault(traditional, simplified)
    return "".join(first), "".join(first.values())


def fold_zh(x, table: tuple[str, str] | None = None) -> Column:
    """Traditional characters simplified, by the given table or the full one."""
    return F.translate(_c(x), *(table or simplified_table()))


def key0(x) -> Column:
    """The primary index' key."""
    return to_lower(x)


def key1(x, lang=None, secondary: bool = True, table: tuple[str, str] | None = None) -> Column:
    """The search key: lower case, then simplified (language ``zh``) or without diacritics if there is a secondary index."""
    low = to_lower(x)
    if not secondary:
        return low
    plain = fold_diacritics(low)
    return plain if lang is None else F.when(_c(lang) == "zh", fold_zh(low, table)).otherwise(plain)


def _each_char(x: Column, change) -> Column:
    return F.array_join(F.transform(F.split(x, ""), change), "")


def url_encode(x) -> Column:
    """Escapes blank, ``< > " # %`` and all bytes above 0x7F, in upper-case hex."""
    out = _c(x)
    for plain, escaped in URL_ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    def escape(c):
        return F.when(c > "\x7f", F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)

    return F.when(_c(x).rlike(r"[^\x00-\x7F]"), _each_char(out, escape)).otherwise(out)


def anchor_encode(x) -> Column:
    """As ``url_encode`` but blanks stay, and a character above U+007F becomes the low byte of its code point."""
    out = _c(x)
    for plain, escaped in URL_ESCAPES:
        if plain != " ":
            out = F.replace(out, F.lit(plain), F.lit(escaped))
    def escape(c):
        low = F.lpad(F.hex(F.ascii(c).bitwiseAND(F.lit(255))), 2, "0")
        return F.when(c > "\x7f", F.concat(F.lit("%"), low)).otherwise(c)

    return F.when(_c(x).rlike(r"[^\x00-\x7F]"), _each_char(out, escape)).otherwise(out)


def anchor_name(x) -> Column:
    return anchor_encode(F.replace(_c(x), F.lit(" "), F.lit("_")))


def url_decode(x) -> Column:
    """Percent decoding; a plus stays, and so does a percent sign without two hex digits after it."""
    plain = F.regexp_replace(F.replace(_c(x), F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(plain), _c(x))


def trim(x) -> Column:
    """Strips all characters up to U+0020 from both ends."""
    return F.regexp_replace(_c(x), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def trim_left(x) -> Column:
    return F.regexp_replace(_c(x), r"^[\x00-\x20]+", "")


def trim_right(x) -> Column:
    return F.regexp_replace(_c(x), r"[\x00-\x20]+$", "")


def leading_int(x) -> Column:
    return F.coalesce(F.regexp_extract(_c(x), r"^[0-9]+", 0).try_cast("int"), F.lit(0))


def starts_with_case(x, prefix: str) -> Column:
    return to_lower(x).startswith(prefix)


def starts_with(x, prefix: str) -> Column:
    return _c(x).startswith(prefix)


def split_keep(x, separator: str) -> Column:
    return F.split(_c(x), "[" + separator + "]", -1)


def underscores_to_blanks(x) -> Column:
    return F.translate(_c(x), "_", " ")


def blanks_to_underscores(x) -> Column:
    return F.translate(_c(x), " ", "_")


def svg_key(x) -> Column:
    """The image archive's key of a file name: lower case, drawings under their rendered name.

    A drawing is a name whose first ``.svg`` ends it; archives also hold names of three bytes under such a key.
    """
    low = to_lower(x)
    at = F.instr(low, ".svg")
    drawing = F.when(at > 0, at == F.length(low) - 3).otherwise(F.octet_length(low) == 3)
    return F.when(drawing, F.concat(low, F.lit(".png"))).otherwise(low)


def cache_key(x) -> Column:
    out = to_lower(url_encode(x))
    for plain, escaped in (("/", "%2f"), ("\\", "%5c"), (":", "%3a")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def latin1_decode(x) -> Column:
    """Text of bytes that stand for one Latin-1 letter each."""
    return F.decode(_c(x), "ISO-8859-1")


def latin1_encode(x) -> Column:
    """Bytes of one Latin-1 letter each; a character of three (four) bytes in UTF-8 becomes two (three) number signs.

    One of two bytes beyond Latin-1 keeps the low byte of its code point.
    """
    def one(c):
        size = F.octet_length(F.encode(c, "UTF-8"))
        low = F.unhex(F.lpad(F.hex(F.ascii(c).bitwiseAND(F.lit(255))), 2, "0"))
        return F.when(size >= 4, F.encode(F.lit("###"), "UTF-8")).when(size == 3, F.encode(F.lit("##"), "UTF-8")).otherwise(low)

    return F.when(_c(x) == "", F.encode(F.lit(""), "UTF-8")).otherwise(F.unhex(F.array_join(F.transform(F.split(_c(x), ""), lambda c: F.hex(one(c))), "")))


def utf8_decode(x) -> Column:
    """Text of UTF-8 bytes; a byte that begins no character gives a question mark, a character that is cut off at the end nothing."""

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else lenient(bytes(b)))

    valid = F.is_valid_utf8(_c(x).cast("string"))
    return F.when(valid, _c(x).cast("string")).otherwise(run(_c(x)))


def lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 0
        if size < 2:
            out.append(chr(lead) if size else "?")
            at += 1
            continue
        if at + size > len(raw):
            break
        code = lead & (0x7F >> size)
        for byte in raw[at + 1 : at + size]:
            code = code << 6 | byte & 0x3F
        out.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "?")
        at += size
    return "".join(out)


def strip_comments(x) -> Column:
    """Without ``<!-- -->``; one that is never closed takes the rest with it."""
    return F.regexp_replace(_c(x), r"(?s)<!--.*?(-->|\z)", "")


def normalize_newlines(x) -> Column:
    """A carriage return alone becomes a line feed; one before a line feed stays."""
    return F.regexp_replace(_c(x), r"\r(?!\n)", "\n")


def is_redirect(x) -> Column:
    return (F.length(_c(x)) < 200) & F.contains(to_lower(x), F.lit("#redirect"))


def redirect_target(x) -> Column:
    """The title a redirect points to, underscores as blanks; empty if there is none."""
    return underscores_to_blanks(F.regexp_extract(_c(x), r"(?i)#redirect[^\[]*\[+(.*?)\]\]", 1))


def mime_type(name) -> Column:
    """Media type by extension, null if unknown."""
    extension = F.lower(F.regexp_extract(_c(name), r"\.([A-Za-z0-9]+)$", 1))
    pairs = [F.lit(v) for item in MIME_TYPES.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), extension)


def format_number(x, separator: str = ",", compat: bool = True) -> Column:
    """Digits grouped by three; the fraction's sign is the other of comma and point.

    With ``compat`` a sign before a whole number of groups is followed by a separator too.
    """
    text = _c(x).cast("string")
    point = "." if separator == "," else ","
    at = F.instr(text, point)
    whole = F.when(at > 0, F.left(text, at - 1)).otherwise(text)
    rest = F.when(at > 0, F.substr(text, at)).otherwise(F.lit(""))
    before = "." if compat else "[0-9]"
    return F.concat(F.regexp_replace(whole, f"(?<={before})(?=(?:[0-9]{{3}})+$)", separator), rest)


def pixel_size(x) -> Column:
    """struct(width, height) of ``Npx`` or ``NxMpx``; null if the text is neither. Height is null without M."""
    pattern = r"^ *([0-9]*)(?:[xX]([0-9]+))?[pP][xX] *$"
    number = lambda i: F.regexp_extract(_c(x), pattern, i).try_cast("int")
    return F.when(
        _c(x).rlike(pattern), F.struct(F.coalesce(number(1), F.lit(0)).alias("width"), number(2).alias("height"))
    )


def is_external(x) -> Column:
    return _c(x).rlike(r"^(?i)(https?://|gopher://|mailto:|news://|ftp://|irc://)")
