"""Traditional to simplified Chinese, by the public transform of the ICU library that Spark ships."""

from __future__ import annotations

from functools import cache

from pyspark.sql import SparkSession

#: The letters that fold: those of three bytes in UTF-8 whose first is E4 to E9.
FIRST, LAST = 0x4E00, 0x9FFF


@cache
def _transformed() -> tuple[str, str]:
    jvm = SparkSession.active()._jvm
    letters = "".join(map(chr, range(FIRST, LAST + 1)))
    plain = jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate(letters)
    if len(plain) != len(letters):  # a letter outside the plane takes two of Java's characters, one of Python's
        raise ValueError("the transform does not map letter by letter")
    pairs = [(a, b) for a, b in zip(letters, plain) if a != b and FIRST <= ord(b) <= LAST]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def simplified_table() -> tuple[str, str]:
    """Two strings for ``translate``: every traditional letter and its simplified form. Needs an active session.

    An archive whose keys were folded with another table gives that one to ``fold_zh`` and ``key1`` instead.
    """
    return _transformed()
