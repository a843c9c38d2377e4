"""Small text expressions."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = r"[\s\x1c-\x1f]"
_CITE_TOKEN = r"(?i)\[\[\s*cite\s*:[^\]]{0,16}\]\]"

#: digits of all scripts, and the ASCII digits they stand for
_DIGITS = tuple(map("".join, zip(*((c, str(unicodedata.decimal(c))) for c in map(chr, range(0x80, sys.maxunicode + 1))
                                   if unicodedata.decimal(c, None) is not None), strict=True)))

SAMPLE_MARK = "\n\n[...]\n\n"  # fixed value
CHARS_PER_TOKEN = 2            # fixed value


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(_col(text), rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def lstrip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"(?U)^{_SPACE}+", "")


def rstrip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"(?U){_SPACE}+$", "")


def is_blank(text: Column | str) -> Column:
    return strip(F.coalesce(_col(text), F.lit(""))) == ""


def clip(text: Column, limit: int) -> Column:
    """Text cut at ``limit`` characters and marked, when longer."""
    return F.when(F.length(text) > limit,
                  F.concat(rstrip(F.substring(text, 1, limit)), F.lit(" …"))).otherwise(text)


def token_estimate(text: Column | str) -> Column:
    """Two characters per token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / CHARS_PER_TOKEN)).cast("bigint")


def strip_cite_tokens(text: Column | str) -> Column:
    """Remove citation tokens, malformed ones too."""
    return F.regexp_replace(_col(text), _CITE_TOKEN, "")


@F.pandas_udf(T.StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def slugify(name: Column | str) -> Column:
    """Slug that keeps Hangul; only text outside ASCII visits Python to be composed."""
    name = _col(name)
    composed = F.when(name.rlike(r"^[\x00-\x7f]*$"), name).otherwise(_compose(name))
    s = F.lower(strip(composed))
    s = F.regexp_replace(s, rf"(?U)(?:{_SPACE}|/)+", "-")
    s = F.regexp_replace(s, "[^0-9a-z가-힣ㄱ-ㆎ-]+", "")
    s = F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^-+|-+$", "")
    return F.when(s == "", "topic").otherwise(s)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of all scripts as 0 to 9."""
    return F.translate(text, *_DIGITS)


def parse_number(text: Column | str) -> Column:
    """First number in the text, thousands commas removed, else null. Digits of all scripts
    count."""
    found = F.regexp_extract(F.coalesce(_col(text), F.lit("")), r"(?U)-?\d[\d,]*(?:\.\d+)?", 0)
    return ascii_digits(F.replace(found, F.lit(","), F.lit(""))).try_cast("double")


def clock(ms: Column | str) -> Column:
    """``h:mm:ss``, or ``m:ss`` below an hour."""
    total = F.floor(_col(ms) / 1000).cast("bigint")
    h, m, s = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(
        F.format_string("%d:%02d", m, s))


def round_tenths(value: Column) -> Column:
    """A double to one decimal: the nearer tenth of its exact binary value, halves to even.

    Ten times the value is split into the double next to it and the exact rest (the value's
    upper and lower halves times ten have no error), so 10.35, which is a little less than
    it looks, becomes 10.3.
    """
    big = value * F.lit(134217729.0)
    upper = big - (big - value)
    tenfold = value * F.lit(10.0)
    rest = (upper * F.lit(10.0) - tenfold) + (value - upper) * F.lit(10.0)
    down = F.floor(tenfold).cast("double")
    over = (tenfold - down - F.lit(0.5)) + rest
    even = down - F.lit(2.0) * F.floor(down / 2) == 0
    return F.when((over < 0) | ((over == 0) & even), down / 10).otherwise((down + 1) / 10)
