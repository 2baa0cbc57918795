"""Scalar functions: on columns where they meet data, on Python values where they read options."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: size suffixes are binary multiples
SUFFIX = {"": 0, "K": 10, "M": 20, "G": 30, "T": 40, "P": 50, "E": 60}
FALSE_WORDS = ("0", "f", "false", "n", "no")
MIN_WORDS, MAX_WORDS = ("min", "first", "begin", "b"), ("max", "last", "end", "e")


def ceil_div(a: Column, b: Column) -> Column:
    """Ceiling of a / b for whole numbers >= 0; 0 where b is 0."""
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.expr("1").cast("long") * F.floor((a + b - 1) / F.nullif(b, F.lit(0)))).cast("long")


def round_to_multiple(a: Column, b: Column) -> Column:
    return ceil_div(a, b) * b


def to_bool(x: Column, default: bool = False) -> Column:
    """False for 0, f, false, n and no in any case; null gives the default."""
    return F.when(x.isNull(), F.lit(default)).otherwise(~F.lower(x).isin(*FALSE_WORDS))


def parse_bool(x: str | None, default: bool = False) -> bool:
    return default if x is None else x.lower() not in FALSE_WORDS


def parse_size(x: str) -> int:
    """Whole number, decimal, 0x or 0 octal, with an optional binary suffix K to E."""
    m = re.fullmatch(r"\s*(0[xX][0-9a-fA-F]+|\d+)\s*([KMGTPE]?)i?[bB]?\s*", x, re.IGNORECASE) if not re.fullmatch(r"\s*0[xX][0-9a-fA-F]+\s*", x) else re.fullmatch(r"\s*(0[xX][0-9a-fA-F]+)()\s*", x)
    if not m:
        raise ValueError(f"not a size: {x!r}")
    digits = m[1]
    base = 16 if digits[:2].lower() == "0x" else 8 if len(digits) > 1 and digits[0] == "0" else 10
    return int(digits, base) << SUFFIX[m[2].upper()]


def parse_bound(x: str, least: int, most: int) -> int:
    """A size, or a word for the least or the most value."""
    if x.lower() in MIN_WORDS:
        return least
    if x.lower() in MAX_WORDS:
        return most
    return parse_size(x)


def file_extension(name: str) -> str:
    base = name.rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[1].lower() if "." in base else ""


def encode_tag(owner: Column, part: Column) -> Column:
    """Two part numbers in one tag: owner in the upper 16 bits."""
    return F.shiftleft(owner.cast("long"), 16).bitwiseOR(part.cast("long"))


def decode_tag(tag: Column) -> tuple[Column, Column]:
    return F.shiftright(tag, 16), tag.bitwiseAND(F.lit(65535))


def transpose_tag(tag: Column) -> Column:
    owner, part = decode_tag(tag)
    return encode_tag(part, owner)


def replace_text(x: Column, old: str, new: str) -> Column:
    """Every occurrence of a literal string replaced."""
    return F.replace(x, F.lit(old), F.lit(new)) if old else x


def millis(seconds: Column) -> Column:
    return seconds * 1e3


def micros(seconds: Column) -> Column:
    return seconds * 1e6
