"""Tokens, canonical keys and dates as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Invisible characters deleted before a text is cut into tokens.
INVISIBLE = "­​⁠﻿"

#: Zeros of the decimal digit runs of Unicode that Java's \p{Nd} knows and texts of this domain may use.
DIGIT_ZEROS = (0x0660, 0x06F0, 0x07C0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66,
               0x0E50, 0x0ED0, 0x0F20, 0x1040, 0x17E0, 0x1810, 0xFF10)

_DIGITS_FROM = "".join(chr(z + d) for z in DIGIT_ZEROS for d in range(10))
_DIGITS_TO = "0123456789" * len(DIGIT_ZEROS)


def token_text(text: Column) -> Column:
    """The tokens of a text joined by single spaces; null and token-free texts give ''.

    Texts that are ASCII throughout, recognised by their lengths, take a cheaper pattern with the same result.
    """
    whole = text
    for c in INVISIBLE:
        whole = F.replace(whole, F.lit(c), F.lit(""))
    general = F.regexp_replace(F.lower(whole), r"[^\p{L}\p{N}]+", " ")
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.coalesce(F.trim(F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(general)), F.lit(""))


def token_array(text: Column) -> Column:
    """The tokens of a text as an array; null and token-free texts give an empty array."""
    joined = token_text(text)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script written 0-9."""
    return F.translate(text, _DIGITS_FROM, _DIGITS_TO)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}\x{AD}\x{200B}\x{2060}\x{FEFF}]+|[\s\p{Z}\x{AD}\x{200B}\x{2060}\x{FEFF}]+$", "")


def canonical_statute(statute: Column) -> Column:
    return F.upper(_trimmed(statute))


def canonical_unit(unit: Column) -> Column:
    return F.lower(_trimmed(unit))


def canonical_number(number: Column) -> Column:
    """Digits 0-9, spaces and hyphens of any kind (and invisible characters) removed, letters upper-cased."""
    return F.upper(F.regexp_replace(ascii_digits(number), r"[\s\p{Z}\p{Pd}\x{2212}\x{AD}\x{200B}\x{2060}\x{FEFF}]+", ""))


def canonical_key(statute: Column = None, unit: Column = None, number: Column = None) -> list[Column]:
    """The three columns of a provision's identity; a null part stays null and is a key value of its own."""
    return [
        canonical_statute(F.col("statute") if statute is None else statute).alias("statute"),
        canonical_unit(F.col("unit") if unit is None else unit).alias("unit"),
        canonical_number(F.col("number") if number is None else number).alias("number"),
    ]


def iso_date(day: Column) -> Column:
    """yyyy-MM-dd, '' for an open date."""
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))
