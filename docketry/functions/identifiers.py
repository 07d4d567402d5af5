"""Formats of identifiers, and names in Indic scripts written in Latin letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions import text

#: Formats.
FORMATS = {
    "pan": f"^{text.PAN}$",
    "ifsc": f"^{text.IFSC}$",
    "pin_code": f"^{text.PIN_CODE}$",
    "voter": "^[A-Z]{3}[0-9]{7}$",
    "licence": "^[A-Z]{2}[0-9]{2}[0-9]{4}[0-9]{7}$",
    "email": f"^{text.EMAIL}$",
}
#: Latin writing of Devanagari letters and signs, of which some are not written.
DEVANAGARI = {
    "\u0901": "n", "\u0902": "n", "\u0903": "h", "अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ऋ": "ri",
    "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch",
    "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t",
    "थ": "th", "द": "d", "ध": "dh", "न": "n", "ऩ": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m",
    "य": "y", "र": "r", "ऱ": "r", "ल": "l", "ळ": "l", "ऴ": "l", "व": "v", "श": "sh", "ष": "sh", "स": "s",
    "ह": "h", "\u093c": "", "\u093e": "aa", "\u093f": "i", "\u0940": "ii", "\u0941": "u", "\u0942": "uu", "\u0943": "ri", "\u0947": "e", "\u0948": "ai",
    "\u094b": "o", "\u094c": "au", "\u094d": "", "०": "0", "१": "1", "२": "2", "३": "3", "४": "4", "५": "5", "६": "6",
    "७": "7", "८": "8", "९": "9",
}
#: Gujarati letters stand in the same order, so many code points further on.
GUJARATI = 0x0A80 - 0x0900


def letters() -> dict[str, str]:
    """Latin writing of each letter of both scripts."""
    return {chr(ord(letter) + shift): latin for shift in (0, GUJARATI) for letter, latin in DEVANAGARI.items()}


def romanised(c: Column) -> Column:
    """Devanagari and Gujarati letters in Latin ones, all else as it is.

    Texts without such letters are not taken apart.
    """
    table = F.create_map(*[F.lit(x) for pair in letters().items() for x in pair])
    each = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.when(c.rlike("[\\x{0900}-\\x{097F}\\x{0A80}-\\x{0AFF}]"), each).otherwise(c)


def bare(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[\\s-]", ""))


def valid(kind: str, c: Column) -> Column:
    """Whether a value has the format of its kind, spaces and dashes apart; null for null."""
    return (F.trim(c) if kind == "email" else bare(c)).rlike(FORMATS[kind])


def aadhaar(c: Column) -> Column:
    """The twelve digits, or null: other lengths, and mobile numbers with the country's 91 before them."""
    d = text.digits(c)
    return F.when(d.rlike("^[0-9]{12}$") & ~d.rlike("^91[6-9][0-9]{9}$"), d)
