"""Column functions on names, relations and addresses, with exact ratios as Arrow UDFs where no expression has them."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docketry.functions import text

#: Honorifics that are no part of a name.
HONORIFICS = "mr|mrs|ms|miss|shri|smt|dr|kumari"
#: Short forms of address words.
ADDRESS_FORMS = {"rd": "road", "st": "street", "nr": "near", "opp": "opposite", "apt": "apartment", "bldg": "building", "flr": "floor", "soc": "society", "dist": "district"}
#: Relation marks and what they mean.
RELATIONS = {"s/o": "son", "d/o": "daughter", "w/o": "wife", "c/o": "care"}


def bare_name(c: Column) -> Column:
    """Normal form without honorifics."""
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), text.normalised(c), F.lit(" ")), f"( ({HONORIFICS}))+ ", " "))


def name_reject_reason(c: Column) -> Column:
    """Why a value is no person's name, or null."""
    bare = bare_name(c)
    return (
        F.when(F.coalesce(F.trim(c), F.lit("")) == "", "BLANK")
        .when(c.rlike("[0-9]"), "DIGITS")
        .when(c.rlike("@|https?:|www[.]"), "CONTACT")
        .when(F.length(bare) < 3, "SHORT")
        .when(F.length(bare) > 60, "LONG")
        .when(F.size(F.split(bare, " ")) > 6, "MANY_WORDS")
        .when(bare.rlike("\\b(bank|limited|ltd|branch|account|address|statement)\\b"), "ORGANISATION")
    )


def relation(c: Column) -> Column:
    """Struct (kind, name) of the first relation mark, as in `S/O name`."""
    mark = F.lower(F.regexp_extract(c, "(?i)\\b([sdwc]/o)\\b", 1))
    name = F.trim(F.regexp_extract(c, "(?i)\\b[sdwc]/o[ :.]*([\\p{L} .]+)", 1))
    kinds = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    return F.when(mark != "", F.struct(F.try_element_at(kinds, mark).alias("kind"), name.alias("name")))


def address_tokens(c: Column) -> Column:
    """Distinct words of an address, short forms written out."""
    forms = F.create_map(*[F.lit(x) for pair in ADDRESS_FORMS.items() for x in pair])
    return F.array_distinct(F.transform(text.tokens(c), lambda t: F.coalesce(F.try_element_at(forms, t), t)))


def address_match(a: Column, b: Column) -> Column:
    """EMPTY, UNIT_CONFLICT (numbers on both sides, none shared), SUBSET, PIN (shared PIN code and half of the shorter's words), SIMILAR (Jaccard 0.7) or DIFFERENT."""
    u, v = address_tokens(a), address_tokens(b)

    def units(x: Column) -> Column:
        return F.filter(x, lambda t: t.rlike("^[0-9]{1,5}[a-z]?$"))

    def pins(x: Column) -> Column:
        return F.filter(x, lambda t: t.rlike(f"^{text.PIN_CODE}$"))

    shared, shorter = F.size(F.array_intersect(u, v)), F.least(F.size(u), F.size(v))
    return (
        F.when(shorter == 0, "EMPTY")
        .when((F.size(units(u)) > 0) & (F.size(units(v)) > 0) & ~F.arrays_overlap(units(u), units(v)), "UNIT_CONFLICT")
        .when(shared == shorter, "SUBSET")
        .when(F.arrays_overlap(pins(u), pins(v)) & (shared >= 0.55 * shorter), "PIN")
        .when(text.jaccard(u, v) >= 0.7, "SIMILAR")
        .otherwise("DIFFERENT")
    )


def _blocks(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in common blocks, 0 to 1; null where a side is null."""
    return pd.Series([None if x is None or y is None else _blocks(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Largest block ratio of the shared words, and of those with the rest of either side, 0 to 100."""

    def ratio(x: str, y: str) -> float:
        u, v = set(x.split()), set(y.split())
        if not u or not v:
            return 0.0
        both = " ".join(sorted(u & v))
        left, right = f"{both} {' '.join(sorted(u - v))}".strip(), f"{both} {' '.join(sorted(v - u))}".strip()
        return 100 * max([_blocks(left, right)] + [_blocks(both, left), _blocks(both, right)] * bool(both))

    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)
