"""Column functions on text: normal forms, identifiers, masks, matching tiers, scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of identifiers.
PAN = "[A-Z]{5}[0-9]{4}[A-Z]"
IFSC = "[A-Z]{4}0[A-Z0-9]{6}"
PIN_CODE = "[1-9][0-9]{5}"
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
AMOUNT = "[0-9]{1,3}(?:,[0-9]{2,3})+(?:[.][0-9]{1,2})?"

#: Unicode ranges of scripts.
SCRIPTS = {"latin": "[A-Za-zÀ-ɏ]", "devanagari": "[ऀ-ॿ]", "gujarati": "[઀-૿]", "cyrillic": "[Ѐ-ӿ]", "greek": "[Ͱ-Ͽ]"}


def normalised(c: Column) -> Column:
    """Lower case; letters, digits and marks, with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}\\p{M}]+", " "))


def compact(c: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def canonical_field(c: Column, aliases: dict[str, str]) -> Column:
    """Snake case, then the canonical name of an alias."""
    name = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")
    if not aliases:
        return name
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(names, name), name)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def phone(c: Column) -> Column:
    """Last ten digits without country code and leading zeros."""
    bare = F.regexp_replace(digits(c), "^0+", "")
    bare = F.when((F.length(bare) > 10) & bare.startswith("91"), F.substring(bare, 3, 20)).otherwise(bare)
    return F.right(bare, F.lit(10))


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def masked(c: Column, shown: int = 4, most: int = 8) -> Column:
    """At most `most` stars, then the last `shown` characters; shorter values are all stars."""
    length = F.length(c)
    stars = F.expr("repeat('*', 1)")
    hidden = F.least(F.lit(most), length - shown)
    return F.when(length <= shown, F.repeat(F.lit("*"), length)).otherwise(F.concat(F.repeat(stars, hidden), F.right(c, F.lit(shown))))


def harvest(c: Column, pattern: str, most: int | None = 10) -> Column:
    """Distinct matches in order, at most `most` (None: all)."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)))
    return found if most is None else F.slice(found, 1, most)


def lines_after(c: Column, label: str, most: int = 3) -> Column:
    """Up to `most` lines after the first line that starts with label (any case)."""
    rows = F.split(c, "\n")
    starts = F.transform(rows, lambda x: F.startswith(F.lower(F.trim(x)), F.lit(label.lower())))
    at = F.array_position(starts, True)
    return F.when(at > 0, F.slice(rows, (at + 1).cast("int"), most)).otherwise(F.array().cast("array<string>"))


def labelled_value(c: Column, label: str) -> Column:
    """What stands after `label:` on its line."""
    return F.nullif(F.trim(F.regexp_extract(c, f"(?im)^[ ]*{label}[ ]*:[ ]*([^\\n]*)", 1)), F.lit(""))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalised(c), " "), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty values."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def name_score(a: Column, b: Column) -> Column:
    """100 equal or equal word sets, 95 prefix, 90 one's words contain the other's (two or more), else 100 x token Jaccard."""
    x, y = normalised(a), normalised(b)
    u, v = tokens(a), tokens(b)
    inside = (F.size(F.array_except(u, v)) == 0) | (F.size(F.array_except(v, u)) == 0)
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when(x == y, 100.0)
        .when((F.size(F.array_except(u, v)) == 0) & (F.size(F.array_except(v, u)) == 0), 100.0)
        .when(x.startswith(y) | y.startswith(x), 95.0)
        .when(inside & (F.least(F.size(u), F.size(v)) >= 2), 90.0)
        .otherwise(F.round(100 * jaccard(u, v), 2))
    )


def skeleton(c: Column) -> Column:
    """Consonants of the compact form."""
    return F.regexp_replace(compact(c), "[aeiouy]", "")


def identifier_matches(a: Column, b: Column) -> Column:
    """Blank is unknown and passes; full identifiers must be equal; a masked or four-digit one matches on its last four."""
    x, y = F.upper(F.regexp_replace(a, "[\\s-]", "")), F.upper(F.regexp_replace(b, "[\\s-]", ""))
    hidden_x, hidden_y = x.rlike("^[X*]+[0-9]{4}$|^[0-9]{4}$"), y.rlike("^[X*]+[0-9]{4}$|^[0-9]{4}$")
    return F.when(F.coalesce(x, F.lit("")) == "", True).when(F.coalesce(y, F.lit("")) == "", True).when(hidden_x | hidden_y, F.right(x, F.lit(4)) == F.right(y, F.lit(4))).otherwise(x == y)


def repaired_digits(c: Column) -> Column:
    """Letters that are read for digits, put right."""
    return F.translate(F.upper(c), "OQDILZMSGB", "0001124568")


def script_counts(c: Column) -> Column:
    """Map of script to its number of characters."""
    return F.create_map(*[x for name, chars in SCRIPTS.items() for x in (F.lit(name), F.regexp_count(c, F.lit(chars)))])


def status_passes(c: Column, accepted: list[str], rejected: list[str]) -> Column:
    """A rejected term beats an accepted one; null is unknown."""
    low = F.lower(c)

    def has(terms: list[str]) -> Column:
        return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))

    return F.when(c.isNull(), F.lit(None)).otherwise(~has(rejected) & has(accepted))


def clean_text(c: Column) -> Column:
    """Without markup tags and NUL characters."""
    return F.translate(F.regexp_replace(c, "<[^>]+>", ""), "\u0000", " ")


def merged_lines(*texts: Column) -> Column:
    """Lines of all texts, each once, in order."""
    return F.array_join(F.array_distinct(F.flatten(F.array(*[F.split(t, "\n") for t in texts]))), "\n")


def fingerprint(c: Column) -> Column:
    return F.sha2(normalised(c), 256)
