"""Comparing an observed value with a trusted one, by the kind of its field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions import text

#: Kinds of fields.
NUMERIC = ("loan_amount", "sanction_amount", "emi", "roi", "apr", "tenure_months", "processing_fee", "credit_score")
DATES = ("date_of_birth", "application_date", "sanction_date", "statement_date")
EXACT = ("pan_number", "aadhaar_number", "aadhaar_last4", "account_number", "phone_number", "pin_code", "ifsc", "application_number")
ADDRESSES = ("address", "current_address", "permanent_address", "communication_address")
NAMES = ("applicant_name", "borrower_name", "account_holder_name", "customer_name")
#: Words before a person's name that are no part of it.
TITLES = ("mr", "mrs", "ms", "miss", "master", "shri", "smt", "kumari", "dr", "shree", "sree", "late", "sri")
#: Name endings that are often written onto the word before.
ENDINGS = "lal|bai|devi|singh|kumar"
#: Words that do not tell one address from another.
COMMON_PLACES = ("so", "wo", "do", "co", "po", "dist", "district", "state", "india", "gujarat", "rajasthan", "ahmedabad", "ahmadabad")
_PIN = "\\b[1-8][0-9]{5}\\b"


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def number(c: Column) -> Column:
    """The first number of a value, commas dropped; null for none."""
    return F.regexp_extract(F.regexp_replace(c.cast("string"), ",", ""), "-?[0-9]+(?:[.][0-9]+)?", 0).try_cast("double")


def day(c: Column) -> Column:
    """A date written as ISO or day first, with slashes, dashes or points; null for what is none."""
    parts = F.regexp_replace(F.trim(c), "[/.]", "-")
    first = F.try_to_timestamp(F.when(parts.rlike("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), parts), F.lit("d-M-yyyy"))
    return F.coalesce(F.try_to_timestamp(F.when(parts.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), parts), F.lit("yyyy-MM-dd")), first).cast("date")


def within(a: Column, b: Column, share: float = 0.01, least: float = 0.01) -> Column:
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(least), F.abs(a) * share), F.lit(False))


def exact(a: Column, b: Column, last_four: Column) -> Column:
    """Equal without marks; where last_four allows it, a masked or four-digit side matches on its last four."""
    x, y = text.compact(a), text.compact(b)
    hidden = [F.regexp_replace(c, "[ -]", "").rlike("^[xX*#•]+[0-9]{4}$") for c in (a, b)]
    short = F.least(F.length(x), F.length(y)) == 4
    tail = (F.length(x) >= 4) & (F.length(y) >= 4) & (short | hidden[0] | hidden[1]) & (F.right(x, F.lit(4)) == F.right(y, F.lit(4)))
    return (x == y) | (last_four & tail)


def name_words(c: Column) -> Column:
    """Distinct Latin words of a name in order, without titles, endings split off."""
    low = F.regexp_replace(F.lower(c), f"([a-z])({ENDINGS})\\b", "$1 $2")
    return F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit("([a-z]+)"), F.lit(1)), lambda w: ~w.isin(*TITLES)))


def _initials(short: Column, long: Column) -> Column:
    """The one-letter words of short begin the first words of long, and its others stand in long."""
    single = F.filter(short, lambda w: F.length(w) == 1)
    firsts = F.slice(F.transform(long, lambda w: F.substring(w, 1, 1)), F.lit(1), F.greatest(F.size(single), F.lit(1)))
    rest = F.filter(short, lambda w: F.length(w) > 1)
    return (F.size(single) > 0) & (F.size(short) <= F.size(long)) & (single == firsts) & (F.size(F.array_except(rest, long)) == 0)


def person_score(a: Column, b: Column) -> Column:
    """0 to 100: 100 the same words, 95 one a beginning of the other or its initials, 90 one within the other, else 100 x edit similarity of the sorted words."""
    return words_score(name_words(a), name_words(b))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c worked out once, however often it is used."""
    return F.transform(F.array(c), use)[0]


def name_parts(words: Column) -> Column:
    """Struct (words, joined, sorted, initial) of name_words, all that parts_score looks at."""
    return once(words, lambda w: F.struct(w.alias("words"), F.array_join(w, "").alias("joined"), F.array_join(F.sort_array(w), " ").alias("sorted"), F.exists(w, lambda x: F.length(x) == 1).alias("initial")))


def words_score(u: Column, v: Column) -> Column:
    """person_score of two arrays of name_words. Take columns, not long expressions: each is used many times."""
    return parts_score(name_parts(u), name_parts(v))


def parts_score(a: Column, b: Column) -> Column:
    """words_score of two name_parts."""
    u, v, x, y = a["words"], b["words"], a["joined"], b["joined"]
    short, long = F.when(F.size(u) <= F.size(v), u).otherwise(v), F.when(F.size(u) <= F.size(v), v).otherwise(u)
    same = (F.size(u) == F.size(v)) & (F.size(F.array_except(u, v)) == 0)
    return (
        F.when((F.size(u) == 0) | (F.size(v) == 0), 0.0)
        .when(same | (x == y), 100.0)
        .when(short == F.slice(long, F.lit(1), F.greatest(F.size(short), F.lit(1))), 95.0)
        .when((a["initial"] & _initials(u, v)) | (b["initial"] & _initials(v, u)), 95.0)
        .when((F.length(x) >= 4) & (F.contains(x, y) | F.contains(y, x)), 90.0)
        .otherwise(F.round(100 * text.edit_similarity(a["sorted"], b["sorted"]), 1))
    )


def address_words(c: Column) -> Column:
    low = F.regexp_replace(F.lower(c), "\\b([swdc])\\s*/\\s*o\\b", "$1o")
    low = F.regexp_replace(low, f"([a-z])({ENDINGS})\\b", "$1 $2")
    return F.array_distinct(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)))


#: Words before the number of a dwelling.
DWELLINGS = ("flat", "apartment", "apt", "house", "unit", "door", "room", "quarter")
_NUMBER = "[a-z]?\\s*[-/]?\\s*[0-9]{1,5}[a-z]?\\b"


def units(c: Column) -> Column:
    """Numbers of dwellings without marks; a number with a letter before it at the beginning counts as one."""
    low = F.lower(c)
    named = F.regexp_extract_all(low, F.lit(f"\\b(?:{'|'.join(DWELLINGS)})(?:\\s*(?:number|no)\\.?)?\\s*({_NUMBER})"), F.lit(1))
    first = F.regexp_extract_all(low, F.lit("^\\s*([a-z]\\s*[-/]?\\s*[0-9]{1,5}[a-z]?)\\b"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(named, first), lambda x: F.regexp_replace(x, "[^a-z0-9]", "")))


def plots(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("\\b(?:plot|block)\\s*(?:(?:number|no)\\.?\\s*)?([a-z]?\\s*[-/]?\\s*[0-9]{1,5}[a-z]?)\\b"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, "[^a-z0-9]", ""))


def address_parts(c: Column) -> Column:
    """Struct (words, own, telling, pins, units, plots, letters) of an address, all that address_kind looks at; own are its telling words with numbers."""
    pins = F.regexp_extract_all(c, F.lit(f"({_PIN})"), F.lit(1))

    def telling(words: Column, digits: bool) -> Column:
        return F.filter(words, lambda w: ~w.isin(*COMMON_PLACES) & (F.length(w) >= 3) & ~w.rlike("^[1-8][0-9]{5}$") & (F.lit(digits) | ~w.rlike("^[0-9]+$")))

    def parts(words: Column) -> Column:
        return F.struct(words.alias("words"), telling(words, True).alias("own"), telling(words, False).alias("telling"), pins.alias("pins"), units(c).alias("units"), plots(c).alias("plots"), text.compact(c).alias("letters"))

    return once(address_words(c), parts)


def address_kind(a: Column, b: Column) -> Column:
    """Why two addresses are one or not: UNIT_CONFLICT, SUBSET, PIN_WORDS, UNIT_PLACE, PIN_PLACE, WORDS, SIMILAR or DIFFERENT.

    UNIT_CONFLICT: both name a flat or plot and none is shared. SUBSET: all words
    of one, two at least, are in the other. PIN_WORDS: one PIN code, five
    shared words and three quarters of the shorter. UNIT_PLACE: a shared flat
    and two telling words. PIN_PLACE: one PIN code and two telling words, of
    which spelling may differ. WORDS: seven tenths of all words. SIMILAR: edit
    similarity of 0.82.
    """
    return parts_kind(address_parts(a), address_parts(b))


def parts_kind(a: Column, b: Column) -> Column:
    """address_kind of two address_parts. Take columns, not long expressions: each is used many times."""
    u, v = a["words"], b["words"]
    shared, shorter = F.array_intersect(u, v), F.least(F.size(u), F.size(v))
    one_pin = F.arrays_overlap(a["pins"], b["pins"])
    own = F.array_intersect(a["own"], b["own"])
    left, right = F.array_except(a["telling"], own), F.array_except(b["telling"], own)
    near = F.size(F.filter(left, lambda x: F.exists(right, lambda y: text.edit_similarity(x, y) >= 0.78)))
    clash = [(F.size(a[f]) > 0) & (F.size(b[f]) > 0) & ~F.arrays_overlap(a[f], b[f]) for f in ("units", "plots")]
    return (
        F.when(clash[0] | clash[1], "UNIT_CONFLICT")
        .when((shorter >= 2) & (F.size(shared) == shorter), "SUBSET")
        .when(one_pin & (F.size(shared) >= 5) & (F.size(shared) >= 0.75 * shorter), "PIN_WORDS")
        .when(F.arrays_overlap(a["units"], b["units"]) & (F.size(own) >= 2), "UNIT_PLACE")
        .when(one_pin & ((F.size(own) >= 2) | (F.size(own) + near >= 2)), "PIN_PLACE")
        .when(text.jaccard(u, v) >= 0.7, "WORDS")
        .when(text.edit_similarity(a["letters"], b["letters"]) >= 0.82, "SIMILAR")
        .otherwise("DIFFERENT")
    )


def same_address(a: Column, b: Column) -> Column:
    return ~address_kind(a, b).isin("UNIT_CONFLICT", "DIFFERENT")


def relation_prefix(c: Column) -> Column:
    """Struct (mark, name) of `S/O name`, up to two words; null without one."""
    low = F.regexp_replace(F.lower(c), "\\b([swdc])\\s*/\\s*o\\b", "$1o")
    pattern = "\\b(so|wo|do|co)\\s*[:-]?\\s*([a-z]+(?:\\s+[a-z]+)?)"
    return F.when(low.rlike(pattern), F.struct(F.regexp_extract(low, pattern, 1).alias("mark"), F.regexp_extract(low, pattern, 2).alias("name")))


def same_relation(a: Column, b: Column, words: int = 3) -> Column:
    """Both begin with the same relation mark and alike names (to the length of the shorter), and one has few words."""
    return _one_relation(relation_prefix(a), relation_prefix(b), address_words(a), address_words(b), words)


def _one_relation(x: Column, y: Column, u: Column, v: Column, words: int) -> Column:
    n, m = F.split(x["name"], "\\s+"), F.split(y["name"], "\\s+")
    size = F.greatest(F.least(F.size(n), F.size(m)), F.lit(1))
    alike = text.edit_similarity(F.array_join(F.slice(n, F.lit(1), size), " "), F.array_join(F.slice(m, F.lit(1), size), " ")) >= 0.75
    return F.coalesce((x["mark"] == y["mark"]) & alike & (F.least(F.size(u), F.size(v)) <= words), F.lit(False))


def kind_of(field: Column) -> Column:
    kinds = (("number", NUMERIC), ("date", DATES), ("exact", EXACT), ("address", ADDRESSES), ("name", NAMES))
    out = F.when(F.lit(False), "")
    for kind, fields in kinds:
        out = out.when(field.isin(*fields), kind)
    return out.otherwise("text")


def matches(field: Column, a: Column, b: Column, names_from: float = 85.0) -> Column:
    """Whether two values of a field agree; a blank side is unknown and agrees."""
    kind, alike = kind_of(field), text.edit_similarity(text.compact(a), text.compact(b)) >= 0.88
    days = day(a).isNotNull() & day(b).isNotNull()
    return (
        F.when(blank(a) | blank(b), True)
        .when(kind == "number", within(number(a), number(b)))
        .when((kind == "date") & days, day(a) == day(b))
        .when(kind == "exact", exact(a, b, field.isin("aadhaar_number", "aadhaar_last4", "account_number")))
        .when(kind == "address", same_address(a, b) | same_relation(a, b))
        .when(kind == "name", person_score(a, b) >= names_from)
        .otherwise(alike)
    )


def prepared(field: Column, value: Column, relations: bool = True) -> Column:
    """Struct of what `agree` (with the same relations) looks at in a value of a field, so that it is worked out once a value and not once a pair."""
    kind = kind_of(field)
    name = F.when(kind == "name", name_parts(name_words(value)))
    place = F.when(kind == "address", address_parts(value))
    return F.struct(
        kind.alias("kind"), blank(value).alias("blank"), F.when(kind.isin("exact", "date", "text"), text.compact(value)).alias("letters"), F.when(kind == "exact", F.regexp_replace(value, "[ -]", "").rlike("^[xX*#•]+[0-9]{4}$")).alias("hidden"), F.when(kind == "number", number(value)).alias("number"),
        F.when(kind == "date", day(value)).alias("day"), name.alias("name"), place.alias("place"), *([F.when(kind == "address", relation_prefix(value)).alias("relation")] if relations else []),
    )


def agree(field: Column, a: Column, b: Column, names_from: float = 85.0, relations: bool = True) -> Column:
    """`matches` of two prepared values of a field."""
    kind, x, y = a["kind"], a["letters"], b["letters"]
    short = F.least(F.length(x), F.length(y)) == 4
    tail = (F.length(x) >= 4) & (F.length(y) >= 4) & (short | a["hidden"] | b["hidden"]) & (F.right(x, F.lit(4)) == F.right(y, F.lit(4)))
    place = ~parts_kind(a["place"], b["place"]).isin("UNIT_CONFLICT", "DIFFERENT")
    if relations:
        place = place | _one_relation(a["relation"], b["relation"], a["place"]["words"], b["place"]["words"], 3)
    return (
        F.when(a["blank"] | b["blank"], True)
        .when(kind == "number", within(a["number"], b["number"]))
        .when((kind == "date") & a["day"].isNotNull() & b["day"].isNotNull(), a["day"] == b["day"])
        .when(kind == "exact", (x == y) | (field.isin("aadhaar_number", "aadhaar_last4", "account_number") & tail))
        .when(kind == "address", place)
        .when(kind == "name", parts_score(a["name"], b["name"]) >= names_from)
        .otherwise(text.edit_similarity(x, y) >= 0.88)
    )


def names_with_relatives(observed: Column, trusted: Column, relatives: Column, names_from: float = 85.0) -> Column:
    """A name that is the trusted one, or has all its words and only words of relatives besides."""
    u, v, known = name_words(observed), name_words(trusted), name_words(relatives)
    extra = F.array_except(u, v)
    family = F.forall(extra, lambda w: F.exists(known, lambda r: text.edit_similarity(w, r) >= 0.75))
    return F.coalesce((person_score(observed, trusted) >= names_from) | ((F.size(v) > 0) & (F.size(F.array_except(v, u)) == 0) & (F.size(extra) > 0) & family), F.lit(False))
