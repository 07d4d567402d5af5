"""Column functions on words with boxes, confidences, answers, file names and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions import text

#: Letters with marks and without, for matching.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Type that a file's name tells, by what it holds; the first that fits.
FILE_TYPES = (("pan", "PAN"), ("aadhaar|aadhar|uid", "Aadhaar"), ("voter|epic", "Voter ID"), ("driv|licen", "Driving License"), ("bank|statement", "Bank Statement"), ("passbook", "Passbook"), ("cibil", "CIBIL Report"), ("crif", "CRIF Report"), ("cersai", "CERSAI Report"), ("sanction", "Sanction Letter"), ("application", "Application Form"), ("agreement", "Loan Agreement"), ("nach|mandate", "NACH Form"))
ROLES = (("co-?applicant|coapp", "coapplicant"), ("guarantor|gtr", "guarantor"), ("applicant|primary|borrower", "primary"))
#: What a failure's message tells.
FAILURES = (("timed? ?out", "TIMEOUT"), ("quota|rate limit|429", "QUOTA"), ("not found|no such file", "MISSING_INPUT"), ("corrupt|cannot open|broken", "BAD_INPUT"), ("memory", "MEMORY"), ("connection|unavailable|503", "SERVICE"))


def unmarked(c: Column) -> Column:
    """Lower case without accents and punctuation."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), MARKED, PLAIN), "[^\\p{L}\\p{N}\\p{M}]+", " "))


def first_of(c: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The value of the first pattern that a lower-case text holds, or null."""
    out = F.when(F.lit(False), "")
    for pattern, value in table:
        out = out.when(F.lower(c).rlike(pattern), value)
    return out


def file_facts(path: Column) -> Column:
    """Struct (type, role, person) out of a path: type and person from the base name, role from the folders."""
    name = F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), "(?i)\\.[a-z0-9]{2,4}$", "")
    words = F.filter(F.split(F.lower(F.regexp_replace(name, "[^A-Za-z]+", " ")), " "), lambda w: (F.length(w) > 1) & ~w.rlike("^(?:pan|aadhaar|aadhar|uid|voter|epic|card|copy|front|back|scan|page|doc|bank|statement|passbook|kyc)$"))
    return F.struct(first_of(name, FILE_TYPES).alias("type"), first_of(F.regexp_extract(path, "^(.*)/", 1), ROLES).alias("role"), F.nullif(F.array_join(words, " "), F.lit("")).alias("person"))


def failure_class(message: Column) -> Column:
    return F.coalesce(first_of(message, FAILURES), F.lit("OTHER"))


def coerced_words(words: Column) -> Column:
    """Words given as JSON under several names (t, text or word; b, box or bbox; c, conf or confidence) as one shape; entries without text are left out."""
    shape = "array<struct<t: string, text: string, word: string, b: array<double>, box: array<double>, bbox: array<double>, c: double, conf: double, confidence: double>>"
    made = F.transform(F.from_json(words, shape), lambda w: F.struct(F.coalesce(w["t"], w["text"], w["word"]).alias("t"), F.coalesce(w["b"], w["box"], w["bbox"]).alias("b"), F.coalesce(w["c"], w["conf"], w["confidence"], F.lit(1.0)).alias("c")))
    return F.filter(made, lambda w: F.coalesce(F.trim(w["t"]), F.lit("")) != "")


def scaled_box(box: Column, width: Column, height: Column) -> Column:
    """A box in parts of the page: kept if it is so already, else divided by the page's size; out of order sides are put right."""
    unit = F.array_max(box) <= 1.0
    x0, y0, x1, y1 = (F.when(unit, box[k]).otherwise(box[k] / (width if k % 2 == 0 else height)) for k in range(4))
    return F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def confidences(values: Column) -> Column:
    """Struct (mean, least) of an array of confidences; nulls do not count."""
    known = F.filter(values, lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return F.struct(F.when(F.size(known) > 0, F.round(total / F.size(known), 4)).alias("mean"), F.array_min(known).alias("least"))


def nested_confidence(payload: Column) -> Column:
    """Mean of all numbers under the key confidence in a JSON text, but for those of detected languages."""
    bare = F.regexp_replace(payload, '"detectedLanguages"\\s*:\\s*\\[[^\\]]*\\]', '""')
    found = F.transform(F.regexp_extract_all(bare, F.lit('"confidence"\\s*:\\s*([0-9.]+)'), F.lit(1)), lambda v: v.try_cast("double"))
    return confidences(found)["mean"]


def answer(c: Column, schema: str) -> Column:
    """A model's answer as a struct: the JSON object in it, fenced or not; lines of `key: value` where there is none."""
    body = F.regexp_replace(c, "(?s)^.*?```(?:json)?|```.*$", "")
    given = F.from_json(F.regexp_extract(F.coalesce(body, c), "(?s)(\\{.*\\})", 1), schema)
    pairs = F.transform(F.regexp_extract_all(c, F.lit("(?m)^\\s*([a-z_]+)\\s*:\\s*(.+?)\\s*$"), F.lit(0)), lambda line: F.split(line, ":", 2))
    plain = F.from_json(F.to_json(F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(p[1]).alias("v"))))), schema)
    return F.when(c.rlike("(?s)\\{.*\\}"), given).otherwise(plain)


def pages_phrase(pages: Column) -> Column:
    """page 3 / pages 1, 2 and 5 / the file."""
    n = F.size(pages)
    head = F.array_join(F.slice(pages, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "the file").when(n == 1, F.concat(F.lit("page "), pages[0].cast("string"))).otherwise(F.concat(F.lit("pages "), head, F.lit(" and "), F.element_at(pages, -1).cast("string")))


def rendered(template: Column, values: Column) -> Column:
    """A template with {name} places filled from a map; places without a value are emptied."""
    filled = F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    return F.regexp_replace(filled, "\\{[a-z_]+\\}", "")


def checklist_status(found: Column, readable: Column, sure: Column, applies: Column) -> Column:
    """Struct (status, grade): NOT_APPLICABLE, FOUND, FOUND_UNREADABLE, REVIEW or MISSING, and high, medium or low."""
    status = F.when(~F.coalesce(applies, F.lit(True)), "NOT_APPLICABLE").when((found > 0) & (sure > 0), "FOUND").when((found > 0) & (readable == 0), "FOUND_UNREADABLE").when(found > 0, "REVIEW").otherwise("MISSING")
    return F.struct(status.alias("status"), F.when(status == "MISSING", "high").when(status.isin("REVIEW", "FOUND_UNREADABLE"), "medium").otherwise("low").alias("grade"))


def block_value(body: Column, label: str, pattern: str, lines: int = 6, stops: str = "signature|date|place") -> Column:
    """The only match of a pattern in the lines after a label, up to a stop label; null for none or several."""
    rows = F.split(body, "\n")
    at = F.array_position(F.transform(rows, lambda x: F.contains(F.lower(x), F.lit(label.lower()))), True)
    after = F.slice(rows, F.greatest(at, F.lit(1)).cast("int"), lines + 1)
    stop = F.array_position(F.transform(F.slice(after, 2, lines), lambda x: F.lower(F.trim(x)).rlike(f"^(?:{stops})")), True)
    block = F.when(stop > 0, F.slice(after, F.lit(1), stop.cast("int"))).otherwise(after)
    found = F.array_distinct(F.regexp_extract_all(F.array_join(block, "\n"), F.lit(f"({pattern})"), F.lit(1)))
    return F.when((at > 0) & (F.size(found) == 1), found[0])


def safe_name(c: Column) -> Column:
    """A file name without what folders and shells take amiss."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[_]+$", "")


def debtor(body: Column) -> Column:
    """Struct (debtor_based, name, pan) of a registry search page."""
    low = F.lower(body)
    name = F.nullif(F.trim(F.regexp_extract(body, "(?i)debtor name[ ]*[:-]?[ ]*([^\\n]+)", 1)), F.lit(""))
    pan = F.nullif(F.regexp_extract(F.upper(body), f"PAN[ ]*[:-]?[ ]*({text.PAN})", 1), F.lit(""))
    return F.struct((F.contains(low, F.lit("debtor based search")) | F.contains(low, F.lit("search criteria: debtor"))).alias("debtor_based"), name.alias("name"), pan.alias("pan"))
