"""Trusted values in texts: all values found in one pass, and fields recovered from labelled blocks.

Values are compared as words: lower-case ASCII letters and digits, whatever stands
between. Up to MOST_BYTES of distinct values go to the executors as one automaton of all of
them, which reads each text once; more are joined by their words with the
windows of each text, so what is broadcast never grows with the data.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import compare, text
from docketry.operators import gates

MOST_BYTES = 16 << 20
LEAST = 0.65
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(c: Column) -> Column:
    """Lower-case ASCII words with single spaces between."""
    return F.trim(F.regexp_replace(F.translate(c, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def occurrences(texts: DataFrame, values: DataFrame, key: str, body: str, value: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, value, first_word, times): where each distinct value, in its words, stands in each text; counted from 1, overlaps included.

    Null and blank values and texts are in no row; texts that repeat a key give a row each.
    """
    wanted = values.select(words_of(F.col(value)).alias("value")).where("value <> ''").distinct()
    size = wanted.agg(F.sum(F.octet_length("value") + 16).alias("n")).first()["n"] or 0
    rows = texts.select(F.col(key).alias("_key"), words_of(F.col(body)).alias("_body")).where("_body <> ''")
    found = _by_automaton(rows, wanted) if size <= most_bytes else _by_windows(rows, wanted)
    return found.withColumnRenamed("_key", key)


@functools.lru_cache(maxsize=2)
def _automaton(values: tuple[str, ...]) -> object:
    import ahocorasick

    made = ahocorasick.Automaton()
    for v in values:
        made.add_word(f" {v} ", v)
    made.make_automaton()
    return made


def _by_automaton(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The number of values is bounded by their size in bytes, which was counted before."""
    values = tuple(r["value"] for r in wanted.orderBy("value").collect())
    sent = rows.sparkSession.sparkContext.broadcast(values)
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(sent.value) if sent.value else None
        for batch in batches:
            at, out = [], []
            for i, body in enumerate(batch.column("_body").to_pylist() if machine else []):
                met: dict[str, list[int]] = {}
                line = f" {body} "
                for end, v in machine.iter(line):
                    met.setdefault(v, []).append(end - len(v))
                words = {p: k for k, p in enumerate((j for j, c in enumerate(line) if c == " "), 1)} if met else {}
                for v, places in met.items():
                    at.append(i)
                    out.append((v, words[min(places) - 1], len(places)))
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(at, pa.int64())), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["_key", "value", "first_word", "times"])

    return rows.mapInArrow(run, f"_key {kind}, value string, first_word bigint, times bigint")


def _by_windows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """A join of the windows of each text, of as many words as any value has, with the values."""
    sizes = [r["n"] for r in wanted.select(F.size(F.split("value", " ")).alias("n")).distinct().collect()]  # as many as there are lengths
    words = rows.select(F.monotonically_increasing_id().alias("_row"), "_key", F.split("_body", " ").alias("_w"))

    def windows(n: int) -> Column:
        places = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("_w", i, n), " ").alias("value")))

    starts = F.explode(F.flatten(F.array(*[windows(n) for n in sizes])) if sizes else F.array().cast("array<struct<at: int, value: string>>"))
    each = words.select("_row", "_key", starts.alias("_s")).select("_row", "_key", F.col("_s.at").cast("bigint").alias("at"), "_s.value")
    found = each.join(wanted, "value").groupBy("_row", "_key", "value").agg(F.min("at").alias("first_word"), F.count("*").alias("times"))
    return found.drop("_row")


# -------------------------------------------------------------- labelled fields

#: Label, format and number of lines after the label, by field.
FIELDS = {
    "pan_number": ("(?:permanent\\s+account\\s+number|\\bpan(?:\\s+number|\\s+no\\.?)?\\b)", "\\b[A-Za-z]{5}\\s*[0-9]{4}\\s*[A-Za-z]\\b", 4),
    "phone_number": ("\\b(?:mobile|phone|contact)(?:\\s+number|\\s+no\\.?)?\\b", "(?:\\+?91[ -]?)?[6-9][0-9](?:[ -]?[0-9]){8}", 3),
    "pin_code": ("\\b(?:pin|postal|zip)(?:\\s+code|\\s+number|\\s+no\\.?)?\\b", "\\b[1-8][0-9]{5}\\b", 3),
    "date_of_birth": ("\\b(?:date\\s+of\\s+birth|birth\\s+date|dob)\\b", "\\b(?:[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}|[0-9]{4}[/.-][0-9]{1,2}[/.-][0-9]{1,2})\\b", 8),
}
#: How sure a value is that stands alone after its label.
SURE = 0.98


def _once(c: Column, of: Callable[[Column], Column]) -> Column:
    """What `of` makes of a value that is worked out once a row, though it is used many times."""
    return F.transform(F.array(c), of)[0]


def blocks(body: Column, label: str, lines: int) -> Column:
    """Array of (line, text): what follows each label on its line, and the lines after it."""
    def of(rows: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: F.element_at(rows, i).rlike(f"(?i){label}"))

        def block(i: Column) -> Column:
            own = F.regexp_replace(F.element_at(rows, i), f"(?i)^.*?{label}", "")
            return F.struct(i.alias("line"), F.array_join(F.concat(F.array(own), F.slice(rows, i + 1, lines)), "\n").alias("text"))

        return F.transform(at, block)

    return _once(F.transform(F.split(body, "\r?\n"), lambda x: F.trim(x)), of)


def canonical(field: Column, value: Column) -> Column:
    """The form in which two values of a field are equal, null for none."""
    day = F.date_format(compare.day(F.trim(value)), "yyyy-MM-dd")
    return F.when(field == "date_of_birth", day).when(field == "phone_number", text.phone(value)).otherwise(F.nullif(text.compact(value), F.lit("")))


def resolved(field: str, expected: Column, body: Column) -> Column:
    """Struct (observed, line) of the one value after a label of the field that equals the expected one; null if there is none or if they are written in several ways."""
    label, pattern, lines = FIELDS[field]
    found = F.flatten(F.transform(blocks(body, label, lines), lambda b: F.transform(F.regexp_extract_all(b["text"], F.lit(pattern), F.lit(0)), lambda m: F.struct(F.regexp_replace(F.trim(m), "\\s+", " ").alias("observed"), b["line"].alias("line")))))
    same = F.filter(found, lambda m: F.coalesce(canonical(F.lit(field), m["observed"]) == canonical(F.lit(field), expected), F.lit(False)))
    return _once(same, lambda s: F.when(F.size(F.array_distinct(F.transform(s, lambda m: text.compact(m["observed"])))) == 1, s[0]))


def recovered(pages: DataFrame, trusted: DataFrame, case: list[str], body: str, current: str, fields: tuple[str, ...] = tuple(FIELDS), least: float = LEAST) -> DataFrame:
    """(case, person, page_number, field, observed, line, confidence) of trusted values that a page of the person has after a label, but not among its fields.

    pages: case, person, page_number, document_type, is_readable, ocr_confidence, a
    text and a map of current values. trusted: case, person, field,
    trusted_value. A field is left alone if its value is right, or is
    another's of the case (so that a wrong owner is not hidden), or if two
    people of the case share the trusted value. The confidence is that of
    the text at most; what is recovered passes the gates of any field.
    """
    known = trusted.where(F.col("field").isin(*fields)).withColumn("_k", canonical(F.col("field"), F.col("trusted_value"))).where("_k is not null")
    whose = known.groupBy(*case, "field", "_k").agg(F.min("person").alias("_first"), F.max("person").alias("_last"))
    single = known.join(whose.where("_first = _last").select(*case, "field", "_k"), [*case, "field", "_k"])
    readable = pages.where(F.coalesce(F.col("is_readable"), F.lit(True)) & (F.trim(F.coalesce(F.col(body), F.lit(""))) != ""))
    rows = readable.join(single, [*case, "person"]).withColumn("_now", canonical(F.col("field"), F.try_element_at(F.col(current), F.col("field"))))
    rows = rows.where("_now is null or _now <> _k")
    theirs = whose.select(*case, "field", F.col("_k").alias("_now"), "_first", "_last")
    rows = rows.join(theirs, [*case, "field", "_now"], "left").where("_first is null or (_first = person and _last = person)")
    pick = F.lit(None).cast("struct<observed: string, line: int>")
    for f in fields:
        pick = F.when(F.col("field") == f, resolved(f, F.col("trusted_value"), F.col(body))).otherwise(pick)
    rows = rows.select("*", F.explode(F.array_compact(F.array(pick))).alias("_found"))  # a generator, so that no later test looks for it again
    rows = rows.withColumn("confidence", F.round(F.least(F.lit(SURE), F.coalesce("ocr_confidence", F.lit(1.0))), 3)).where(F.col("confidence") >= least)
    ok = gates.reliable(F.col("document_type"), F.col("field"), F.col("_found.observed"), F.col(body), F.col("confidence"), F.lit(True)) & gates.means_the_same(F.col("document_type"), F.col("field"))
    return rows.where(ok).select(*case, "person", "page_number", "field", "_found.observed", "_found.line", "confidence")
