"""Loose inputs: manifests, broken dumps, nested JSON, sheets of cells, and reports out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MANIFEST = "struct<loan_id: string, people: map<string, string>, reference_data: map<string, string>, document_index: array<struct<person_id: string, document_type: string, pages: array<bigint>>>, documents: array<struct<applicant_role: string, person_id: string, document_type: string, pages: array<bigint>>>>"


def manifests(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, loan_id, people, entries) of manifests and of the older shape with reference_data and documents."""
    parsed = rows.select(key, F.from_json(body, MANIFEST).alias("m"))
    old = F.transform("m.documents", lambda d: F.struct(F.coalesce(d["applicant_role"], d["person_id"], F.lit("primary")).alias("person_id"), d["document_type"].alias("document_type"), d["pages"].alias("pages")))
    return parsed.select(key, F.col("m.loan_id").alias("loan_id"), F.map_keys(F.coalesce("m.people", "m.reference_data")).alias("people"), F.coalesce("m.document_index", old).alias("entries"))


def manifest_problems(made: DataFrame, key: str) -> DataFrame:
    """(key, problem, detail): no loan number, a page below 1, an unknown person, a page with two owners."""
    entry = made.select(key, "people", F.explode("entries").alias("e")).select(key, "people", "e.*")
    pages = entry.select(key, "person_id", F.lower(F.trim("document_type")).alias("kind"), F.explode("pages").alias("page"))
    none = made.where(F.coalesce(F.trim("loan_id"), F.lit("")) == "").select(key, F.lit("NO_LOAN_ID").alias("problem"), F.lit("").alias("detail"))
    low = pages.where("page < 1").select(key, F.lit("PAGE_NOT_POSITIVE").alias("problem"), F.col("page").cast("string").alias("detail"))
    unknown = entry.where(~F.array_contains("people", F.col("person_id"))).select(key, F.lit("UNKNOWN_PERSON").alias("problem"), F.col("person_id").alias("detail"))
    owners = pages.groupBy(key, "page").agg(F.countDistinct("person_id", "kind").alias("n")).where("n > 1")
    clash = owners.select(key, F.lit("CONFLICTING_OWNERS").alias("problem"), F.col("page").cast("string").alias("detail"))
    return none.unionAll(low).unionAll(unknown).unionAll(clash).distinct()


def flattened(rows: DataFrame, key: str, body: str, depth: int = 4) -> DataFrame:
    """(key, path, value): scalars of JSON objects under dotted paths, to `depth` levels; deeper objects and arrays stay as text."""
    level = rows.select(key, F.lit("").alias("path"), F.col(body).alias("value"))
    done = None
    for _ in range(depth):
        inner = level.where(F.ltrim("value").startswith("{")).select(key, "path", F.explode(F.from_json("value", "map<string, string>")).alias("_k", "_v"))
        inner = inner.select(key, F.concat_ws(".", F.nullif("path", F.lit("")), "_k").alias("path"), F.col("_v").alias("value"))
        flat = inner.where(F.col("value").isNull() | ~F.ltrim("value").startswith("{"))
        done = flat if done is None else done.unionAll(flat)
        level = inner.where(F.ltrim("value").startswith("{"))
    return done.unionAll(level)


def _section(body: str | None, name: str) -> str | None:
    """The balanced {...} after "name", quotes and escapes observed; null where it does not close."""
    at = -1 if body is None else body.find(f'"{name}"')
    begin = -1 if at < 0 else body.find("{", at)
    if begin < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(begin, len(body)):
        c = body[i]
        if skip:
            skip = False
        elif c == "\\":
            skip = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return body[begin : i + 1]
    return None


def section(body: Column, name: str) -> Column:
    """A named object out of a dump that is not JSON as a whole, for from_json to read."""

    @F.pandas_udf(StringType())
    def cut(column: pd.Series) -> pd.Series:
        return column.map(lambda x: _section(x, name))

    return cut(body)


def compact_cells(cells: DataFrame, sheet: list[str]) -> DataFrame:
    """(sheet, row, line): rows of a sheet's cells (row, col, value) as lines with | between, without empty rows and columns."""
    filled = cells.where(F.coalesce(F.trim("value"), F.lit("")) != "")
    columns = filled.select(*sheet, "col").distinct().groupBy(*sheet).agg(F.sort_array(F.collect_list("col")).alias("_columns"))
    by_row = filled.groupBy(*sheet, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.trim("value").alias("v")))).alias("_m")).join(columns, sheet)
    line = F.array_join(F.transform("_columns", lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(""))), " | ")
    return by_row.select(*sheet, "row", line.alias("line"))


def export_json(rows: DataFrame, key: str, sections: dict[str, list[str]]) -> DataFrame:
    """(key, payload): one JSON object a row, its columns in named sections; empty values are left out."""
    parts = [F.struct(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in columns]).alias(name) for name, columns in sections.items()]
    return rows.select(key, F.to_json(F.struct(F.col(key), *parts)).alias("payload"))


def write_report(findings: DataFrame, path: str, case: str, kind: str = "json") -> None:
    """A folder a case: JSON lines, or CSV with a header; a case written before is replaced."""
    writer = findings.write.mode("overwrite").partitionBy(case).option("partitionOverwriteMode", "dynamic")
    writer.json(path) if kind == "json" else writer.option("header", "true").csv(path)


def append_events(events: DataFrame, path: str, day: str) -> None:
    """Adds events to a log that has a folder a day."""
    events.write.mode("append").partitionBy(day).parquet(path)


def route(pages: DataFrame, confidence: str, kind: str, layout: str, least: float = 0.75) -> DataFrame:
    """pages with the reader that they ask for: none for digital text, structured for tables, vision where a fast reading was poor, else fast."""
    choice = F.when(F.col(kind) == "digital", "digital").when(F.col(layout).isin("table", "form"), "structured").when(F.coalesce(F.col(confidence), F.lit(0.0)) < least, "vision").otherwise("fast")
    return pages.withColumns({"route": choice, "escalated": choice == "vision"})


def snippet(body: Column, size: int = 220) -> Column:
    return F.substring(F.trim(F.regexp_replace(body, "\\s+", " ")), 1, size)
