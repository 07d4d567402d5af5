"""Case files made from the given tables: people from customers, pages and their fields from orders.

Columns are expressions that Spark and the SQL twins read alike, so that both
sides start from the same rows; what is done with them is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources.tables import load

FIRST = "asha ravi meena kiran vijay sunita mohan geeta arjun leela nitin pooja"
LAST = "patel shah mehta joshi desai trivedi bhatt vyas solanki parmar"
TYPES = "PAN|Aadhaar|Bank Statement|Application Form|CIBIL Report|Utility Bill|Passbook|Sanction Letter|Unknown|Cheque|CRIF Report|Loan Agreement"


def word(words: str, n: str, mark: str = " ") -> str:
    """The n-th of some words, counted from 0 and round again."""
    size = len(words.split(mark))
    return f"split_part('{words}', '{mark}', CAST((({n}) % {size} + {size}) % {size} AS INT) + 1)"


def name(k: str) -> str:
    return f"concat({word(FIRST, k)}, ' ', {word(LAST, f'floor(({k}) / 12)')})"


def text(n: str) -> str:
    return f"CAST({n} AS STRING)"


def padded(n: str, size: int, fill: str = "0") -> str:
    return f"lpad({text(n)}, {size}, '{fill}')"


def pan(k: str) -> str:
    return f"concat('ABCPD', {padded(f'({k}) % 10000', 4)}, 'F')"


def born(k: str) -> str:
    return f"concat({text(f'1950 + ({k}) % 50')}, '-', {padded(f'1 + ({k}) % 12', 2)}, '-', {padded(f'1 + ({k}) % 28', 2)})"


def phone(k: str) -> str:
    return text(f"9000000000 + ({k})")


def account(k: str) -> str:
    return padded(k, 12, "1")


def pin(k: str) -> str:
    return text(f"380000 + ({k}) % 60")


def address(k: str) -> str:
    return f"concat('B-', {text(f'100 + ({k}) % 50')}, ' lake road ward ', {text(f'({k}) % 20')}, ' maninagar ahmedabad ', {pin(k)})"


_K, _O = "c_custkey", "o_orderkey"
PEOPLE = {
    "k": _K,
    "app": f"CAST(floor(({_K} - 1) / 4) AS BIGINT)",
    "person": f"concat('p', {text(f'({_K} - 1) % 4')})",
    "role": word("primary coapplicant coapplicant guarantor", f"{_K} + 3"),
    "relationship": f"CASE ({_K} - 1) % 4 WHEN 1 THEN 'wife' WHEN 2 THEN 'son' WHEN 3 THEN 'father' END",
    "applicant_name": name(_K),
    "father_name": name(f"{_K} + 7"),
    "pan_number": pan(_K),
    "phone_number": phone(_K),
    "date_of_birth": born(_K),
    "account_number": account(_K),
    "pin_code": pin(_K),
    "address": address(_K),
    "gender": f"CASE WHEN {_K} % 2 = 0 THEN 'female' ELSE 'male' END",
    "income_earner": f"{_K} % 3 = 0",
}
#: Whose papers a page shows: now and then those of the next person of the case.
_SEEN = f"(CASE WHEN {_O} % 9 = 0 THEN CAST(floor((o_custkey - 1) / 4) AS BIGINT) * 4 + 1 + o_custkey % 4 ELSE o_custkey END)"
PAGES = {
    "page_number": _O,
    "app": "CAST(floor((o_custkey - 1) / 4) AS BIGINT)",
    "subject": f"concat('p', {text('(o_custkey - 1) % 4')})",
    "seen": _SEEN,
    "source_document_id": f"concat('d', {text(f'CAST(floor({_O} / 40) AS BIGINT)')})",
    "document_type": word(TYPES, f"floor({_O} / 3)", "|"),
    "triage": f"CASE WHEN {_O} % 23 = 0 THEN 'photo' WHEN {_O} % 29 = 0 THEN 'blank' ELSE 'printed' END",
    "page_type": f"CASE WHEN {_O} % 3 = 0 THEN 'digital' ELSE 'scanned' END",
    "is_readable": f"{_O} % 31 <> 0",
    "ocr_confidence": f"CASE WHEN {_O} % 3 <> 0 THEN CAST({_O} * 13 % 100 AS DOUBLE) / 100 END",
    "classification_confidence": f"CAST({_O} * 7 % 100 AS DOUBLE) / 100",
    "detection_method": f"CASE WHEN {_O} % 11 = 0 THEN 'inherited' ELSE 'detected' END",
    "applicant_name": f"CASE WHEN {_O} % 4 = 0 THEN NULL WHEN {_O} % 7 = 0 THEN 'Name' WHEN {_O} % 5 = 0 THEN concat({word(LAST, f'floor({_SEEN} / 12)')}, ' ', {word(FIRST, _SEEN)}) WHEN {_O} % 13 = 0 THEN concat('Mr. ', {name(_SEEN)}, ' ', {word(FIRST, f'{_SEEN} + 7')}) ELSE {name(_SEEN)} END",
    "pan_number": f"CASE WHEN {_O} % 3 = 0 THEN {pan(_SEEN)} END",
    "phone_number": f"CASE WHEN {_O} % 6 = 1 THEN {phone(_SEEN)} END",
    "date_of_birth": f"CASE WHEN {_O} % 5 = 1 THEN {born(_SEEN)} WHEN {_O} % 5 = 2 THEN 'XX/XX/1980' END",
    "account_number": f"CASE WHEN {_O} % 8 = 3 THEN concat('XXXXXXXX', substr({account(_SEEN)}, 9, 4)) WHEN {_O} % 8 = 5 THEN {account(_SEEN)} END",
    "pin_code": f"CASE WHEN {_O} % 10 = 4 THEN {pin(_SEEN)} WHEN {_O} % 10 = 5 THEN '012345' END",
    "address": f"CASE WHEN {_O} % 12 = 2 THEN {address(_SEEN)} WHEN {_O} % 12 = 3 THEN 'District/City' WHEN {_O} % 12 = 4 THEN concat('lake road ward ', {text(f'{_SEEN} % 20')}, ' maninagar') END",
    "credit_score": f"CASE WHEN {_O} % 14 = 1 THEN {text(f'250 + {_O} % 700')} WHEN {_O} % 14 = 2 THEN '(0)' END",
}
#: Fields of a page that are compared with trusted values.
FIELDS = ("applicant_name", "pan_number", "phone_number", "date_of_birth", "account_number", "pin_code", "address", "credit_score")
#: Fields that people have too.
TRUSTED = FIELDS[:-1]


def people(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").selectExpr(*[f"{e} AS {n}" for n, e in PEOPLE.items()])


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in PAGES.items()])


def unpivoted(rows: DataFrame, keep: list[str], fields: tuple[str, ...], value: str = "value") -> DataFrame:
    """A row for each row and field that is not null."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(value)) for f in fields]))
    return rows.select(*keep, cells.alias("_c")).select(*keep, "_c.*").where(F.col(value).isNotNull())


def columns(made: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in made.items())


PEOPLE_SQL = f"people AS (SELECT {columns(PEOPLE)} FROM customer)"
PAGES_SQL = f"pages AS (SELECT {columns(PAGES)} FROM orders)"


def unpivoted_sql(table: str, source: str, keep: list[str], fields: tuple[str, ...], value: str = "value") -> str:
    inner = f"SELECT {', '.join(keep)}, unnest([{', '.join(repr(f) for f in fields)}]) AS field, unnest([{', '.join(f'CAST({f} AS VARCHAR)' for f in fields)}]) AS {value} FROM {source}"
    return f"{table} AS (SELECT * FROM ({inner}) WHERE {value} IS NOT NULL)"
