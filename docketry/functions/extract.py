"""Fields of documents by type: labels and patterns, as one map column picked by the document's type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions import text

_DATE = "([0-9]{1,2}[-/. ](?:[0-9]{1,2}|[A-Za-z]{3,9})[-/. ][0-9]{2,4})"
_MONEY = "(?:rs[.]?|inr|₹)?[ ]*([0-9][0-9,]*(?:[.][0-9]{1,2})?)"
_NUMBER = "([0-9][0-9 -]{7,20}[0-9])"
_WORDS = "([^\\n:]{2,80})"


def _after(label: str, value: str) -> str:
    """A label, then its value on the line or on the next."""
    return f"(?i)(?:{label})[ ]*[:\\-]?[ ]*\\n?[ ]*{value}"


#: Fields of each type of document, as patterns with one group.
FIELDS: dict[str, dict[str, str]] = {
    "credit_assessment": {"applicant_name": _after("applicant name|name of applicant", _WORDS), "loan_amount": _after("loan amount", _MONEY), "tenure": _after("tenure", "([0-9]{1,3})"), "roi": _after("roi|rate of interest", "([0-9]{1,2}(?:[.][0-9]{1,2})?)")},
    "sanction_letter": {"sanction_date": _after("date|dated", _DATE), "sanctioned_amount": _after("sanctioned amount|loan amount", _MONEY), "emi": _after("emi", _MONEY), "roi": _after("rate of interest|roi", "([0-9]{1,2}(?:[.][0-9]{1,2})?)")},
    "loan_agreement": {"agreement_date": _after("agreement date|dated", _DATE), "borrower": _after("borrower", _WORDS), "loan_amount": _after("loan amount|facility amount", _MONEY)},
    "end_use": {"purpose": _after("purpose|end use", _WORDS)},
    "pan_card": {"pan_number": f"\\b({text.PAN})\\b", "name": _after("name", _WORDS), "date_of_birth": _after("date of birth|dob", _DATE)},
    "aadhaar": {"aadhaar_number": "\\b((?:[0-9X]{4}[ -]?){2}[0-9]{4})\\b", "date_of_birth": _after("dob|date of birth|year of birth", "([0-9/.-]{4,10})"), "gender": "(?i)\\b(male|female|transgender)\\b", "pin_code": f"\\b({text.PIN_CODE})\\b"},
    "application_form": {"applicant_name": _after("applicant name|full name", _WORDS), "mobile": _after("mobile(?: no)?|phone", "([+0-9][0-9 -]{8,15})"), "email": f"({text.EMAIL})", "pin_code": f"\\b({text.PIN_CODE})\\b"},
    "utility_bill": {"consumer_number": _after("consumer (?:no|number)|ca no", "([0-9A-Z]{6,16})"), "bill_date": _after("bill date", _DATE), "amount": _after("amount payable|total amount|net amount", _MONEY)},
    "voter_id": {"epic_number": "\\b([A-Z]{3}[0-9]{7})\\b", "name": _after("elector'?s? name|name", _WORDS)},
    "driving_licence": {"licence_number": "\\b([A-Z]{2}[- ]?[0-9]{2}[ -]?[0-9]{4}[0-9]{7})\\b", "valid_till": _after("valid (?:till|upto)|validity", _DATE)},
    "cersai": {"asset_id": _after("asset id", "([0-9]{6,15})"), "search_date": _after("search date|report date", _DATE)},
    "post_dated_cheques": {"cheque_numbers": _after("cheque (?:no|number)s?", "([0-9, ]{6,80})")},
    "bureau_report": {"score": _after("score|cibil score", "([0-9]{3}|-1|0)\\b"), "report_date": _after("report date|date", _DATE), "name": _after("name", _WORDS)},
    "bank_statement": {"account_holder": _after("account (?:holder|name)", _WORDS), "account_number": _after("account (?:no|number)[.]?", _NUMBER), "ifsc": f"\\b({text.IFSC})\\b", "from_date": _after("from|period", _DATE), "to_date": _after("\\bto", _DATE)},
    "passbook": {"account_number": _after("account (?:no|number)|a/c no", _NUMBER), "ifsc": f"\\b({text.IFSC})\\b", "customer_name": _after("name", _WORDS)},
    "cheque": {"cheque_number": "⑆?\\b([0-9]{6})\\b", "ifsc": f"\\b({text.IFSC})\\b", "account_number": _after("a/c no|account no", _NUMBER)},
    "salary_slip": {"employee_name": _after("employee name|name", _WORDS), "net_pay": _after("net (?:pay|salary)", _MONEY), "month": _after("month|pay period", "([A-Za-z]{3,9}[ -]?[0-9]{2,4})")},
    "stamp_duty": {"certificate_number": _after("certificate no", "([A-Z0-9-]{8,30})"), "amount": _after("stamp duty (?:amount|paid)", _MONEY), "issue_date": _after("issued? date", _DATE)},
    "insurance_form": {"policy_number": _after("policy (?:no|number)", "([A-Z0-9/-]{6,30})"), "nominee": _after("nominee(?: name)?", _WORDS), "sum_assured": _after("sum (?:assured|insured)", _MONEY)},
    "clearance": {"status": "(?i)\\b(positive|negative|clear|refer)\\b", "report_date": _after("report date|date", _DATE)},
    "mandate": {"umrn": "\\b([A-Z]{4}[0-9]{16})\\b", "account_number": _after("account (?:no|number)", _NUMBER), "amount": _after("amount", _MONEY)},
}


def fields_of(kind: Column, body: Column) -> Column:
    """Map of field to value for the document's type; fields that are not found are left out."""
    out = F.create_map().cast("map<string,string>")
    for name, patterns in FIELDS.items():
        pairs = F.create_map(*[x for field, p in patterns.items() for x in (F.lit(field), F.nullif(F.trim(F.regexp_extract(body, p, 1)), F.lit("")))])
        out = F.when(kind == name, F.map_filter(pairs, lambda _, v: v.isNotNull())).otherwise(out)
    return out


def until_stop(rows: Column, stops: list[str]) -> Column:
    """Lines up to the first that starts with a stop label (any case)."""
    at = F.array_position(F.transform(rows, lambda x: F.exists(F.array(*[F.lit(s.lower()) for s in stops]), lambda s: F.startswith(F.lower(F.trim(x)), s))), True)
    return F.when(at > 0, F.slice(rows, F.lit(1), (at - 1).cast("int"))).otherwise(rows)


def public_fields(fields: Column) -> Column:
    """Entries whose key has no leading underscore."""
    return F.map_filter(fields, lambda k, _: ~F.startswith(k, F.lit("_")))


def merged_fields(first: Column, second: Column) -> Column:
    """Both maps; the second's value where both have a key."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))), F.map_entries(second)))


def failure_kind(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.rlike("time[d]? ?out"), "TIMEOUT").when(low.rlike("quota|rate limit|429"), "QUOTA").when(low.rlike("memory|oom"), "MEMORY").when(low.rlike("corrupt|invalid|cannot open|unsupported"), "BAD_INPUT").otherwise("OTHER")


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), "[^A-Za-z0-9._-]+", "_")


def stem(name: Column) -> Column:
    """Lower-case name without folder, manifest mark and extension, to join files with their sidecars."""
    return F.regexp_replace(F.lower(F.element_at(F.split(name, "/"), -1)), "([.]manifest[.]json|[.][a-z0-9]{1,5})$", "")
