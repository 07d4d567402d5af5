"""Gates before a field is compared: may the page carry it, is the value one at all, is it reliable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import compare, identifiers, people, text

#: What a page must be to count.
LEAST_OCR, LEAST_TYPE = 0.55, 0.5
NOT_PAPERS = ("photo", "blank", "unreadable")
INHERITED_OK = ("bank statement", "income tax return", "itr", "passbook", "cibil report", "crif report", "application form", "loan agreement", "facility agreement")
IDENTITY_TYPES = ("aadhaar", "pan", "pan card", "voter id", "driving license", "passport", "ration card")
IDENTITY_FIELDS = ("applicant_name", "pan_number", "aadhaar_number", "date_of_birth")
#: Fields that mean something else in a kind of document.
OTHER_MEANING = {
    "crif report": ("branch", "apr", "roi", "sanction_amount", "loan_amount", "processing_fee", "phone_number", "bank_linked_mobile"),
    "cibil report": ("branch", "apr", "roi", "sanction_amount", "loan_amount", "processing_fee", "phone_number", "bank_linked_mobile"),
    "cersai report": ("date_of_birth", "dob", "phone_number"),
    "technical report": ("phone_number", "email", "branch"),
    "bank statement": ("application_number", "branch", "loan_amount", "sanction_amount", "requested_amount", "recommended_amount"),
    "passbook": ("branch", "loan_amount", "sanction_amount", "requested_amount", "recommended_amount"),
    "cheque": ("branch", "loan_amount", "sanction_amount", "requested_amount", "recommended_amount"),
    "utility bill": ("loan_amount", "sanction_amount", "requested_amount", "recommended_amount"),
}
#: Words of labels that stand where a value should.
LABELS = ("name", "address", "date of birth", "dob", "father name", "signature", "applicant name", "null", "none", "na", "n a", "landmark", "district city", "locality")


def eligible(allowed: Column, triage: str = "triage", readable: str = "is_readable", ocr: str = "ocr_confidence", kind: str = "page_type", document: str = "document_type", confidence: str = "classification_confidence", method: str = "detection_method") -> Column:
    """Whether a page may carry a field; allowed is the array of lower-case types that may, null for any.

    No photo, blank or unreadable page; text of measured quality, or digital; a
    type of the list, of enough confidence; an inherited type counts for papers
    of several pages only, never for identity papers.
    """
    paper = ~F.coalesce(F.col(triage), F.lit("")).isin(*NOT_PAPERS) & F.coalesce(F.col(readable), F.lit(True))
    legible = F.when(F.col(ocr).isNull(), F.lower(F.col(kind)) == "digital").otherwise(F.col(ocr) >= LEAST_OCR)
    doc = F.lower(F.trim(F.col(document)))
    typed = F.when(F.col(method).isin("inherited", "sandwich_smoothed", "run_forward_smoothed"), doc.isin(*INHERITED_OK)).otherwise(F.coalesce(F.col(confidence) >= LEAST_TYPE, F.lit(True)))
    return F.coalesce(paper & legible & (allowed.isNull() | (F.array_contains(allowed, doc) & typed)), F.lit(False))


def means_the_same(document: Column, field: Column) -> Column:
    """False where the field's label means something else in that document."""
    table = F.create_map(*[x for doc, fields in OTHER_MEANING.items() for x in (F.lit(doc), F.array(*[F.lit(f) for f in fields]))])
    return ~F.coalesce(F.array_contains(F.try_element_at(table, F.lower(F.trim(document))), field), F.lit(False))


def suspicious(field: Column, value: Column) -> Column:
    """A label or a non-name where a value should stand."""
    norm = text.normalised(value)
    no_name = field.isin(*compare.NAMES) & people.name_reject_reason(value).isNotNull()
    no_place = field.isin(*compare.ADDRESSES) & norm.rlike("^(?:landmark|locality|city|district|pin ?code| )+$")
    return F.coalesce((norm != "") & (norm.isin(*LABELS) | no_name | no_place), F.lit(False))


def garbage(field: Column, value: Column) -> Column:
    """Values that no comparison should see, by field."""
    v = F.trim(F.coalesce(value, F.lit("")))
    name = field.isin(*compare.NAMES, "father_name", "mother_name")
    bad_name = text.compact(v).isin("coso", "soco", "wo", "so", "co", "do", "null", "none", "name") | ((F.length(F.regexp_replace(v, "[^a-zA-Z]", "")) < 3) & ~v.rlike("[ऀ-ॿ]{3,}")) | v.rlike("(?i)[<>{}=]|xmlns|http")
    bad_date = v.rlike("(?i)\\bxx\\b|xxxx") | ~v.rlike("[0-9]")
    bad_place = (F.length(F.regexp_replace(v, "[^a-zA-Zऀ-ॿ]", "")) < 6) | v.rlike("(?i)^(?:landmark|locality|city|district|pin *code|/)+$") | v.rlike("(?i)\\b(?:website|helpline|gst *(?:no|number)|unique +identification +authority)\\b|www\\.|[^\\s]+@[^\\s]+")
    bad_pin = ~text.digits(v).rlike(f"^{text.PIN_CODE}$")
    bad_score = ~F.regexp_replace(v, "[ '\"()\\[\\]]", "").rlike("^(?:0|[3-9][0-9]{2})$")
    return (
        F.when(v == "", True)
        .when(suspicious(field, v), True)
        .when(name, bad_name)
        .when(field.isin(*compare.DATES), bad_date)
        .when(field.isin(*compare.ADDRESSES), bad_place)
        .when(field == "pin_code", bad_pin)
        .when(field.isin("credit_score", "cibil_score", "crif_score"), bad_score)
        .otherwise(False)
    )


def anchored(document: Column, field: Column, body: Column) -> Column:
    """Whether the page's text shows what the document must show for that field to be its own."""
    doc = F.lower(F.trim(document))
    banking = field.isin("applicant_name", "account_number", "ifsc", "account_holder_name")
    pan = F.upper(body).rlike(f"\\b{text.PAN}\\b") & body.rlike("(?i)\\b(?:permanent\\s+account\\s+number|income\\s+tax|govt\\.? of india|pan)\\b")
    return (
        F.when(doc.isin("pan", "pan card") & field.isin("applicant_name", "date_of_birth", "pan_number"), pan)
        .when((doc == "bank statement") & banking, body.rlike("(?i)\\b(?:statement of account|account statement|opening balance|closing balance|withdrawal|deposit)\\b"))
        .when((doc == "passbook") & banking, body.rlike("(?i)\\b(?:passbook|savings bank)\\b"))
        .when((doc == "cheque") & banking, body.rlike("(?i)\\b(?:cheque|or bearer|a/c payee|ifsc|ifs code)\\b"))
        .when(doc.isin("crif report", "cibil report") & field.isin("credit_score", "cibil_score", "crif_score", "applicant_name"), body.rlike("(?i)\\b(?:cibil|crif|credit information|credit report)\\b"))
        .otherwise(True)
    )


def reliable(document: Column, field: Column, value: Column, body: Column, field_confidence: Column, identity_ok: Column) -> Column:
    """Whether a field is safe to compare: a value, a name if it should be one, an anchor, and enough confidence (0.65 for identity, else 0.6; unknown passes)."""
    least = F.when(field.isin(*IDENTITY_FIELDS), 0.65).otherwise(0.6)
    named = ~field.isin("applicant_name") | people.name_reject_reason(value).isNull()
    own = ~field.isin(*IDENTITY_FIELDS) | F.coalesce(identity_ok, F.lit(True))
    labelled = ~((F.lower(document) == "application form") & (field == "aadhaar_number")) | body.rlike("(?i)aadhaar")
    return ~compare.blank(value) & named & own & labelled & anchored(document, field, body) & F.coalesce(field_confidence >= least, F.lit(True))


def without_suspicious(fields: Column) -> Column:
    """Struct (fields, changes): the map with suspicious values set to null, and what they were."""
    bad = F.map_filter(fields, lambda k, v: suspicious(k, v))
    return F.struct(F.transform_values(fields, lambda k, v: F.when(~suspicious(k, v), v)).alias("fields"), bad.alias("changes"))


def candidate(document: Column, wanted: str, others: tuple[str, ...] = ()) -> Column:
    """The page's type is the wanted one, or one that may stand for it."""
    return F.coalesce(document.isin(wanted, *others), F.lit(False))


def confident_match(document: Column, wanted: str, readable: Column, status: Column, confidence: Column, ocr: Column, body: Column, least: float = 0.65) -> Column:
    """A page that can by itself satisfy the demand for a document."""
    legible = F.coalesce(readable, F.lit(True)) & ~F.coalesce(F.lower(status).isin("failed", "no_text_extracted"), F.lit(False))
    sure = F.coalesce(confidence >= least, F.lit(True)) & F.coalesce(ocr >= LEAST_OCR, F.lit(True))
    return F.coalesce(candidate(document, wanted) & legible & sure & anchored(document, F.lit("applicant_name"), body), F.lit(False))


def identifier_reasons(value: Column) -> Column:
    """Kinds of identifiers that a value has the format of, sorted."""
    kinds = [F.when(identifiers.valid(k, value), F.lit(k)) for k in sorted(identifiers.FORMATS)]
    return F.array_compact(F.array(F.when(identifiers.aadhaar(value).isNotNull(), F.lit("aadhaar")), *kinds))
