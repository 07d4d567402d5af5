"""Queries on names and trusted values in texts, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import compare
from docketry.operators import identity, name_join, trusted_values
from docketry.plans import casefile
from docketry.plans.ownership_queries import _distinct, _words
from docketry.sources import dumps, trees
from docketry.sources.tables import load


def similar_person_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of people and names on pages that score 85 or more, as distinct words, with how many rows have each."""
    people = name_join.distinct_names(casefile.people(spark, sf), "applicant_name")
    pages = name_join.distinct_names(casefile.pages(spark, sf), "applicant_name")
    found = name_join.similar(people, pages)
    found = found.join(people.select(F.col("words").alias("u"), F.col("n").alias("people")), "u").join(pages.select(F.col("words").alias("v"), F.col("n").alias("pages")), "v")
    return found.select(F.array_join("u", " ").alias("trusted_name"), F.array_join("v", " ").alias("page_name"), "score", "people", "pages")


def passages_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of the benchmark that stand in documents, word for word: where first, how often, and of how many items."""
    items = load(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", "[.!?]")).alias("sentence"))
    items = items.select("item_id", trusted_values.words_of(F.col("sentence")).alias("value")).where("size(split(value, ' ')) >= 4")
    found = trusted_values.occurrences(load(spark, sf, "documents"), items, "doc_id", "text", "value")
    return found.join(items.groupBy("value").agg(F.countDistinct("item_id").alias("items")), "value").select("doc_id", "value", "first_word", "times", "items")


_O = "o_orderkey"
_S = casefile.PAGES["seen"]
#: What a page says: PAN and phone after their labels, in several ways, or elsewhere, or twice.
_SAYS = f"""concat('Customer copy', chr(10), CASE {_O} % 6 WHEN 0 THEN concat('PAN No. : ', {casefile.pan(_S)}) WHEN 1 THEN concat('Permanent Account Number', chr(10), lower({casefile.pan(_S)}))
    WHEN 2 THEN concat('ref ', {casefile.pan(_S)}) WHEN 3 THEN concat('pan ', {casefile.pan(_S)}, chr(10), 'and ', substr({casefile.pan(_S)}, 1, 5), ' ', substr({casefile.pan(_S)}, 6, 5)) WHEN 4 THEN concat('PAN', chr(10), 'a', chr(10), 'b', chr(10), 'c', chr(10), {casefile.pan(f'{_S} + 1')}) ELSE 'company span' END,
    chr(10), 'x', chr(10), 'y', chr(10), CASE {_O} % 4 WHEN 0 THEN concat('Mobile no +91 ', {casefile.phone(_S)}) WHEN 1 THEN concat('Contact number:', chr(10), substr({casefile.phone(_S)}, 1, 5), ' ', substr({casefile.phone(_S)}, 6, 5)) WHEN 2 THEN {casefile.phone(_S)} ELSE '' END, chr(10), 'end')"""
_KEEP = ("app", "page_number", "subject", "document_type", "is_readable", "ocr_confidence", "pan_number", "phone_number")
_PAGES = {c: casefile.PAGES[c] for c in _KEEP} | {"body": _SAYS}


def recovered_values(spark: SparkSession, sf: str) -> DataFrame:
    """PAN and phone numbers of people recovered from labelled blocks of the pages filed under them."""
    pages = load(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _PAGES.items()]).withColumnRenamed("subject", "person")
    pages = pages.withColumn("fields", F.create_map(F.lit("pan_number"), F.col("pan_number"), F.lit("phone_number"), F.col("phone_number")))
    trusted = casefile.unpivoted(casefile.people(spark, sf), ["app", "person"], ("pan_number", "phone_number"), "trusted_value")
    return trusted_values.recovered(pages, trusted, ["app"], "body", "fields", ("pan_number", "phone_number"))


def linked_people(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a case that are of one person by chains of identifiers, and chains that hold two PANs."""
    pages = casefile.pages(spark, sf).select("app", "page_number", "pan_number", "phone_number", "account_number", "date_of_birth")
    return identity.linked(pages.where("date_of_birth is null or date_of_birth not like 'XX%'"), "page_number", ["app"], ["pan_number", "phone_number", "account_number"], ("pan_number",))


#: A dump of a customer's orders that is no JSON as a whole: stray text and brackets, quotes that hold brackets, an object that does not close.
_ORDER = f"concat('{{\"k\" : ', {casefile.text(_O)}, ', \"note\": \"', o_orderpriority, ' ]}}{{\", \"sum\": {{\"paid\": [', {casefile.text(_O)}, ']}}}}')"
_DETAILS = "concat('{{\"n\": ', CAST({0} AS STRING), '}}')"


def dump_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Named sections, and the objects of named arrays, of a broken dump of each customer's orders."""
    rows = load(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey", f"{_ORDER} AS one")
    texts = rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "one"))), lambda x: x["one"]), " , ").alias("list"))
    body = F.concat(F.lit('} copied ] "details": '), F.expr(_DETAILS.format("o_custkey")), F.lit('\n"orders" :\n['), F.col("list"), F.lit('] end "open": { "x'))
    return dumps.sections(texts.select("o_custkey", body.alias("body")), "o_custkey", "body").select("o_custkey", "name", "no", "kind", "text")


#: An event's properties within up to six levels, each with a confidence of its own and one of a language.
_TREE = """concat(repeat('{"detectedLanguages": [{"confidence": 0.9, "k": 1}], "confidence": 0.25, "in": [', CAST(event_id % 7 AS INT)), coalesce(props, 'null'), repeat(']}', CAST(event_id % 7 AS INT)))"""


def event_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Of each event's tree, without languages: scalars, the longest path, and the mean of all confidences and of all values of k."""
    rows = load(spark, sf, "events").selectExpr("event_id", f"{_TREE} AS body")
    found = trees.leaves(rows, "event_id", "body", ("detectedLanguages",))
    number = F.col("value").try_cast("double")
    return found.groupBy("event_id").agg(F.count("*").alias("scalars"), F.max(F.length("path")).cast("bigint").alias("longest"), F.avg(F.when(F.col("name") == "confidence", number)).alias("confidence"), F.avg(F.when(F.col("name") == "k", number)).alias("k"))


QUERIES = {f.__name__: f for f in (similar_person_names, passages_in_documents, recovered_values, linked_people, dump_parts, event_trees)}

_ASCII = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
_LCS = """list_reduce(list_transform(string_split({0}, ''), lambda c: [unicode(c)]), lambda r, c: list_reduce(list_transform(range(1, length({1}) + 1), lambda j: [j]),
    lambda done, j: list_append(done, CASE WHEN unicode({1}[j[1]::INT]) = c[1] THEN r[j[1]::INT] + 1 ELSE greatest(r[j[1]::INT + 1], done[len(done)]) END), [0]), list_transform(range(0, length({1}) + 1), lambda j: 0))[-1]"""
_SHORTER, _LONGER = "(CASE WHEN len(u) <= len(v) THEN u ELSE v END)", "(CASE WHEN len(u) <= len(v) THEN v ELSE u END)"
_INITIALS = "(len(list_filter({0}, lambda w: length(w) = 1)) BETWEEN 1 AND len({1}) AND list_filter({0}, lambda w: length(w) = 1) = list_transform({1}[1:len(list_filter({0}, lambda w: length(w) = 1))], lambda w: w[1]) AND list_has_all({1}, list_filter({0}, lambda w: length(w) > 1)))"


def _block(label: str, pattern: str, lines: int) -> str:
    """Distinct (letters and digits, as written) after each label."""
    rows = "string_split(body, chr(10))"
    text = f"concat(regexp_replace(({rows})[i::INT], '(?i)^.*?{label}', ''), chr(10), array_to_string(({rows})[i::INT + 1:i::INT + {lines}], chr(10)))"
    at = f"list_filter(range(1, len({rows}) + 1), lambda i: regexp_matches(({rows})[i::INT], '(?i){label}'))"
    return f"list_transform(flatten(list_transform({at}, lambda i: list_transform(regexp_extract_all({text}, '{pattern}'), lambda m: {{'m': regexp_replace(trim(m), '\\s+', ' ', 'g'), 'i': i::INT}}))), lambda x: x)"


_CANON = {"pan_number": "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')", "phone_number": "right(regexp_replace({0}, '[^0-9]', '', 'g'), 10)"}


def _recovered(field: str) -> str:
    label, pattern, lines = trusted_values.FIELDS[field]
    canon = _CANON[field]
    return f"""SELECT p.app, p.person, page_number, '{field}' AS field, t.k AS k, list_filter({_block(label, pattern, lines)}, lambda x: {canon.format("x.m")} = t.k) AS found, ocr_confidence, document_type, body
        FROM p JOIN (SELECT app, min(person) AS person, {canon.format(field)} AS k FROM people GROUP BY app, {canon.format(field)} HAVING count(DISTINCT person) = 1) t ON t.app = p.app AND t.person = p.person
        WHERE is_readable AND (p.{field} IS NULL OR {canon.format("p." + field)} <> t.k)
          AND NOT EXISTS (SELECT 1 FROM people o WHERE o.app = p.app AND {canon.format("o." + field)} = {canon.format("p." + field)} AND o.person <> p.person)"""


_PAN_TYPE = "NOT (field = 'phone_number' AND lower(document_type) IN ('crif report', 'cibil report')) AND (lower(document_type) <> 'pan' OR field <> 'pan_number' OR (regexp_matches(upper(body), '\\b[A-Z]{5}[0-9]{4}[A-Z]\\b') AND regexp_matches(body, '(?i)\\b(?:permanent\\s+account\\s+number|income\\s+tax|govt\\.? of india|pan)\\b')))"
ORACLE_SQL = {
    "similar_person_names": f"""
        WITH {casefile.PEOPLE_SQL}, {casefile.PAGES_SQL}, a AS (SELECT {_distinct("ws")} AS u, sum(c)::BIGINT AS people FROM (SELECT {_words("applicant_name")} AS ws, count(*) AS c FROM people WHERE applicant_name IS NOT NULL GROUP BY 1) GROUP BY 1),
        b AS (SELECT {_distinct("ws")} AS v, sum(c)::BIGINT AS pages FROM (SELECT {_words("applicant_name")} AS ws, count(*) AS c FROM pages WHERE applicant_name IS NOT NULL GROUP BY 1) GROUP BY 1),
        j AS (SELECT *, array_to_string(u, '') AS cu, array_to_string(v, '') AS cv FROM a, b WHERE len(u) > 0 AND len(v) > 0),
        k AS (SELECT *, array_to_string(list_sort(list_filter(u, lambda w: NOT list_contains(v, w))), ' ') AS x, array_to_string(list_sort(list_filter(v, lambda w: NOT list_contains(u, w))), ' ') AS y, length(array_to_string(list_intersect(u, v), ' ')) AS i FROM j),
        s AS (SELECT *, CASE WHEN (len(u) = len(v) AND list_has_all(u, v)) THEN 100.0 WHEN {_SHORTER} = {_LONGER}[1:len({_SHORTER})] THEN 95.0 WHEN {_INITIALS.format(_SHORTER, _LONGER)} OR {_INITIALS.format(_LONGER, _SHORTER)} THEN 95.0
            WHEN cu = cv THEN 100.0 WHEN length(cu) >= 4 AND (contains(cv, cu) OR contains(cu, cv)) THEN 90.0 WHEN i > 0 AND (x = '' OR y = '') THEN 100.0
            ELSE round(100 * greatest(1 - (length(x) + length(y) - 2 * {_LCS.format("x", "y")}) / (2 * i + 2 * (i > 0)::INT + length(x) + length(y))::DOUBLE,
                 CASE WHEN i > 0 THEN 1 - (1 + least(length(x), length(y))) / (2 * i + 1 + least(length(x), length(y)))::DOUBLE ELSE 0 END), 1) END::DOUBLE AS score FROM k)
        SELECT array_to_string(u, ' ') AS trusted_name, array_to_string(v, ' ') AS page_name, score, people, pages FROM s WHERE score >= 85""",
    "passages_in_documents": f"""
        WITH i AS (SELECT item_id, {_ASCII.format("s")} AS value FROM (SELECT item_id, unnest(string_split_regex(text, '[.!?]')) AS s FROM benchmark)),
        v AS (SELECT value, count(DISTINCT item_id) AS items FROM i WHERE len(string_split(value, ' ')) >= 4 GROUP BY 1), d AS (SELECT doc_id, ' ' || {_ASCII.format("text")} || ' ' AS t FROM documents),
        f AS (SELECT doc_id, value, items, t, position(' ' || value || ' ' IN t) AS p FROM d JOIN v ON contains(t, ' ' || value || ' '))
        SELECT doc_id, value, length(t[1:p]) - length(replace(t[1:p], ' ', '')) AS first_word, len(list_filter(range(1, length(t)), lambda j: t[j::INT] = ' ' AND t[j::INT:j::INT + length(value) + 1] = ' ' || value || ' ')) AS times, items FROM f""",
    "recovered_values": f"""
        WITH {casefile.PEOPLE_SQL}, p AS (SELECT {casefile.columns(_PAGES | {"person": _PAGES["subject"]})} FROM orders), r AS ({_recovered("pan_number")} UNION ALL {_recovered("phone_number")}),
        c AS (SELECT *, round(least(0.98::DOUBLE, coalesce(ocr_confidence, 1.0::DOUBLE)), 3) AS confidence FROM r WHERE len(list_distinct(list_transform(found, lambda x: regexp_replace(lower(x.m), '[^a-z0-9]', '', 'g')))) = 1)
        SELECT app, person, page_number, field, found[1].m AS observed, found[1].i AS line, confidence FROM c WHERE confidence >= 0.65 AND {_PAN_TYPE}""",
    "linked_people": f"""
        WITH RECURSIVE {casefile.PAGES_SQL}, k AS (SELECT app, page_number, f || ':' || regexp_replace(lower(v), '[^a-z0-9]', '', 'g') AS id FROM (SELECT app, page_number, unnest(['pan_number', 'phone_number', 'account_number']) AS f, unnest([pan_number, phone_number, account_number]) AS v
            FROM pages WHERE date_of_birth IS NULL OR date_of_birth NOT LIKE 'XX%') WHERE trim(v) <> ''),
        e AS (SELECT DISTINCT a.app, a.id AS u, b.id AS v FROM k a JOIN k b ON a.app = b.app AND a.page_number = b.page_number),
        r AS (SELECT app, u, v FROM e UNION SELECT r.app, r.u, e.v FROM r JOIN e ON r.app = e.app AND r.v = e.u),
        c AS (SELECT app, u AS id, min(v) AS identity, count(DISTINCT CASE WHEN v LIKE 'pan_number:%' THEN v END) > 1 AS conflict FROM r GROUP BY app, u),
        p AS (SELECT DISTINCT k.app, page_number, identity, conflict FROM k JOIN c ON k.app = c.app AND k.id = c.id)
        SELECT *, count(*) OVER (PARTITION BY app, identity) AS records FROM p""",
    "dump_parts": f"""
        WITH o AS (SELECT o_custkey, o_orderkey, {_ORDER} AS one, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS no FROM orders), l AS (SELECT o_custkey, '[' || string_agg(one, ' , ' ORDER BY o_orderkey) || ']' AS text FROM o GROUP BY 1)
        SELECT o_custkey, 'details' AS name, 1 AS no, '{{' AS kind, {_DETAILS.format("o_custkey")} AS text FROM l UNION ALL SELECT o_custkey, 'orders', 1, '[', text FROM l
        UNION ALL SELECT o_custkey, 'orders', no, '{{', one FROM o UNION ALL SELECT o_custkey, 'sum', no, '{{', '{{"paid": [' || o_orderkey || ']}}' FROM o UNION ALL SELECT o_custkey, 'paid', no, '[', '[' || o_orderkey || ']' FROM o""",
    "event_trees": f"""
        WITH e AS (SELECT event_id, {_TREE} AS body FROM events), t AS (SELECT event_id, j.fullkey AS path, j.key AS name, j.atom AS value FROM e, json_tree(e.body) j WHERE j.atom IS NOT NULL AND NOT contains(j.fullkey, 'detectedLanguages'))
        SELECT event_id, count(*) AS scalars, max(length(path)) AS longest, avg(CAST(value AS DOUBLE)) FILTER (name = 'confidence') AS confidence, avg(CAST(value AS DOUBLE)) FILTER (name = 'k') AS k FROM t GROUP BY 1""",
}
