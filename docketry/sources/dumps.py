"""Balanced sections of dumps that are not JSON as a whole, all of a text at once.

A text is read once, from bracket to bracket; quoted strings (escapes observed) are
skipped. An opening bracket is closed by the next one of its kind at its level. Braces and
square brackets are counted apart, so one kind that does not close spoils nothing of
the other; a section that does not close is left out. Nothing is sorted or sent
between tasks: a task holds a batch of texts and the brackets of one text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A quoted string (to the end where it does not close) or a bracket.
_MARK = re.compile(r'"(?:[^"\\]++|\\.)*+(?:"|\\?\Z)|[{}\[\]]', re.S)
_KIND = {"{": "{", "}": "{", "[": "[", "]": "["}
#: Rows and characters of one batch that is handed on.
_ROWS, _CHARS = 10_000, 8 << 20


def _balanced(body: str) -> list[list]:
    """[name, kind, begin, length, braces, squares, array] of each balanced section, as they begin."""
    every, opened, count, quoted = [], {"{": [], "[": []}, {"{": 0, "[": 0}, None
    for m in _MARK.finditer(body):
        at = m.start()
        c = body[at]
        if c == '"':
            quoted = m
            continue
        kind = _KIND[c]
        if c == kind:
            named = quoted is not None and body[quoted.end() : at].strip(" \n\r\t") == ":"
            one = [body[quoted.start() + 1 : quoted.end() - 1] if named else None, kind, at + 1, None, count["{"], count["["], opened["["][-1][2] if opened["["] else None]
            every.append(one)
            opened[kind].append(one)
            count[kind] += 1
        else:
            count[kind] -= 1
            if opened[kind]:
                one = opened[kind].pop()
                one[3] = at + 2 - one[2]
        quoted = None
    return [x for x in every if x[3] is not None]


def _named(body: str) -> Iterator[tuple]:
    """(name, no, kind, begin, text) of each named section and of unnamed objects directly in a named array."""
    found, met = _balanced(body), Counter()
    arrays = {x[2]: x for x in found if x[1] == "[" and x[0] is not None}
    for name, kind, begin, length, braces, _, array in found:
        if name is None and kind == "{" and array in arrays and arrays[array][4] == braces:
            name = arrays[array][0]
        if name is not None:
            met[name, kind] += 1
            yield name, met[name, kind], kind, begin, body[begin - 1 : begin - 1 + length]


def _each(docs: DataFrame, key: str, body: str, of: Callable[[str], Iterator | list], columns: str) -> DataFrame:
    """A row for each of what `of` gives for a text, beside its key."""
    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64()}[t]) for n, t in (c.split(" ") for c in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, out, size = batch.column("_key"), [], [], 0

            def made() -> pa.RecordBatch:
                cells = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(schema), schema, strict=True)]
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *cells], ["_key", *schema.names])

            for i, text in enumerate(batch.column("_body")):
                for row in of(text.as_py() or ""):
                    at.append(i)
                    out.append(row)
                    size += len(row[-1]) if isinstance(row[-1], str) else 0
                    if len(out) >= _ROWS or size >= _CHARS:
                        yield made()
                        at, out, size = [], [], 0
            yield made()

    rows = docs.select(F.col(key).alias("_key"), F.col(body).alias("_body"))
    return rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, {columns}").withColumnRenamed("_key", key)


def brackets(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, name, kind, begin, length, braces, squares, array): every balanced section of each text.

    name is the quoted string with a colon before it, null for none; braces and
    squares are how many of each are open around it; array is where the square
    bracket begins that it stands in, null for none. Null texts have none.
    """
    return _each(docs, key, body, _balanced, "name string, kind string, begin bigint, length bigint, braces bigint, squares bigint, array bigint")


def sections(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, name, no, kind, begin, text): all named sections, of which the no-th of its name in its text, and the unnamed objects that stand directly in a named array under the name of that array."""
    return _each(docs, key, body, _named, "name string, no bigint, kind string, begin bigint, text string")
