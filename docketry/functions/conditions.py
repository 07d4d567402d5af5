"""A condition language over columns: nested lists and dicts to a three-valued Column.

A condition is {"all": [...]}, {"any": [...]}, {"not": ...} or {"field": name,
"op": value} with op one of eq, ne, in, not_in, gt, ge, lt, le, ge_field,
gt_field, le_field, lt_field, truthy, falsy. A null field makes it unknown (null).
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le}


def condition(rule: dict) -> Column:
    if "all" in rule:
        return functools.reduce(operator.and_, [condition(r) for r in rule["all"]], F.lit(True))
    if "any" in rule:
        return functools.reduce(operator.or_, [condition(r) for r in rule["any"]], F.lit(False))
    if "not" in rule:
        return ~condition(rule["not"])
    field = F.coalesce(*[F.col(f) for f in rule["coalesce"]]) if "coalesce" in rule else F.col(rule["field"])
    ((op, value),) = [(k, v) for k, v in rule.items() if k not in ("field", "coalesce")]
    if op in _BINARY:
        return _BINARY[op](field, F.lit(value))
    if op.endswith("_field"):
        return _BINARY[op[:2]](field, F.col(value))
    if op == "in":
        return field.isin(value)
    if op == "not_in":
        return ~field.isin(value)
    if op in ("truthy", "falsy"):
        low = F.lower(field.cast("string"))
        known = F.when(low.isin("true", "yes", "y", "1"), True).when(low.isin("false", "no", "n", "0"), False)
        return known if op == "truthy" else ~known
    raise ValueError(f"no such operator: {op}")
