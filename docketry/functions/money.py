"""Column functions on amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_amount(c: Column) -> Column:
    """Rupee marks and commas dropped; lakh is 100,000 and crore 10,000,000."""
    number = F.regexp_extract(F.regexp_replace(c, ",", ""), "([0-9]+(?:[.][0-9]+)?)", 1).try_cast("decimal(24,6)")
    unit = F.when(F.lower(c).rlike("lakh|\\blac"), 100000).when(F.lower(c).rlike("crore|\\bcr\\b"), 10000000).otherwise(1)
    return (number * unit).cast("double")


def within_relative(a: Column, b: Column, share: float = 0.01) -> Column:
    """a differs from the trusted b by at most the share of b."""
    return F.abs(a - b) <= share * F.abs(b)


def within_money(a: Column, b: Column) -> Column:
    """At most the larger of 1 and one ten-thousandth."""
    return F.abs(a - b) <= F.greatest(F.lit(1.0), F.abs(b) * 1e-4)


def duty(kind: Column, base: Column, amount: Column, rate: Column, least: Column, most: Column, rounding: str = "half_up") -> Column:
    """Flat amount, or percentage of base; clamped, rounded half up (or "ceil") to whole units."""
    raw = F.when(kind == "flat", amount.cast("decimal(18,4)")).otherwise(base.cast("decimal(18,4)") * rate.cast("decimal(8,4)") / 100)
    raw = F.greatest(raw, F.coalesce(least.cast("decimal(18,4)"), raw))
    raw = F.least(raw, F.coalesce(most.cast("decimal(18,4)"), raw))
    return (F.ceil(raw) if rounding == "ceil" else F.round(raw, 0)).cast("double")


def duty_status(paid: Column, owed: Column, rules: Column) -> Column:
    """NO_RULE or AMBIGUOUS where not exactly one rule is in force, else UNDERPAID, OVERPAID, COMPLIANT or UNKNOWN."""
    return (
        F.when(rules == 0, "NO_RULE").when(rules > 1, "AMBIGUOUS").when(paid.isNull() | owed.isNull(), "UNKNOWN")
        .when(paid < owed, "UNDERPAID").when(paid > owed, "OVERPAID").otherwise("COMPLIANT")
    )


def amount_text(c: Column) -> Column:
    """An amount as digits: whole, or with two decimals."""
    value = parsed_amount(c)
    return F.when(value == F.floor(value), value.cast("decimal(24,0)").cast("string")).when(value.isNotNull(), F.format_string("%.2f", value))


def tenure_months(c: Column) -> Column:
    """Months out of `n years` or `n months` near the word tenure or term."""
    number = F.regexp_extract(c, "(?i)(?:tenure|term|period)[^0-9]{0,30}([0-9]{1,3}) *(?:years?|yrs?|months?|mths?)", 1).try_cast("int")
    years = c.rlike("(?i)(?:tenure|term|period)[^0-9]{0,30}[0-9]{1,3} *(?:years?|yrs?)")
    return F.when(years, number * 12).otherwise(number)


def rate_percent(c: Column, label: str = "rate of interest|roi|apr") -> Column:
    """The percentage after a label; "Apr" of a date is no label."""
    found = F.regexp_extract(F.regexp_replace(c, "(?i)\\bapr(?:il)?[ ,-]+[0-9]{1,4}\\b(?! *%)", " "), f"(?i)\\b(?:{label})\\b[^0-9]{{0,20}}([0-9]{{1,2}}(?:[.][0-9]+)?) *%", 1)
    return found.try_cast("double")


#: Dollars a million tokens in and out, by the beginning of a model's name; the last is for the rest. An example table: give your own.
PRICES = (("large-", 5.0, 15.0), ("small-", 0.5, 1.5), ("", 1.0, 3.0))


def model_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: tuple[tuple[str, float, float], ...] = PRICES) -> Column:
    """Cost of a call by the longest matching beginning of the model's name."""
    out = None
    for prefix, a, b in sorted(prices, key=lambda p: -len(p[0])):
        cost = F.round((F.coalesce(tokens_in, F.lit(0)) * a + F.coalesce(tokens_out, F.lit(0)) * b) / 1e6, 6)
        out = F.when(model.startswith(prefix), cost) if out is None else out.when(model.startswith(prefix), cost)
    return out


def free_tier(units: Column, free: int, price_per_thousand: float) -> tuple[Column, Column]:
    """(billable units, cost)."""
    billable = F.greatest(units - free, F.lit(0))
    return billable, F.round(billable * price_per_thousand / 1000, 6)
