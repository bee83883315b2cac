"""Column expressions shared by the analyses.

The dashboard's dataframe library and Spark disagree on a few null rules;
these helpers state the dashboard's rule once, in built-in Spark functions
(no Python UDFs, so every expression stays inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscope.sources import schemas as S

# Column carrying payment multiplicity on the weighted enriched frame.
WEIGHT = "payment_weight"

def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distinct_with_null(c) -> Column:
    """Exact distinct count that counts null as one value.

    Spark's ``count_distinct`` skips nulls; adding a 0/1 null flag restores
    the dashboard's count.  Only one distinct column per aggregate keeps
    Catalyst on the single-distinct plan (partial aggregation on
    key + value, so a hot key is spread before the final shuffle).
    """
    c = _col(c)
    return F.count_distinct(c) + F.max(c.isNull().cast("long"))


def zero_sum(c) -> Column:
    """Sum of doubles where an all-null or empty group gives 0.0, not null."""
    return F.coalesce(F.sum(_col(c)), F.lit(0.0))


def wsum(c, weight: str = WEIGHT) -> Column:
    """Sum over rows repeated ``weight`` times (payment fan-out), 0.0 if none."""
    return zero_sum(_col(c) * F.col(weight))


def wmean(c, weight: str = WEIGHT) -> Column:
    """Mean over rows repeated ``weight`` times; nulls skipped, null if none."""
    c = _col(c)
    return F.try_divide(F.sum(c * F.col(weight)), F.sum(F.when(c.isNotNull(), F.col(weight))).cast("double"))


def settled(c, digits: int) -> Column:
    """Round for output or ranking.

    A sum of doubles depends on the order of its terms in its last bits.
    Rounding to some more digits first removes that noise, so a value that
    lies on a rounding tie goes the same way in every run.
    """
    return F.round(F.round(_col(c), digits + 4), digits)


def money(c) -> Column:
    """An amount at cents: sums are compared and ranked at this precision."""
    return settled(c, 2)


def week_label(year="year", week="week") -> Column:
    """``YYYY-Www``: calendar year with ISO week, as the dashboard labels it."""
    return F.concat(_col(year).cast("string"), F.lit("-W"), F.lpad(_col(week).cast("string"), 2, "0"))


def payment_category(c="PAYMENT_TYPE") -> Column:
    """CASH and CHANGE → CASH; CREDIT and DEBIT → CREDIT; else OTHER."""
    c = _col(c)
    return (
        F.when(c.isin("CASH", "CHANGE"), F.lit("CASH"))
        .when(c.isin("CREDIT", "DEBIT"), F.lit("CREDIT"))
        .otherwise(F.lit("OTHER"))
    )


def payment_group(c="PAYMENT_TYPE") -> Column:
    """CASH → CASH; CREDIT and DEBIT → CREDIT/DEBIT; else OTHER (P10)."""
    c = _col(c)
    return (
        F.when(c == "CASH", F.lit("CASH"))
        .when(c.isin("CREDIT", "DEBIT"), F.lit("CREDIT/DEBIT"))
        .otherwise(F.lit("OTHER"))
    )


def county_from_city(c="CITY") -> Column:
    """County code of a store's city: 019 when it names FALLS or IDAHO.

    A null city falls to the other county (the dashboard would fail).
    """
    up = F.upper(_col(c))
    return F.when(up.contains("FALLS") | up.contains("IDAHO"), F.lit(S.COUNTY_FALLS)).otherwise(
        F.lit(S.COUNTY_OTHER)
    )


def _no_value(c: str) -> str:
    texts = ", ".join(f"'{x}'" for x in S.CENSUS_EMPTY_CELLS)
    return f"(`{c}` IS NULL OR `{c}` IN ({texts}))"


def census_cell(c: str) -> Column:
    """Census response text → number; null and no-value texts read as 0.0.

    Any other text that is not a number gives null, which marks the whole
    county as failed (see ``cell_ok``).
    """
    return F.expr(f"CASE WHEN {_no_value(c)} THEN 0.0D ELSE try_cast(`{c}` AS DOUBLE) END")


def cell_ok(c: str) -> Column:
    """True when ``census_cell(c)`` is a number."""
    return F.expr(f"{_no_value(c)} OR try_cast(`{c}` AS DOUBLE) IS NOT NULL")
