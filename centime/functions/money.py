"""Money and numeric helpers.

Money is summed as DECIMAL so totals are exact and independent of the order
in which partitions are combined; it turns into double only at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(18,2)"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """Round a double to cents through decimal (HALF_UP on the decimal text).

    Going through decimal(30,8) first makes Spark and other engines agree on
    ties that binary doubles would round differently.
    """
    return F.round(col_(c).cast("decimal(30,8)"), 2).cast(MONEY)


def round_to(c, digits: int) -> Column:
    """Deterministic decimal rounding of a double, returned as double (M1)."""
    return F.round(col_(c).cast("decimal(38,12)"), digits).cast("double")


def as_number(c) -> Column:
    """Serialise a decimal to a plain number at the edge."""
    return col_(c).cast("double")


def signed_amount(type_col="type", amount_col="amount") -> Column:
    """M4: EXPENSE subtracts, INCOME adds."""
    a = col_(amount_col)
    return F.when(col_(type_col) == "EXPENSE", -a).otherwise(a)


def clip(c, lo: float, hi: float) -> Column:
    """M2."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col_(c)))


def guarded_ratio(num, den, floor: float = 1.0) -> Column:
    """M3: num / max(floor, den)."""
    return col_(num) / F.greatest(F.lit(floor), col_(den))


def safe_div(num, den, default=0.0) -> Column:
    """M3: num / den, ``default`` when den is 0 or NULL."""
    return F.coalesce(F.try_divide(col_(num), col_(den)), F.lit(default))


def bucket_label(c, edges_col, labels_col) -> Column:
    """M5: right-closed bins (a, b] with open outer edges; missing -> 'nan'.

    ``edges_col`` is an array of sorted, distinct edges (n+1 of them) and
    ``labels_col`` an array of n labels.  The first inner edge e1 closes the
    lowest bin, so v <= e1 is the lowest label (include_lowest semantics).
    """
    v = col_(c)
    edges = col_(edges_col)
    labels = col_(labels_col)
    # index of the first inner edge >= v, counting inner edges from 1
    inner = F.slice(edges, 2, F.size(edges) - 2)
    idx = F.size(F.filter(inner, lambda e: e < v)) + 1
    return F.when(v.isNull() | F.isnan(v), F.lit("nan")).otherwise(F.element_at(labels, idx))
