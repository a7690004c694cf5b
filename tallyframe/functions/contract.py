"""Safe casts and success predicates. Four sets of rules exist side by side, and each has its name here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The statuses that count as a success, by rule.
CONSOLIDATED_STATUSES = ("ok", "success", "succeeded", "warn")
LOOP_STATUSES = ("complete", "ok", "success", "succeeded", "warn")
ARRAY_STATUSES = ("ok", "success")


def number(c: Column) -> Column:
    """A finite double, else null; text is parsed, '' and nan and infinities are null."""
    d = c.try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def integer(c: Column) -> Column:
    """A whole number, else 0; text such as '3.0' isn't one."""
    text = F.trim(c.cast("string"))
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint")), F.lit(0).cast("bigint"))


def blank_to_null(c: Column) -> Column:
    return F.when(c.rlike(r"(?U)\S"), c)


def measured_success(status: Column, score: Column, labeled_total: Column) -> Column:
    """status 'ok', a finite score, labelled rows."""
    return F.coalesce((F.lower(status) == "ok") & number(score).isNotNull() & (integer(labeled_total) > 0), F.lit(False))


def result_outcome(status: Column, score: Column, labeled_total: Column) -> Column:
    return F.when(F.lower(status) == "planned", "planned").when(measured_success(status, score, labeled_total), "success").otherwise("failure")


def is_smoke(output_dir: Column, source: Column) -> Column:
    has = lambda c, s: F.coalesce(F.contains(F.lower(c), F.lit(s)), F.lit(False))
    return has(output_dir, "/_smoke/") | has(source, "smoke")


def is_measurement(status: Column, score: Column, labeled_total: Column, smoke: Column) -> Column:
    """For consolidated runs: no smoke run, and an unknown number of labelled rows will do, 0 won't."""
    labeled = number(labeled_total)
    ok = F.lower(F.coalesce(status, F.lit(""))).isin(*CONSOLIDATED_STATUSES)
    return ~smoke & ok & number(score).isNotNull() & (labeled.isNull() | (labeled > 0))


def is_loop_measurement(status: Column, score: Column, labeled_total: Column) -> Column:
    """For loop results: labelled rows are needed."""
    return F.lower(F.coalesce(status, F.lit(""))).isin(*LOOP_STATUSES) & number(score).isNotNull() & (F.coalesce(number(labeled_total), F.lit(0.0)) > 0)


def is_array_success(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))).isin(*ARRAY_STATUSES)


def is_close(a: Column, b: Column) -> Column:
    """Relative tolerance 1e-9, absolute 1e-12."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))
