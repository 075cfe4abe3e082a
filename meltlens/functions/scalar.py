"""Pure ``Column`` builders shared by all operators.

All of these stay inside whole-stage codegen: no Python runs per row.
Missing values are SQL NULL; a comparison on NULL is treated as False
(pandas semantics) by wrapping every flag in ``coalesce(..., false)``.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

NUMERIC_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col_or_lit(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int with NULL treated as False."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def flag_d(cond: Column) -> Column:
    """Boolean -> 0.0/1.0 double with NULL treated as False."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def safe_div(num: Column, den: Column, fill: float = 0.0) -> Column:
    """num / den with 0 and NULL denominators yielding ``fill``."""
    return F.coalesce(num / F.nullif(den, F.lit(0.0)), F.lit(float(fill)))


def finite_or_null(c: Column) -> Column:
    """NaN / +-Inf -> NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def sentinel_to_numeric(c: Column, strip_percent: bool = False) -> Column:
    """Dirty string -> double; sentinels and non-numbers -> NULL.

    ``strip_percent`` also removes ``,`` and ``%`` first (value is not
    divided by 100).  A numeric regex guards ``try_cast`` so that strings
    such as ``'1d'`` or ``'nan'`` do not parse.
    """
    s = F.trim(c.cast("string"))
    if strip_percent:
        s = F.trim(F.regexp_replace(s, r"[,%]", ""))
    low = F.lower(s)
    return F.when(
        ~low.isin(*config.NULL_SENTINELS) & s.rlike(NUMERIC_PATTERN),
        s.try_cast("double"),
    )


def is_numeric_text(c: Column, strip_percent: bool = False) -> Column:
    return sentinel_to_numeric(c, strip_percent).isNotNull()


def clamp01_scalar(c: Column) -> Column:
    """Per-value unit-interval repair (C15): non-finite/NULL -> 0, (1,100] -> /100,
    >100 -> 1, then clamp to [0, 1]."""
    v = finite_or_null(c)
    scaled = F.when(v > 1.0, F.when(v <= 100.0, v / 100.0).otherwise(F.lit(1.0))).otherwise(v)
    # greatest/least skip NULL, so guard explicitly: missing -> 0
    return F.when(v.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def clamp01_plain(c: Column) -> Column:
    """Clamp without the percent rescale (second variant of C15)."""
    v = finite_or_null(c)
    return F.when(v.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def rank_of(label: Column, order: Sequence[str], default: int = 0) -> Column:
    """Label -> position in ``order`` (unknown -> ``default``)."""
    expr = None
    for i, name in enumerate(order):
        expr = F.when(label == name, F.lit(i)) if expr is None else expr.when(label == name, F.lit(i))
    return expr.otherwise(F.lit(default))


def label_of(rank: Column, order: Sequence[str]) -> Column:
    """Position -> label (inverse of :func:`rank_of`); ``rank`` is referenced
    once so large rank expressions are not duplicated by the optimizer."""
    return F.try_element_at(F.array(*[F.lit(x) for x in order]), rank.cast("int") + 1)


def severity_from_score(score: Column) -> Column:
    """Left-closed severity ladder (M15): >=.8 CRITICAL ... else NORMAL."""
    cuts = config.SEVERITY_CUTS
    names = config.SEVERITY_ORDER
    return (
        F.when(score >= cuts[3], names[4])
        .when(score >= cuts[2], names[3])
        .when(score >= cuts[1], names[2])
        .when(score >= cuts[0], names[1])
        .otherwise(names[0])
    )


def severity_rank(sev: Column) -> Column:
    return rank_of(sev, config.SEVERITY_ORDER, 0)


def compact_array(items: Iterable[Column]) -> Column:
    """Ordered array of the non-NULL string items (fixed rule order).

    ``array_compact`` is a lambda ``filter`` underneath, which Spark evaluates
    outside generated code together with everything inside it (here: every
    formatted rule text).  ``flatten`` of one-or-zero element arrays keeps the
    whole expression in generated code."""
    empty = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.when(x.isNotNull(), F.array(x)).otherwise(empty) for x in items]))


def pct1(c: Column) -> Column:
    """Python ``{x:.1%}`` equivalent (SQL half-up rounding)."""
    return F.format_string("%.1f%%", c * 100.0)
