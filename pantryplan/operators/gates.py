"""Gates drop only what is known to conflict: NULL on either side passes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE_TOLERANCE = 0.01


def same_or_unknown(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def size_fits(asked: Column, asked_unit: Column, size: Column, unit: Column) -> Column:
    """Exact-size gate: drops equal units that are more than a hundredth of the request apart."""
    apart = (asked_unit == unit) & (F.abs(size - asked) > SIZE_TOLERANCE * F.abs(asked))
    return ~F.coalesce(apart, F.lit(False))


def sufficiency(asked: Column, asked_unit: Column, size: Column, unit: Column) -> Column:
    """sufficient, unresolved or drop."""
    return F.when(asked.isNull() | asked_unit.isNull(), "sufficient").when(size.isNull() | unit.isNull() | (size <= 0), "unresolved").when(unit != asked_unit, "drop").otherwise("sufficient")


def identity(mode: Column, brand_a: Column, brand_b: Column, conflict: Column) -> Column:
    """keep, drop or review; review drops the row and flags its request."""
    unknown, differ = brand_a.isNull() | brand_b.isNull(), F.lower(brand_a) != F.lower(brand_b)
    exact = F.when(unknown, "review").when(differ, "drop").otherwise("keep")
    return F.when(conflict, "drop").when(mode == "exact", exact).when(~unknown & differ, "drop").otherwise("keep")


def outcome(review: Column, top_score: Column, accept: float | Column, floor: float | Column) -> Column:
    """The three-way cut: accept, review or no_match."""
    accept, floor = (x if isinstance(x, Column) else F.lit(x) for x in (accept, floor))
    return F.when(review, "review").when(top_score.isNull(), "no_match").when(top_score >= accept, "accept").when(top_score >= floor, "review").otherwise("no_match")
