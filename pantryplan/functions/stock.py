"""Stock badges as states; anything not understood stays unverified."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUT, MANY, IN, UNVERIFIED = "out_of_stock", "many_in_stock", "in_stock", "unverified"


def classify(raw: Column) -> Column:
    """struct(state, remaining, is_lower_bound)."""
    low, found = F.lower(F.trim(F.coalesce(raw, F.lit("")))), r"^in stock \((\d+)(\+?)\)$"
    exact = low.rlike(found)
    state = F.when(low == "out of stock", OUT).when(low == "many in stock", MANY).when(exact, IN).otherwise(UNVERIFIED)
    return F.struct(state.alias("state"), F.when(exact, F.regexp_extract(low, found, 1).try_cast("int")).when(low == "out of stock", 0).alias("remaining"), (exact & (F.regexp_extract(low, found, 2) == "+")).alias("is_lower_bound"))


def covers(state: Column, remaining: Column, is_lower_bound: Column, packages: Column) -> Column:
    """False only for what is known not to suffice."""
    short = (state == IN) & ~is_lower_bound & (remaining < packages)
    return ~((state == OUT) | F.coalesce(short, F.lit(False)))
