"""Package sizes, units, prices and modifiers as Column expressions.

Unknown stays NULL: nothing here guesses a size, and weight, volume and count are
never converted into each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical unit of each dimension, and each unit's dimension and factor.
CANONICAL = {"weight": "oz", "volume": "fl oz", "count": "ct"}
UNITS = {
    "oz": ("weight", 1.0), "ounce": ("weight", 1.0), "ounces": ("weight", 1.0),
    "lb": ("weight", 16.0), "lbs": ("weight", 16.0), "pound": ("weight", 16.0), "pounds": ("weight", 16.0),
    "g": ("weight", 0.035274), "gram": ("weight", 0.035274), "grams": ("weight", 0.035274),
    "kg": ("weight", 35.274), "kilogram": ("weight", 35.274), "kilograms": ("weight", 35.274),
    "fl oz": ("volume", 1.0), "floz": ("volume", 1.0), "fluid ounce": ("volume", 1.0), "fluid ounces": ("volume", 1.0),
    "gal": ("volume", 128.0), "gallon": ("volume", 128.0), "gallons": ("volume", 128.0),
    "qt": ("volume", 32.0), "quart": ("volume", 32.0), "quarts": ("volume", 32.0),
    "pt": ("volume", 16.0), "pint": ("volume", 16.0), "pints": ("volume", 16.0),
    "ml": ("volume", 0.033814), "milliliter": ("volume", 0.033814), "milliliters": ("volume", 0.033814),
    "l": ("volume", 33.814), "liter": ("volume", 33.814), "liters": ("volume", 33.814),
    "ct": ("count", 1.0), "count": ("count", 1.0), "ea": ("count", 1.0), "each": ("count", 1.0),
}
# Labels of clothing sizes and seasons, and the reasons given for a size that isn't one.
SIZE_LABELS = ("xs", "s", "m", "l", "xl", "xxl", "xxxl", "one size")
LABEL_PATTERN = r"(?i)^(?:(?:spring|summer|fall|winter)\s*\d*|x*small|small|x*large|extra large|medium|size\s*\d+(?:-\d+)?)$"
MISSING, BY_WEIGHT = "missing size", "priced by weight, no fixed package size"
NOT_A_SIZE = "not a package size (looks like an apparel/diaper/seasonal size label)"
NOT_POSITIVE, INVALID, UNKNOWN = "non-positive quantity in package size", "invalid or non-positive quantity in package size", "unrecognized format"
# Modifier phrases, matched in this order.
MODIFIERS = (
    "gluten free", "fat free", "sugar free", "dairy free", "free range", "extra large", "extra virgin", "low fat", "non fat", "reduced fat",
    "organic", "unsweetened", "sweetened", "whole", "skim", "unsalted", "salted", "fresh", "frozen", "large", "small", "medium", "jumbo", "1%", "2%",
)
# Categories and head nouns of liquids.
LIQUID_CATEGORIES = ("Drinks", "Alcohol")
LIQUID_NOUNS = ("milk", "juice", "broth", "smoothie", "kombucha")
LIQUID_CONTAINERS = ("bottle", "bottles", "carton", "cartons", "jug", "jugs", "can", "cans")
DRY_WORDS = ("dry", "powder", "powdered")

#: Longest first, so that a short unit never cuts a longer one.
UNIT_PATTERN = "|".join([r"fl\s?oz", r"fluid\s?ounces?", *sorted((u for u in UNITS if " " not in u), key=lambda u: (-len(u), u))])


def words(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once; plans stay small however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def unit_name(unit: Column) -> Column:
    """Lower case, with single spaces."""
    return F.replace(F.regexp_replace(F.lower(F.trim(unit)), r"\s+", " "), F.lit("fluidounce"), F.lit("fluid ounce"))


def _lookup(unit: Column, pick: int, kind: str) -> Column:
    pairs = [x for u, v in UNITS.items() for x in (F.lit(u), F.lit(v[pick]))]
    return F.try_element_at(F.create_map(*pairs), unit_name(unit)).cast(kind)


def dimension(unit: Column) -> Column:
    return _lookup(unit, 0, "string")


def factor(unit: Column) -> Column:
    return _lookup(unit, 1, "double")


def canonical_unit(dim: Column) -> Column:
    out = F.lit(None).cast("string")
    for d, u in CANONICAL.items():
        out = F.when(dim == d, u).otherwise(out)
    return out


def to_number(text: Column) -> Column:
    """A decimal, or a fraction split at its first slash; NULL for anything else."""
    whole = text.try_cast("double")
    ratio = lambda p: F.try_divide(F.get(p, 0).try_cast("double"), F.nullif(F.get(p, 1).try_cast("double"), F.lit(0.0)))
    return F.when(F.contains(text, F.lit("/")), let(F.split(text, "/", 2), ratio)).otherwise(whole)


def positive(amount: Column) -> Column:
    return F.coalesce((amount > 0) & (amount < float("inf")), F.lit(False))


def convert_amount(amount: Column, source: Column, target: Column) -> Column:
    """NULL across dimensions and for unknown units."""
    return F.when(dimension(source) == dimension(target), amount * factor(source) / factor(target))


def parse_package_size(raw: Column) -> Column:
    """struct(unresolved, reason, variable_weight, dimension, pack_count, amount_per_pack, unit, total_amount, canonical_unit, canonical_total)."""
    # The written forms of a size, packs of counts, packs of amounts, and one amount.
    packs, multi, simple = r"(?i)^(\d+)\s*(?:pk|pack)\s*[x×]\s*(\d+)\s*(?:ct|count)$", rf"(?i)^([\d./]+)\s*({UNIT_PATTERN})\s*[x×]\s*(\d+)\s*(?:ct|count|pk|pack|ea|each)?$", rf"(?i)^([\d./]+)\s*({UNIT_PATTERN})$"
    null = F.lit(None)

    def fields(reason, weight=False, dim=null, count=null, amount=null, unit=null, total=null) -> Column:
        return F.struct(
            F.lit(reason).cast("string").alias("reason"), F.lit(weight).alias("weight"), dim.cast("string").alias("dim"), count.cast("int").alias("count"),
            amount.cast("double").alias("amount"), unit.cast("string").alias("unit"), total.cast("double").alias("total"),
        )

    def several(t: Column) -> Column:
        numbers = F.struct(F.regexp_extract(t, packs, 1).try_cast("int").alias("n"), F.regexp_extract(t, packs, 2).try_cast("int").alias("each"))
        return let(numbers, lambda x: F.when((x["n"] > 0) & (x["each"] > 0), fields(None, dim=F.lit("count"), count=x["n"], amount=x["each"], unit=F.lit("ct"), total=x["n"].cast("double") * x["each"])).otherwise(fields(NOT_POSITIVE)))

    def sized(t: Column, pattern: str, count: Column) -> Column:
        unit = F.lower(F.trim(F.regexp_extract(t, pattern, 2)))
        parts = F.struct(to_number(F.regexp_extract(t, pattern, 1)).alias("amount"), unit.alias("unit"), dimension(unit).alias("dim"), count.alias("n"))
        good = lambda x: positive(x["amount"]) & x["dim"].isNotNull() & F.coalesce(x["n"] > 0, F.lit(False))
        return let(parts, lambda x: F.when(good(x), fields(None, dim=x["dim"], count=x["n"], amount=x["amount"], unit=x["unit"], total=F.when(x["n"] == 1, x["amount"]).otherwise(F.round(x["amount"] * x["n"], 6)))).otherwise(fields(INVALID)))

    def branches(t: Column) -> Column:
        low = F.lower(t)
        return (
            F.when(t == "", fields(MISSING))
            .when(t.rlike(r"(?i)^\$[\d.]+\s*/\s*lb$") | low.isin("by pound", "by the pound"), fields(BY_WEIGHT, True, dim=F.lit("weight")))
            .when(low.isin(*SIZE_LABELS) | t.rlike(LABEL_PATTERN), fields(NOT_A_SIZE))
            .when(low.isin("each", "ea"), fields(None, dim=F.lit("count"), count=F.lit(1), amount=F.lit(1.0), unit=F.lit("each"), total=F.lit(1.0)))
            .when(t.rlike(packs), several(t))
            .when(t.rlike(multi), sized(t, multi, F.regexp_extract(t, multi, 3).try_cast("int")))
            .when(t.rlike(simple), sized(t, simple, F.lit(1)))
            .otherwise(fields(UNKNOWN))
        )

    def result(x: Column) -> Column:
        return F.struct(
            x["reason"].isNotNull().alias("unresolved"), x["reason"].alias("reason"), x["weight"].alias("variable_weight"), x["dim"].alias("dimension"), x["count"].alias("pack_count"), x["amount"].alias("amount_per_pack"),
            x["unit"].alias("unit"), x["total"].alias("total_amount"), F.when(x["reason"].isNull(), canonical_unit(x["dim"])).alias("canonical_unit"), F.round(x["total"] * factor(x["unit"]), 6).alias("canonical_total"),
        )

    return let(F.trim(F.coalesce(raw, F.lit(""))), lambda t: let(branches(t), result))


def price_to_cents(price: Column) -> Column:
    """BIGINT cents of a decimal text; NULL for blank or other text."""
    return F.round(F.trim(price).try_cast("decimal(20,6)") * 100, 0).cast("long")


def extract_modifiers(text: Column) -> Column:
    """struct(found, rest): modifier phrases in the order of MODIFIERS, and the text without them."""
    start = F.struct(F.array().cast("array<string>").alias("found"), F.concat(F.lit(" "), F.replace(F.lower(text), F.lit("-"), F.lit(" ")), F.lit(" ")).alias("rest"))

    def step(acc: Column, phrase: Column) -> Column:
        token = F.concat(F.lit(" "), phrase, F.lit(" "))
        hit = F.contains(acc["rest"], token)
        return F.struct(F.when(hit, F.array_append(acc["found"], phrase)).otherwise(acc["found"]).alias("found"), F.when(hit, F.replace(acc["rest"], token, F.lit(" "))).otherwise(acc["rest"]).alias("rest"))

    return F.aggregate(words(*MODIFIERS), start, step, lambda acc: F.struct(acc["found"].alias("found"), F.trim(F.regexp_replace(acc["rest"], r"\s+", " ")).alias("rest")))


def is_liquid(title: Column, category: Column) -> Column:
    ws = F.split(F.lower(F.trim(F.regexp_replace(title, r"\([^)]*\)\s*$", ""))), r"\s+")
    head = F.exists(F.transform(ws, lambda w, i: F.struct(w.alias("w"), F.get(ws, i + 1).alias("after"))), lambda x: x["w"].isin(*LIQUID_NOUNS) & (x["after"].isNull() | x["after"].isin(*LIQUID_CONTAINERS)))
    return F.coalesce(category.isin(*LIQUID_CATEGORIES), F.lit(False)) | (~F.arrays_overlap(ws, words(*DRY_WORDS)) & head)
