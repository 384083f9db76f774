"""Shopping-list lines as typed requests, in stages of Column expressions.

Each stage adds columns that the next reads, so no expression nests another's
cases. A line that can't be understood safely asks for review and says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantryplan.functions.units import UNIT_PATTERN, canonical_unit, dimension, extract_modifiers, factor, parse_package_size, positive, to_number

# Quantity words, vague words, containers and products sold by size.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
QUANTITY_WORDS = {"a dozen": 12, "dozen": 12, "half a dozen": 6, "half dozen": 6, "a couple": 2, "a couple of": 2, "couple": 2, "a pair": 2, "a pair of": 2, "a": 1, "an": 1}
VAGUE = ("some", "a few", "few", "several", "a bunch of")
CONTAINERS = ("bag", "bags", "box", "boxes", "can", "cans", "bottle", "bottles", "pack", "packs", "carton", "cartons", "jar", "jars", "case", "cases", "loaf", "loaves")
SOLD_BY_SIZE = ("milk", "juice", "oil", "flour", "sugar", "rice", "pasta", "cereal", "yogurt", "cheese", "butter", "water", "soda", "coffee", "tea", "honey", "syrup", "broth", "soup", "cream", "vinegar")

NO_QUANTITY, BAD_QUANTITY, VAGUE_QUANTITY = "no recognizable quantity", "non-positive quantity", "vague quantity"
NO_SIZE, NEEDS_SIZE, NO_PRODUCT = "container without a size", "sold by size, not by count", "no product"


def _phrases() -> dict[str, float]:
    return {k: float(v) for k, v in {**QUANTITY_WORDS, **NUMBER_WORDS, **{f"{w} dozen": 12 * n for w, n in NUMBER_WORDS.items()}}.items()}


def _alternatives(values) -> str:
    return "|".join(sorted(values, key=lambda v: (-len(v), v)))


def leading_quantity(df: DataFrame, text: str) -> DataFrame:
    """q_qty, q_rest and q_vague of the line's start; ``12%`` is no quantity."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    mixed, number, word = r"^(\d+) (\d+/\d+)(?: |$)(.*)$", r"^(\d+(?:\.\d+)?(?:/\d+)?)(.*)$", rf"^({_alternatives(_phrases())})(?: (.*))?$"
    vague = rf"^({_alternatives(VAGUE)})(?: (.*))?$"
    table = F.create_map(*[x for k, v in _phrases().items() for x in (F.lit(k), F.lit(v))])
    get = lambda p, g: F.regexp_extract("q_text", p, g)
    percent = get(number, 2).startswith("%")
    dozen = F.regexp_extract(F.trim(get(number, 2)), r"^dozen(?: (.*))?$", 0) != ""
    df = df.withColumn("q_text", t).withColumn("q_vague", F.col("q_text").rlike(vague))
    qty = (
        F.when(F.col("q_vague"), None)
        .when(F.col("q_text").rlike(mixed), get(mixed, 1).try_cast("double") + to_number(get(mixed, 2)))
        .when(F.col("q_text").rlike(number) & percent, None)
        .when(F.col("q_text").rlike(number), to_number(get(number, 1)) * F.when(dozen, 12.0).otherwise(1.0))
        .when(F.col("q_text").rlike(word), F.try_element_at(table, get(word, 1)))
    )
    rest = (
        F.when(F.col("q_vague"), get(vague, 2))
        .when(F.col("q_text").rlike(mixed), get(mixed, 3))
        .when(F.col("q_text").rlike(number) & percent, F.col("q_text"))
        .when(F.col("q_text").rlike(number), F.regexp_replace(F.trim(get(number, 2)), r"^dozen(?: |$)", ""))
        .when(F.col("q_text").rlike(word), get(word, 2))
        .otherwise(F.col("q_text"))
    )
    return df.withColumn("q_qty", qty.cast("double")).withColumn("q_rest", F.trim(rest))


def package_size(df: DataFrame) -> DataFrame:
    """A size or container after the quantity: ``16 oz bags of`` or ``bags of``."""
    size = rf"^([\d./]+\s*(?:{UNIT_PATTERN})(?:\s*[x×]\s*\d+\s*(?:ct|count|pk|pack|ea|each)?)?)(?:\s|$)"
    df = df.withColumn("p_size", F.regexp_extract("q_rest", rf"(?i){size}", 1))
    df = df.withColumn("p_after", F.trim(F.expr("substring(q_rest, length(p_size) + 1)")))
    held = rf"^({_alternatives(CONTAINERS)})(?:\s+of)?(?:\s+(.*))?$"
    df = df.withColumn("p_container", F.nullif(F.regexp_extract("p_after", held, 1), F.lit("")))
    rest = F.when(F.col("p_container").isNotNull(), F.regexp_extract("p_after", held, 2)).otherwise(F.regexp_replace("p_after", r"^of\s+", ""))
    df = df.withColumn("p_size", F.nullif("p_size", F.lit(""))).withColumn("p_after", F.trim(rest))
    late = rf"(?i){size}"
    df = df.withColumn("p_late", F.when(F.col("p_size").isNull() & F.col("p_container").isNotNull(), F.nullif(F.regexp_extract("p_after", late, 1), F.lit(""))))
    df = df.withColumn("p_after", F.when(F.col("p_late").isNotNull(), F.trim(F.expr("substring(p_after, length(p_late) + 1)"))).otherwise(F.col("p_after")))
    return df.withColumn("p_parsed", F.when(F.coalesce("p_size", "p_late").isNotNull(), parse_package_size(F.coalesce("p_size", "p_late"))))


def parse_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``parsed``: needs_review, review_reasons, product_type, quantity and size fields, modifiers."""
    columns = df.columns
    comma = r"^(.*),\s*([^,]*\d[^,]*|(?:a |half )?dozen)$"
    line = F.when(F.col(text).rlike(f"(?i){comma}"), F.concat_ws(" ", F.regexp_extract(text, f"(?i){comma}", 2), F.regexp_extract(text, f"(?i){comma}", 1))).otherwise(F.col(text))
    out = package_size(leading_quantity(df.withColumn("l_text", F.coalesce(line, F.lit(""))), "l_text"))
    unit = rf"(?i)^({UNIT_PATTERN})\.?(?:\s+of)?(?:\s+|$)"
    bare = F.col("p_parsed").isNull() & F.col("p_container").isNull()
    out = out.withColumn("u_unit", F.when(bare, F.nullif(F.regexp_extract("p_after", unit, 1), F.lit(""))))
    out = out.withColumn("u_rest", F.when(F.col("u_unit").isNotNull(), F.regexp_replace("p_after", unit, "")).otherwise(F.col("p_after")))
    out = out.withColumn("m", extract_modifiers(F.col("u_rest")))
    sized = F.col("p_parsed").isNotNull() & ~F.coalesce(F.col("p_parsed.unresolved"), F.lit(True))
    dim = F.when(F.col("u_unit").isNotNull(), dimension(F.col("u_unit"))).when(sized, F.col("p_parsed.dimension")).when(bare, F.lit("count"))
    total = F.when(F.col("u_unit").isNotNull(), F.col("q_qty") * factor(F.col("u_unit"))).when(sized, F.col("q_qty") * F.col("p_parsed.canonical_total")).when(bare, F.col("q_qty"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("q_vague"), VAGUE_QUANTITY),
            F.when(~F.col("q_vague") & F.col("q_qty").isNull(), NO_QUANTITY),
            F.when(F.col("q_qty").isNotNull() & ~positive(F.col("q_qty")), BAD_QUANTITY),
            F.when(F.col("p_container").isNotNull() & ~sized, NO_SIZE),
            F.when(bare & F.col("u_unit").isNull() & F.element_at(F.split("m.rest", " "), -1).isin(*SOLD_BY_SIZE), NEEDS_SIZE),
            F.when(F.col("m.rest") == "", NO_PRODUCT),
        )
    )
    parsed = F.struct(
        (F.size(reasons) > 0).alias("needs_review"),
        reasons.alias("review_reasons"),
        F.col("m.rest").alias("product_type"),
        F.col("q_qty").alias("requested_quantity"),
        F.coalesce(F.lower("u_unit"), F.col("p_parsed.unit"), F.when(bare, F.lit("ct"))).alias("unit"),
        dim.alias("dimension"),
        F.round(total, 6).alias("canonical_quantity"),
        canonical_unit(dim).alias("canonical_unit"),
        F.col("m.found").alias("modifiers"),
        F.when(F.col("p_container").isNotNull(), F.col("q_qty")).alias("package_count"),
        F.col("p_parsed.canonical_total").alias("package_size"),
        F.col("p_container").alias("container"),
    )
    return out.select(*columns, parsed.alias("parsed"))


def pool_query(text: Column, parsed: Column) -> Column:
    """What a pool of candidates is searched by: modifiers and product, without words of quantity; the text where nothing is left."""
    words = F.trim(F.concat_ws(" ", F.array_join(parsed["modifiers"], " "), F.trim(F.coalesce(parsed["product_type"], F.lit("")))))
    return F.coalesce(F.nullif(words, F.lit("")), text)


MULTIPACK = rf"(?i)([\d./]+\s*(?:{UNIT_PATTERN})\s*[x×]\s*\d+\s*(?:ct|count|pk|pack|ea|each)?)"


def requested_total(text: Column, parsed: Column) -> Column:
    """struct(total, unit): a multipack phrase anywhere in the text, else the parsed quantity."""
    size = parse_package_size(F.trim(F.regexp_extract(text, MULTIPACK, 1)))
    multi = text.rlike(MULTIPACK) & ~size["unresolved"]
    return F.when(multi, F.struct(size["canonical_total"].alias("total"), size["canonical_unit"].alias("unit"))).otherwise(F.struct(parsed["canonical_quantity"].alias("total"), parsed["canonical_unit"].alias("unit")))


def merge_lines(parsed: DataFrame) -> DataFrame:
    """One row for lines of a list with the same product, unit and mode; lines to review stay apart."""
    p = F.col("parsed")
    key = F.when(p["needs_review"] | p["canonical_unit"].isNull(), F.concat(F.lit("#"), F.col("pos"))).otherwise(F.concat_ws("|", p["product_type"], p["canonical_unit"], "matching_mode"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return parsed.groupBy("list_id", key.alias("merge_key")).agg(
        F.min("pos").alias("pos"), F.first(p["product_type"]).alias("product_type"), F.first(p["canonical_unit"]).alias("canonical_unit"), F.round(F.sum(p["canonical_quantity"]), 6).alias("quantity"),
        F.first("matching_mode").alias("matching_mode"), F.bool_or(p["needs_review"]).alias("needs_review"), F.count("*").alias("n_lines"), texts.alias("texts"),
    ).drop("merge_key")
