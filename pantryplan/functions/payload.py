"""Fields of crawled pages, item cards and JSON payloads.

Blank text stands for what a payload doesn't say, as in the item files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A JSON string's inside, without a step back on long ones.
INSIDE = r'[^"\\]*+(?:\\[^\n][^"\\]*+)*+'
MARK = '"item_data":{'
# What a card's fields look like, before and behind its mark.
BEFORE, BEHIND = 900, 4000
IMAGE = rf'"uri":"({INSIDE})"\}}\}}'
RATING = r'"value":"(average rating[^"]*)"'
LABEL = rf'"label":"{{}}","priority_level":"[^"]+","value":"({INSIDE})"'
BADGE = rf'"badgeText":"({INSIDE})"'
CARD = {
    "item_id": r'"item_id":"([0-9]+)"',
    "item_name": rf'"item_name":"({INSIDE})"',
    "price_display": rf'"price":\{{[^}}]*?"display_string":"({INSIDE})"',
    "unit_amount": r'"unit_amount":([0-9]+)',
    "item_limit": r'"item_limit_data":\{"limit":"([0-9]+)"',
    "non_discount": r'"non_discount_price":([0-9]+)',
    "sold_as": rf'"sold_as_info_short_string":"({INSIDE})"',
}
SALE = r"^\$([0-9.]+)(?: on sale from \$([0-9.]+))?$"
EXPIRES = "Expires Soon "
ESCAPES = (('\\"', '"'), ("\\\\", "\\"), ("\\/", "/"), ("\\n", " "), ("\\u0026", "&"))
STOCK, STARS, OUNCES = r"^([0-9]+)\s+in stock", r"^average rating of ([0-9.]+) stars,\s*(.+)", r"(?i)([0-9.]+)\s*oz"
PAGE = {
    "best_by": ('data-testid="best_by:Best by ([^"]+)"', "Best by ([0-9]{1,2}/[0-9]{1,2})"),
    "recently_sold": ('data-testid="recently_bought:([^"]+)"', r"(?i)([0-9.]+k?\+? recently sold)"),
}
PAGE_UNIT = r"([0-9][0-9.]* oz)\s*[•·]\s*(\$[0-9.]+/oz)"
UNIT_LEAF, STRIKE_LEAF, SPOKEN_LEAF, TITLE_LEAF = "props.per-unit-price-string", "props.strikethrough-price", "props.price-row-accessibility-text", "title.content"
SPOKEN = r"^\$([0-9.]+)(?:, was \$([0-9.]+))?"


def _or_blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _money(dollars: Column) -> Column:
    """Two decimals; null stays null."""
    return F.when(dollars.isNotNull(), F.format_string("%.2f", dollars))


def _given(value: Column) -> Column:
    """Null where blank."""
    return F.nullif(value, F.lit(""))


def flight(html: Column) -> Column:
    """The second elements, where they are strings, of all ``<script>self.__next_f.push([n,"..."])`` scripts, joined; a script that isn't JSON adds nothing."""
    scripts = F.filter(F.transform(F.filter(F.split(html, "<script>"), lambda s, i: i > 0), lambda s: F.split_part(s, F.lit("</script>"), F.lit(1))), lambda s: F.startswith(s, F.lit("self.__next_f.push(")))
    inner = F.transform(scripts, lambda s: F.regexp_extract(s, r"(?s)^self\.__next_f\.push\((.*)\)", 1))
    string = F.filter(inner, lambda s: s.rlike(rf'(?s)^\s*\[\s*(?:"{INSIDE}"|[^"\[\]{{}},]+)\s*,\s*"'))
    return F.array_join(F.transform(string, lambda s: F.get(F.from_json(s, "array<string>"), 1)), "")


def page_batches(spark: SparkSession, rows: int = 32) -> None:
    """Arrow batches for rows that hold whole pages of cards: ten thousand of those would fill a worker's memory. A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def item_windows(pages: DataFrame, text: str, before: int = BEFORE, behind: int = BEHIND) -> DataFrame:
    """A row for each mark of an item, in order: ``item_no``, the text ``ahead`` of it and that from it on (``window``).

    A page is searched once and each window is cut at its mark, so time grows with
    the page and its marks, not with their product.
    """

    page_batches(pages.sparkSession)

    @F.arrow_udf("array<struct<ahead:string,window:string>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for value in batch:
                page, found, at = value.as_py() or "", [], -1
                while (at := page.find(MARK, at + 1)) >= 0:
                    found.append({"ahead": page[max(0, at - before) : at], "window": page[at : at + behind]})
                out.append(found)
            yield pa.array(out, pa.list_(pa.struct({"ahead": pa.string(), "window": pa.string()})))

    return pages.withColumn("__cut", cut(F.col(text))).select(*pages.columns, F.posexplode("__cut").alias("item_no", "__at")).select(*pages.columns, "item_no", "__at.*")


def unescape(text: Column) -> Column:
    """The escapes of ESCAPES replaced one after another."""
    for old, new in ESCAPES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return _or_blank(text)


def usd(cents: Column) -> Column:
    return _or_blank(_money(cents.try_cast("bigint") / 100))


def cents_display(cents: Column) -> Column:
    return _or_blank(F.concat(F.lit("$"), _money(cents.try_cast("bigint") / 100)))


def unit_fields(name: Column, sold_as: Column, price: Column) -> Column:
    """struct(unit_size, unit_price): of ``size • price``, else the size, or what is in brackets at a title's end, and a price an ounce where it says ounces."""
    sold = F.trim(_or_blank(sold_as))
    size = F.coalesce(_given(sold), F.regexp_extract(name, r"\(([^)]+)\)\s*$", 1))
    ounces = F.regexp_extract(size, OUNCES, 1).try_cast("double")
    each = F.try_divide(price.try_cast("double"), F.nullif(ounces, F.lit(0.0)))
    split_ = F.contains(sold, F.lit("•"))
    left, right = F.split_part(sold, F.lit("•"), F.lit(1)), F.regexp_extract(sold, "(?s)•(.*)$", 1)
    return F.struct(
        F.when(split_, F.trim(left)).otherwise(_or_blank(size)).alias("unit_size"),
        F.when(split_, F.trim(right)).when(each.isNotNull(), F.concat(F.lit("$"), _money(each), F.lit("/oz"))).otherwise("").alias("unit_price"),
    )


def stock_status(badge: Column) -> Column:
    n = F.regexp_extract(badge, STOCK, 1).try_cast("bigint")
    return F.when(F.contains(badge, F.lit("20+")), "In stock (20+)").when(n == 0, "Out of stock").when(n.isNotNull(), F.concat(F.lit("In stock ("), n.cast("string"), F.lit(")"))).otherwise(_or_blank(badge))


def rating(text: Column) -> Column:
    return F.struct(_or_blank(F.regexp_extract(text, STARS, 1)).alias("rating"), _or_blank(F.regexp_extract(text, STARS, 2)).alias("rating_count"))


def category_title(slug: Column) -> Column:
    """A url-encoded slug without its number, each run of letters with a capital."""
    text = F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(slug), slug), r"-[0-9]+$", ""))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), "")


def thumbnail(url: Column, pixels: int = 280) -> Column:
    """The first ``width=..,height=..`` of an image url replaced."""
    return _or_blank(F.regexp_replace(url, r"(?s)^(.*?)width=[0-9]+,height=[0-9]+", f"$1width={pixels},height={pixels}"))


def page_badges(html: Column) -> Column:
    """best_by, recently_sold, unit_size, unit_price and snap of a product page; the marked-up value wins over the plain one."""
    pick = lambda patterns: _or_blank(F.coalesce(*(_given(F.regexp_extract(html, p, 1)) for p in patterns)))
    snap = F.contains(html, F.lit('"type":"snap"')) | F.contains(html, F.lit(">SNAP<"))
    unit = [_or_blank(F.regexp_extract(html, PAGE_UNIT, i)).alias(c) for i, c in ((1, "unit_size"), (2, "unit_price"))]
    return F.struct(*(pick(p).alias(c) for c, p in PAGE.items()), *unit, F.when(snap, "yes").otherwise("").alias("snap"))


# --- item cards -----------------------------------------------------------------------------------


def raw_cards(windows: DataFrame) -> DataFrame:
    """The raw fields of item windows; a window without a number of its item is none."""
    found = windows.withColumns({c: F.regexp_extract("window", p, 1) for c, p in CARD.items()}).where("item_id <> ''")
    label = lambda kind: F.regexp_extract_all("ahead", F.lit(LABEL.format(kind)), F.lit(1))
    found = found.withColumns({"image": F.regexp_extract("ahead", IMAGE, 1), "rating_text": F.regexp_extract("ahead", RATING, 1), "item_price": _or_blank(F.get(label("item_price"), 0))})
    found = found.withColumn("badge_texts", F.filter(F.concat(F.regexp_extract_all("window", F.lit(BADGE), F.lit(1)), label("badge")), lambda b: b != ""))
    first = F.get(F.filter("badge_texts", lambda b: F.contains(F.lower(b), F.lit("in stock"))), 0)
    return found.withColumn("badge", _or_blank(first)).drop("ahead", "window")


RAW = ("item_id", "item_name", "price_display", "unit_amount", "item_limit", "non_discount", "sold_as", "image", "rating_text", "item_price", "badge_texts", "badge")
PRODUCT = """struct<id:string,name:string,price:struct<displayString:string,unitAmount:string>,imageUrl:string,itemLimit:string,ratings:struct<averageRating:string,displayNumRatings:string>,
badges:array<struct<text:string>>,logging:struct<non_discount_price:string>,soldAsInfoShortText:string,soldAsInfoLongText:string,
metadata:struct<soldAsInfo:struct<measurementPrice:struct<displayString:string>,measurementUnit:string,measurementFactor:struct<unitAmount:string,decimalPlaces:string>>>>"""


def six_digits(amount: Column) -> Column:
    """A positive number with six digits that count, no trailing zeros; with an exponent from a million on and below a ten-thousandth, as ``:g`` writes it."""
    power = F.floor(F.log10(amount))
    # halves go to the even digit; a power of ten that isn't below 1 is exact
    rounded = F.when(power > 5, F.rint(amount / F.pow(F.lit(10.0), power - 5)) * F.pow(F.lit(10.0), power - 5)).otherwise(F.rint(amount * F.pow(F.lit(10.0), F.lit(5) - power)) / F.pow(F.lit(10.0), F.lit(5) - power))
    high = F.floor(F.log10(rounded))
    bare = lambda text: F.regexp_replace(text, r"\.?0+$", "")
    mantissa = F.when(high < 0, rounded * F.pow(F.lit(10.0), -high)).otherwise(rounded / F.pow(F.lit(10.0), high))
    short = F.concat(bare(F.format_string("%.5f", mantissa)), F.when(high < 0, "e-").otherwise("e+"), F.lpad(F.abs(high).cast("string"), 2, "0"))
    return F.when(amount == 0, "0").when((high > 5) | (high < -4), short).otherwise(bare(F.format_string("%.10f", rounded)))


def raw_products(docs: DataFrame, column: str) -> DataFrame:
    """The raw fields of a JSON list of products, a row each; one without an id is none."""
    rows = docs.select(*(c for c in docs.columns if c != column), F.posexplode(F.from_json(column, f"array<{PRODUCT}>")).alias("item_no", "p"))
    p = lambda path: _or_blank(F.col(f"p.{path}"))
    sold, factor, price = "p.metadata.soldAsInfo", "p.metadata.soldAsInfo.measurementFactor", "p.metadata.soldAsInfo.measurementPrice.displayString"
    amount = F.col(f"{factor}.unitAmount").try_cast("bigint") / F.pow(F.lit(10.0), F.coalesce(F.col(f"{factor}.decimalPlaces").try_cast("int"), F.lit(0)))
    measured = F.concat(six_digits(amount), F.lit(" "), F.col(f"{sold}.measurementUnit"), F.when(_or_blank(F.col(price)) != "", F.concat(F.lit(" • "), price)).otherwise(""))
    stars = F.concat(F.lit("average rating of "), "p.ratings.averageRating", F.lit(" stars, "), p("ratings.displayNumRatings"))
    out = {
        "item_id": p("id"), "item_name": p("name"), "price_display": p("price.displayString"), "unit_amount": p("price.unitAmount"), "item_limit": p("itemLimit"), "non_discount": p("logging.non_discount_price"),
        "sold_as": F.coalesce(_given(F.col("p.soldAsInfoShortText")), _given(F.col("p.soldAsInfoLongText")), F.when(F.col(f"{sold}.measurementUnit") != "", measured), F.lit("")), "image": p("imageUrl"),
        "rating_text": _or_blank(stars), "item_price": F.lit(""), "badge_texts": F.coalesce(F.transform("p.badges", lambda b: F.coalesce(b["text"], F.lit(""))), F.array().cast("array<string>")),
        "badge": _or_blank(F.concat(F.col("p.itemLimit"), F.lit(" in stock"))),
    }
    return rows.withColumns(out).where("item_id not in ('', 'None')").drop("p")


def normalised(raw: DataFrame) -> DataFrame:
    """The columns of an item file from raw fields: each takes the first source of its chain that says something."""
    first = lambda test: _or_blank(F.get(F.filter("badge_texts", test), 0))
    has = lambda text: lambda b: F.contains(F.lower(b), F.lit(text))
    kept = [c for c in raw.columns if c not in RAW]
    name, spoken = unescape(F.col("item_name")), unescape(F.col("item_price"))
    sale = [F.regexp_extract(spoken, SALE, i) for i in (1, 2)]
    step = raw.withColumns({"__name": name, "__now": sale[0], "__was": sale[1]})
    dollars = lambda c: _or_blank(F.concat(F.lit("$"), _given(F.col(c))))
    struck = cents_display(F.col("non_discount"))
    step = step.withColumns(
        {
            "expires_soon": F.when(F.startswith("__name", F.lit(EXPIRES)), "yes").otherwise(""),
            "name": F.when(F.startswith("__name", F.lit(EXPIRES)), F.substr("__name", F.lit(len(EXPIRES) + 1))).otherwise(F.col("__name")),
            "price": F.coalesce(_given(F.col("price_display")), dollars("__now")),
            "cents": F.coalesce(_given(F.col("unit_amount")), F.rint(F.col("__now").try_cast("double") * 100).cast("bigint").cast("string"), F.lit("")),
            "original_price": F.coalesce(_given(struck), dollars("__was")),
            "original_price_usd": F.when(struck != "", usd(F.col("non_discount"))).otherwise(_or_blank(_money(F.col("__was").try_cast("double")))),
            "discount": first(has("% off")),
            "best_by": F.trim(F.substr(first(lambda b: F.startswith(F.lower(b), F.lit("best by "))), F.lit(9))),
            "recently_sold": first(has("recently sold")),
            "snap": F.when(F.exists("badge_texts", lambda b: F.upper(F.trim(b)) == "SNAP"), "yes").otherwise(""),
            "stock_status": stock_status(
                F.coalesce(_given(F.col("badge")), _given(first(lambda b: F.contains(F.lower(b), F.lit("in stock")) | (F.lower(b) == "out of stock"))), F.concat(_given(F.col("item_limit")), F.lit(" in stock")), F.lit(""))
            ),
            "__stars": rating(F.col("rating_text")),
        }
    )
    step = step.withColumn("price_usd", usd(F.col("cents"))).withColumn("__unit", unit_fields(F.col("name"), unescape(F.col("sold_as")), F.col("price_usd")))
    return step.select(
        *kept, "item_id", F.col("name").alias("item_name"), "expires_soon", "best_by", "price", "price_usd", "original_price", "original_price_usd", "discount", "__unit.unit_size", "__unit.unit_price",
        "stock_status", "recently_sold", "snap", "__stars.rating", "__stars.rating_count", unescape(F.col("image")).alias("image_url"),
    )


# --- JSON payloads --------------------------------------------------------------------------------


def named_leaves(text: Column, names: tuple[str, ...]) -> Column:
    """array<struct<name, value>>: the strings that aren't empty under one of ``names`` at any depth of a JSON text, in document order.

    Every string of the text is one match, with the string it names where it names
    one, so what stands inside of a string is never taken for a name.
    """
    found = F.regexp_extract_all(text, F.lit(rf'"{INSIDE}"(?:\s*:\s*"{INSIDE}")?'), F.lit(0))
    pairs = F.transform(F.filter(found, lambda m: F.exists(F.array(*map(F.lit, names)), lambda n: F.startswith(m, F.concat(F.lit('"'), n, F.lit('"'))))), lambda m: F.concat(F.lit("["), F.regexp_replace(m, rf'^("{INSIDE}")\s*:', "$1,"), F.lit("]")))
    read = F.transform(pairs, lambda m: F.from_json(m, "array<string>"))
    return F.transform(F.filter(read, lambda r: F.coalesce(F.get(r, 1), F.lit("")) != ""), lambda r: F.struct(r[0].alias("name"), r[1].alias("value")))


def item_details(text: Column) -> Column:
    """Struct of what an item's JSON page adds: size and unit price (the last that has both), struck-out price (the last in dollars, else the first that is spoken), badges."""
    leaves = named_leaves(text, (UNIT_LEAF, STRIKE_LEAF, SPOKEN_LEAF, TITLE_LEAF))

    def step(state: Column, leaf: Column) -> Column:
        name, value = leaf["name"], leaf["value"]
        unit = (name == UNIT_LEAF) & F.contains(value, F.lit("•"))
        struck = (name == STRIKE_LEAF) & F.startswith(value, F.lit("$"))
        was = F.when(name == SPOKEN_LEAF, _given(F.regexp_extract(value, SPOKEN, 2)))
        spoken = was.isNotNull() & (state["original_price"] == "")
        dollars = lambda v: _money(v.try_cast("double"))
        return F.struct(
            F.when(unit, F.trim(F.split_part(value, F.lit("•"), F.lit(1)))).otherwise(state["unit_size"]).alias("unit_size"),
            F.when(unit, F.trim(F.regexp_extract(value, "(?s)•(.*)$", 1))).otherwise(state["unit_price"]).alias("unit_price"),
            F.when(struck, value).when(spoken, F.concat(F.lit("$"), was)).otherwise(state["original_price"]).alias("original_price"),
            F.coalesce(F.when(struck, dollars(F.substr(value, F.lit(2)))), F.when(spoken, dollars(was)), state["original_price_usd"]).alias("original_price_usd"),
        )

    start = F.struct(*(F.lit("").alias(c) for c in ("unit_size", "unit_price", "original_price", "original_price_usd")))
    return F.aggregate(leaves, start, step)


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, title, lang, host, n_links and article length of raw pages."""
    pick = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return pages.select(
        "page_id", pick(r"(?s)<title>(.*?)</title>").alias("title"), pick(r'<html lang="([^"]*)"').alias("lang"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_count("html", F.lit("<a href=")).cast("long").alias("n_links"), F.char_length(F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)).cast("long").alias("article_chars"),
    )
