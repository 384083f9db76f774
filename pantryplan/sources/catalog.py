"""Sources and sinks: item snapshots, catalogs, side-cars, merges and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pantryplan.functions.stock import UNVERIFIED, classify
from pantryplan.functions.units import is_liquid, parse_package_size, price_to_cents

# The columns of a raw item file, all text.
ITEM_COLUMNS = (
    "scraped_at", "category", "subcategory", "item_id", "item_name", "expires_soon", "best_by", "price", "price_usd", "original_price", "original_price_usd", "discount", "unit_size", "unit_price",
    "stock_status", "recently_sold", "snap", "rating", "rating_count", "image_url",
)
ITEM_SCHEMA = StructType([StructField(c, StringType()) for c in ITEM_COLUMNS])


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item files in folders ``store_id=<id>``; what a file lacks is blank."""
    rows = spark.read.schema(f"{ITEM_SCHEMA.simpleString()[7:-1].replace(':', ' ')}, store_id long").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select("store_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ITEM_COLUMNS))


def write_items(rows: DataFrame, path: str) -> None:
    """Item files of each store: all ITEM_COLUMNS in their order, missing ones blank."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    out = rows.select("store_id", *(value(c).alias(c) for c in ITEM_COLUMNS))
    out.write.mode("overwrite").partitionBy("store_id").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


# Fixed value: why a weight is doubted.
LITERAL_OUNCES = "bare 'oz' on a likely-liquid product -- parsed as weight per the documented literal rule, but this may actually be a beverage sold in fluid ounces; not auto-converted, needs human review"


def build_rows(items: DataFrame) -> DataFrame:
    """The twenty columns of a normalised catalog from item rows with store_id, store_name and snapshot_id; brand and variant are found later, by title.

    Sizes are parsed once for each distinct text.
    """
    texts = items.select(F.coalesce("unit_size", F.lit("")).alias("raw_size")).distinct()
    parsed = texts.select("raw_size", parse_package_size(F.col("raw_size")).alias("s")).groupBy("raw_size").agg(F.first("s").alias("s"))
    rows = items.withColumn("raw_size", F.coalesce("unit_size", F.lit(""))).join(parsed, "raw_size")
    flag = (F.col("s.dimension") == "weight") & (F.col("s.unit") == "oz") & ~F.col("s.unresolved") & is_liquid(F.col("item_name"), F.col("category"))
    flag = F.coalesce(flag, F.lit(False))
    status = F.when(~F.col("s.unresolved"), "resolved").when(F.col("s.variable_weight"), "variable_weight").otherwise("unresolved")
    none = F.lit(None).cast("string")
    return rows.select(
        "store_id", "store_name", "snapshot_id", F.col("item_id").alias("product_id"), F.col("item_name").alias("raw_title"), F.col("category").alias("raw_category"), "raw_size", price_to_cents(F.col("price_usd")).alias("price_cents"), none.alias("brand"), none.alias("variant"),
        F.col("s.dimension").alias("pkg_dimension"), F.col("s.pack_count").alias("pkg_count"), F.col("s.amount_per_pack").alias("pkg_amount_per_pack"), F.col("s.unit").alias("pkg_unit"), F.col("s.canonical_unit").alias("pkg_canonical_unit"), F.col("s.canonical_total").alias("pkg_canonical_total"),
        status.alias("parsing_status"), F.col("s.reason").alias("parsing_reason"), flag.alias("dimension_review_flag"), F.when(flag, LITERAL_OUNCES).alias("dimension_review_reason"),
    )


def latest_snapshot(rows: DataFrame, at: str, by: list[str] | None = None) -> DataFrame:
    """Rows of the greatest snapshot of the table, or of each store in ``by``; an item that is gone from it isn't brought back."""
    last = rows.groupBy(*(by or [])).agg(F.max(at).alias(at))
    return rows.join(F.broadcast(last) if not by else last, [*(by or []), at], "left_semi")


def latest_run(spark: SparkSession, path: str, column: str = "run") -> DataFrame:
    """Parquet rows of the greatest run folder (``run=<name>/``); only that folder's files are read."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max(column)).first()[0]
    return rows.where(F.col(column).eqNullSafe(F.lit(last)))


def merge_items(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row an item: of each column the first value that isn't blank."""
    first = [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*first)


def overlay(items: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Items whose details, where they aren't blank, replace what the item pages said."""
    found = details.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    new = {c: F.coalesce(F.nullif(f"__{c}", F.lit("")), F.col(c)) for c in columns}
    return items.join(found, key, "left").withColumns(new).drop(*(f"__{c}" for c in columns))


def latest_image(rows: DataFrame) -> DataFrame:
    """The image of an item's newest row that has one."""
    return rows.where("image_url <> ''").groupBy("store_id", "item_id").agg(F.max_by("image_url", F.struct("scraped_at", "image_url")).alias("image_url"))


def join_stock(catalog: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Stock state of catalog rows by (snapshot_id, product); the last event of a pair counts, none is unverified."""
    last = snapshots.groupBy("snapshot_id", F.col("item_id").alias("product_id")).agg(F.max_by("stock_status", "event_id").alias("stock_status"))
    out = catalog.join(last, ["snapshot_id", "product_id"], "left").withColumn("c", classify(F.col("stock_status")))
    return out.select(*catalog.columns, F.coalesce("c.state", F.lit(UNVERIFIED)).alias("state"), F.col("c.remaining").alias("remaining"), F.col("c.is_lower_bound").alias("is_lower_bound"), F.col("stock_status").isNotNull().alias("joined"))


def complete_groups(rows: DataFrame, by: str, key: str, size: int = 10) -> DataFrame:
    """Of each group that has ``size`` distinct keys the rows of the first ``size``; of rows with one key any one."""
    seen = rows.dropDuplicates([by, key])
    # the rank is limited before rows are shuffled, so a large group sends ``size`` rows a task
    first = seen.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(key))).where(F.col("place") <= size)
    whole = first.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") == size).select(by)
    return first.drop("place").join(whole, by, "left_semi")


def coverage(items: DataFrame) -> DataFrame:
    """Counts of a store's items: unique, doubled, blank, categories, price range."""
    blank = lambda c: F.count(F.when(F.coalesce(F.col(c), F.lit("")) == "", 1)).alias(f"blank_{c}")
    return items.groupBy("store_id").agg(F.count("*").alias("n_rows"), F.countDistinct("product_id").alias("n_items"), F.countDistinct("raw_category").alias("n_categories"), blank("raw_size"), F.min("price_cents").alias("min_cents"), F.max("price_cents").alias("max_cents"))


def store_coverage(items: DataFrame, top: int = 5) -> DataFrame:
    """A store's items: all, unique and repeated ids, blank names, prices and sizes, categories, the ``top`` largest of them (of equals the first by name), and the range of prices."""
    blank = lambda c: F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    price = F.col("price_usd").try_cast("double")
    out = items.groupBy("store_id").agg(
        F.count("*").alias("products_total"), F.countDistinct("item_id").alias("unique_product_ids"), blank("item_name").alias("missing_name"), blank("price_usd").alias("missing_price"), blank("unit_size").alias("missing_unit_size"),
        F.round(F.min(price), 2).alias("min_price"), F.round(F.max(price), 2).alias("max_price"),
    )
    kinds = items.groupBy("store_id", F.coalesce("category", F.lit("")).alias("category")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("store_id").orderBy(F.desc("n"), "category"))
    first = kinds.withColumn("place", place).where(F.col("place") <= top).groupBy("store_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "category", "n"))), lambda x: F.concat(x["category"], F.lit(":"), x["n"].cast("string"))), ", ").alias("top_categories"))
    counts = kinds.groupBy("store_id").agg(F.count("*").alias("category_count"))
    return out.withColumn("duplicate_ids", F.col("products_total") - F.col("unique_product_ids")).join(counts, "store_id").join(first, "store_id")


#: Rows of a report that are gathered as one text.
REPORT_ROWS = 1000


def markdown(df: DataFrame) -> str:
    """A report table of up to ``REPORT_ROWS`` rows as Markdown; more rows are refused, not cut."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has more than {REPORT_ROWS} rows; write it with a file sink")
    line = lambda values: "| " + " | ".join("" if v is None else str(v) for v in values) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *map(line, rows)])
