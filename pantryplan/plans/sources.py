"""Queries of item files, coverage, samples and streams, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantryplan.functions import lineparse, payload, stock, units
from pantryplan.plans.extraction import FIELDS_SQL, MOSAIC_SQL, mosaics
from pantryplan.plans.fixtures import oracle, view
from pantryplan.plans.queries import ORACLE, SIZE_SQL, STOCK_SQL, parse_distinct, query, read, stripped
from pantryplan.sources import catalog as source
from pantryplan.sources.settle import shared_folder
from pantryplan.streaming import snapshots

CARD_SQL = f"""{oracle('cards')}, raw AS (SELECT *, 0 AS item_no, coalesce(list_filter([badge1, badge2, label_badge], lambda x: contains(lower(x), 'in stock'))[1], '') AS badge FROM fx_cards), {FIELDS_SQL},
items AS (SELECT CAST(item_id AS BIGINT) % 5 AS store_id, CASE WHEN CAST(item_id AS BIGINT) % 9 = 0 THEN '' ELSE concat('aisle ', CAST(item_id AS BIGINT) % 9) END AS category, * EXCLUDE (page_id, item_no) FROM fields)"""


def items(spark, sf_dir) -> DataFrame:
    """The cards' items, written as files of their stores and read back."""
    cards = view(spark, sf_dir, "cards").withColumn("badge_texts", F.filter(F.array("badge1", "badge2", "label_badge"), lambda b: b != ""))
    badge = F.coalesce(F.get(F.filter("badge_texts", lambda b: F.contains(F.lower(b), F.lit("in stock"))), 0), F.lit(""))
    rows = payload.normalised(cards.withColumn("badge", badge).select(*payload.RAW))
    k, folder = F.col("item_id").cast("long"), shared_folder(spark, "items")
    source.write_items(rows.withColumns({"store_id": k % 5, "category": F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("aisle "), (k % 9).cast("string"))), "scraped_at": F.lit("2026-01-01T00:00:00Z")}), folder)
    return source.read_items(spark, folder)


@query(f"""WITH {CARD_SQL} SELECT *, '2026-01-01T00:00:00Z' AS scraped_at, '' AS subcategory FROM items""")
def item_files(spark, sf_dir):
    return items(spark, sf_dir)


@query(f"""WITH {CARD_SQL}, r AS (SELECT *, TRY_CAST(price_usd AS DOUBLE) AS p FROM (SELECT * FROM items UNION ALL SELECT * FROM items WHERE CAST(item_id AS BIGINT) % 20 = 3)),
k AS (SELECT store_id, category, count(*) AS n, row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, category) AS place FROM r GROUP BY 1, 2)
SELECT store_id, count(*) AS products_total, count(DISTINCT item_id) AS unique_product_ids, count(*) - count(DISTINCT item_id) AS duplicate_ids, count(CASE WHEN trim(item_name) = '' THEN 1 END) AS missing_name, count(CASE WHEN price_usd = '' THEN 1 END) AS missing_price, count(CASE WHEN unit_size = '' THEN 1 END) AS missing_unit_size,
round(min(p), 2) AS min_price, round(max(p), 2) AS max_price, (SELECT count(*) FROM k WHERE k.store_id = r.store_id) AS category_count, (SELECT string_agg(concat(category, ':', n), ', ' ORDER BY place) FROM k WHERE k.store_id = r.store_id AND place <= 5) AS top_categories FROM r GROUP BY store_id""")
def store_coverage(spark, sf_dir):
    rows = items(spark, sf_dir)
    return source.store_coverage(rows.unionByName(rows.where("cast(item_id as long) % 20 = 3")))


@query("""SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS run FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""")
def latest_run_rows(spark, sf_dir):
    """Rows of the greatest run's folder, of which alone files are read."""
    folder = shared_folder(spark, "runs")
    read(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").cast("string").alias("run")).write.partitionBy("run").parquet(folder)
    return source.latest_run(spark, folder).withColumn("run", F.col("run").cast("string"))


DETAIL_SQL = ORACLE["item_details"].removeprefix(f"WITH {MOSAIC_SQL}, ")


@query(f"""WITH {CARD_SQL}, {MOSAIC_SQL}, det AS (WITH {DETAIL_SQL}) SELECT i.item_id, coalesce(nullif(d.unit_size, ''), i.unit_size) AS unit_size, coalesce(nullif(d.unit_price, ''), i.unit_price) AS unit_price, coalesce(nullif(d.original_price, ''), i.original_price) AS original_price, coalesce(nullif(d.original_price_usd, ''), i.original_price_usd) AS original_price_usd
FROM items i LEFT JOIN det d ON CAST(d.pid AS VARCHAR) = i.item_id""")
def item_details_overlay(spark, sf_dir):
    details = mosaics(spark, sf_dir).select(F.col("pid").cast("string").alias("item_id"), payload.item_details(F.col("doc")).alias("d")).select("item_id", "d.*")
    columns = ["unit_size", "unit_price", "original_price", "original_price_usd"]
    return source.overlay(items(spark, sf_dir), details, "item_id", columns).select("item_id", *columns)


@query("""SELECT user_id % 5 AS store_id, CAST(user_id % 211 AS VARCHAR) AS item_id, arg_max(concat('https://i/', event_id, '.jpg'), event_id) AS image_url FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2""")
def latest_images(spark, sf_dir):
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("store_id"), (F.col("user_id") % 211).cast("string").alias("item_id"), k.alias("scraped_at"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("https://i/"), k.cast("string"), F.lit(".jpg"))).alias("image_url"))
    return source.latest_image(rows)


@query("""WITH d AS (SELECT DISTINCT user_id AS store_id, event_type AS item_id, CAST(ts AS DATE) AS day FROM events), p AS (SELECT store_id, concat(day, item_id) AS product FROM d),
q AS (SELECT DISTINCT * FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY product) AS place, count(*) OVER (PARTITION BY store_id) AS n FROM q) SELECT store_id, product FROM r WHERE n >= 10 AND place <= 10""")
def nearby_samples(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("store_id"), F.concat(F.to_date("ts").cast("string"), "event_type").alias("product"))
    return source.complete_groups(rows, "store_id", "product")


BUILD = """SELECT c.*, CASE WHEN CAST(product_id AS BIGINT) % 4 = 0 THEN concat(raw_title, ' milk') WHEN CAST(product_id AS BIGINT) % 4 = 1 THEN concat(raw_title, ' dry milk') ELSE raw_title END AS title, CASE WHEN CAST(product_id AS BIGINT) % 10 = 3 THEN 'Drinks' ELSE raw_category END AS kind FROM {c} c"""


@query(f"""WITH {oracle('catalog')}, {SIZE_SQL}, t AS ({BUILD.format(c='sizes')}), f AS (SELECT *, coalesce(dimension = 'weight' AND unit = 'oz' AND reason IS NULL AND (kind = 'Drinks' OR CAST(product_id AS BIGINT) % 4 = 0), false) AS flag FROM t)
SELECT store_id, r_name AS store_name, '2026-01-01' AS snapshot_id, product_id, title AS raw_title, kind AS raw_category, raw_size, price_cents, NULL AS brand, NULL AS variant, dimension AS pkg_dimension, pack_count AS pkg_count, amount_per_pack AS pkg_amount_per_pack, unit AS pkg_unit, canonical_unit AS pkg_canonical_unit,
canonical_total AS pkg_canonical_total, CASE WHEN variable_weight THEN 'variable_weight' WHEN unresolved THEN 'unresolved' ELSE 'resolved' END AS parsing_status, reason AS parsing_reason, flag AS dimension_review_flag, CASE WHEN flag THEN '{source.LITERAL_OUNCES.replace("'", "''")}' END AS dimension_review_reason FROM f JOIN region ON r_regionkey = store_id""")
def catalog_rows(spark, sf_dir):
    rows = spark.sql(BUILD, c=view(spark, sf_dir, "catalog"))
    cents = F.col("price_cents").cast("decimal(18,2)") / 100
    return source.build_rows(rows.select("store_id", "store_name", F.lit("2026-01-01").alias("snapshot_id"), F.col("product_id").alias("item_id"), F.col("title").alias("item_name"), F.col("kind").alias("category"), F.col("raw_size").alias("unit_size"), cents.cast("decimal(18,2)").cast("string").alias("price_usd")))


@query(f"""WITH {oracle('stock')}, s AS (SELECT event_id, event_id % 12 + 1 AS packages, {STOCK_SQL} AS state, CASE WHEN stock_status = 'Out of stock' THEN 0 ELSE try_cast(regexp_extract(stock_status, '([0-9]+)', 1) AS INT) END AS remaining, stock_status LIKE '%+)' AS lower_bound FROM fx_stock)
SELECT event_id, packages, NOT (state = 'out_of_stock' OR coalesce(state = 'in_stock' AND NOT lower_bound AND remaining < packages, false)) AS covers, state <> 'unverified' AS verified FROM s""")
def stock_covers(spark, sf_dir):
    s, packages = stock.classify(F.col("stock_status")), F.col("event_id") % 12 + 1
    return view(spark, sf_dir, "stock").select("event_id", packages.alias("packages"), stock.covers(s["state"], s["remaining"], s["is_lower_bound"], packages).alias("covers"), (s["state"] != stock.UNVERIFIED).alias("verified"))


@query(f"""WITH {oracle('asks')} SELECT request_id, trim(concat(array_to_string(list_filter([{', '.join(f"'{m}'" for m in units.MODIFIERS)}], lambda m: contains(concat(' ', words, ' '), concat(' ', m, ' '))), ' '), ' ', {stripped('words')})) AS query FROM fx_asks""")
def pool_query_text(spark, sf_dir):
    parsed = parse_distinct(view(spark, sf_dir, "asks").select("request_id", "text"), "text", lineparse.parse_lines)
    return parsed.select("request_id", lineparse.pool_query(F.col("text"), F.col("parsed")).alias("query"))


@query(f"""WITH {oracle('stock')}, n AS (SELECT item_id, arg_max(snapshot_id, (snapshot_id, event_id)) AS snapshot_id, arg_max(stock_status, (snapshot_id, event_id)) AS stock_status FROM fx_stock GROUP BY 1)
SELECT item_id, snapshot_id, {STOCK_SQL} AS state, CASE WHEN stock_status = 'Out of stock' THEN 0 ELSE try_cast(regexp_extract(stock_status, '([0-9]+)', 1) AS INT) END AS remaining, stock_status LIKE '%+)' AS is_lower_bound FROM n WHERE snapshot_id = (SELECT max(snapshot_id) FROM n)""")
def streamed_snapshot(spark, sf_dir):
    """Snapshots that arrive as two lots of files, kept up by a stream that is stopped in between."""
    base, rows = shared_folder(spark, "stream"), view(spark, sf_dir, "stock").select("item_id", F.col("event_id").cast("long").alias("event_id"), "snapshot_id", "stock_status")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        rows.where(part).write.mode("append").parquet(f"{base}/files")
        snapshots.keep_up(spark, f"{base}/files", f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return snapshots.current(snapshots.kept_states(spark, f"{base}/table"))
