"""Deterministic views over the driver's tables that stand in for a grocery catalog.

The texts run on Spark and DuckDB alike; they are inputs, not operators.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryplan.operators.retrieval import small, tasks_for

CATALOG = """
SELECT CAST(r.r_regionkey AS BIGINT) AS store_id, r.r_name AS store_name, CAST(p.p_partkey AS STRING) AS product_id,
       concat(p.p_name, ' ', replace(p.p_brand, '#', ''), ' ', lower(p.p_type)) AS raw_title, p.p_type AS raw_category,
       CASE WHEN p.p_partkey % 16 <= 5 THEN concat(CAST(p.p_size AS STRING), ' oz')
            WHEN p.p_partkey % 16 = 6 THEN concat(CAST(p.p_size AS STRING), ' lb')
            WHEN p.p_partkey % 16 = 7 THEN concat(CAST(p.p_size AS STRING), ' fl oz')
            WHEN p.p_partkey % 16 = 8 THEN concat(CAST(p.p_size AS STRING), ' fl oz x 12 ct')
            WHEN p.p_partkey % 16 = 9 THEN '1/2 gal'
            WHEN p.p_partkey % 16 = 10 THEN concat(CAST(p.p_size AS STRING), ' ct')
            WHEN p.p_partkey % 16 = 11 THEN '$5.49/lb'
            WHEN p.p_partkey % 16 = 12 THEN ''
            WHEN p.p_partkey % 16 = 13 THEN 'XL'
            WHEN p.p_partkey % 16 = 14 THEN 'bunch'
            ELSE concat(CAST(p.p_size AS STRING), ' g') END AS raw_size,
       CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) * 100 AS BIGINT) + r.r_regionkey * ((p.p_partkey % 13) - 6) AS price_cents
FROM {part} p CROSS JOIN {region} r
WHERE (p.p_partkey * 7 + r.r_regionkey * 3) % 10 < 8
  AND NOT (r.r_regionkey >= 3 AND (ascii(p.p_name) % 5 = r.r_regionkey OR length(split_part(p.p_name, ' ', 2)) = r.r_regionkey + 2))
"""
LINES = """
SELECT l.l_orderkey AS list_id, CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS INT) AS pos,
       concat(CAST(CAST(l.l_quantity AS INT) AS STRING),
       CASE WHEN l.l_partkey % 7 = 0 THEN ' bags of ' WHEN l.l_partkey % 7 = 1 THEN ' fl oz ' WHEN l.l_partkey % 7 = 2 THEN ' lb '
            WHEN l.l_partkey % 7 = 3 THEN ' ' ELSE ' oz ' END, p.p_name) AS text,
       CASE WHEN l.l_orderkey % 2 = 0 THEN 'flexible' ELSE 'exact' END AS matching_mode
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
"""
STOCK = """
SELECT CAST(user_id AS STRING) AS item_id, event_id, CAST(CAST(ts AS DATE) AS STRING) AS snapshot_id,
       CASE event_type WHEN 'purchase' THEN 'Many in stock' WHEN 'error' THEN 'Out of stock' WHEN 'click' THEN concat('In stock (', CAST(event_id % 9 + 1 AS STRING), ')')
                       WHEN 'signup' THEN 'In stock (20+)' ELSE '' END AS stock_status
FROM {events}
"""
#: The requests are every row whose id is divisible by 50, held against all rows.
REQUESTS = """
SELECT vec_id AS request_id, label, CASE WHEN CAST(vec_id / 50 AS BIGINT) % 10 = 0 THEN 'needs_clarification' WHEN CAST(vec_id / 50 AS BIGINT) % 10 = 1 THEN 'no_acceptable_match' ELSE 'answerable' END AS truth,
       CASE WHEN CAST(vec_id / 50 AS BIGINT) % 3 = 0 THEN 'exact' ELSE 'flexible' END AS matching_mode,
       CASE WHEN CAST(vec_id / 50 AS BIGINT) % 7 <= 3 THEN 'dev' WHEN CAST(vec_id / 50 AS BIGINT) % 7 <= 5 THEN 'validation' ELSE 'test' END AS split
FROM {embeddings} WHERE vec_id % 50 = 0
"""
LABELS = """
SELECT q.vec_id AS request_id, d.vec_id AS product_id,
       CASE WHEN q.label = d.label THEN 'Acceptable' WHEN abs(q.label - d.label) = 1 AND d.vec_id % 2 = 0 THEN 'Acceptable' ELSE 'Incorrect' END AS practical_label,
       CASE WHEN q.label = d.label THEN 'Acceptable' WHEN abs(q.label - d.label) = 1 AND d.vec_id % 2 = 0 THEN 'Needs clarification' ELSE 'Incorrect' END AS conservative_label
FROM {embeddings} q JOIN {embeddings} d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
"""
#: Written requests for products, in six forms: every part whose key is divisible by 50.
ASKS = """
SELECT p_partkey AS request_id, CAST(p_partkey / 50 AS BIGINT) % 6 AS form, p_size, lower(p_name) AS words,
       CASE WHEN CAST(p_partkey / 50 AS BIGINT) % 3 = 0 THEN 'exact' ELSE 'flexible' END AS mode,
       concat(CASE CAST(p_partkey / 50 AS BIGINT) % 6 WHEN 0 THEN concat(CAST(p_size AS STRING), ' oz ') WHEN 1 THEN concat(CAST(p_size AS STRING), ' fl oz ') WHEN 2 THEN '2 '
              WHEN 3 THEN '3 bags of ' WHEN 4 THEN concat(CAST(p_size AS STRING), ' lb ') ELSE concat(CAST(p_size AS STRING), ' ct ') END, p_name) AS text
FROM {part} WHERE p_partkey % 50 = 0
"""
#: Stored records with what is known of their first result.
JUDGED = """
SELECT r.*, CASE WHEN request_id % 17 = 3 THEN NULL WHEN is_ok THEN 'Acceptable' WHEN request_id % 4 = 0 THEN 'Needs clarification' ELSE 'Incorrect' END AS conservative_label,
       CASE WHEN request_id % 17 = 3 THEN NULL WHEN is_ok OR request_id % 4 = 0 THEN 'Acceptable' ELSE 'Incorrect' END AS practical_label, request_id % 6 = 1 AS is_best_guess,
       CASE WHEN request_id % 4 = 1 THEN 'confirmed' WHEN request_id % 4 = 2 THEN 'confirmed by construction' WHEN request_id % 4 = 3 THEN 'tentative' END AS confidence
FROM ({RECORDS}) r
"""
#: Stored runs of a matcher, one best score a request: an input of the sweeps.
RECORDS = """
SELECT q.vec_id AS request_id, CASE WHEN q.vec_id % 7 <= 3 THEN 'dev' WHEN q.vec_id % 7 <= 5 THEN 'validation' ELSE 'test' END AS split,
       CASE WHEN q.vec_id % 3 = 0 THEN 'exact' ELSE 'flexible' END AS matching_mode, CASE WHEN q.vec_id % 2 = 0 THEN 'lexical' ELSE 'vectors' END AS baseline,
       CASE WHEN q.vec_id % 10 = 0 THEN 'needs_clarification' WHEN q.vec_id % 10 = 1 THEN 'no_acceptable_match' ELSE 'answerable' END AS truth,
       CASE WHEN q.vec_id % 11 = 0 THEN NULL ELSE CAST((q.vec_id * 37) % 101 AS DOUBLE) / 100 END AS score,
       CASE WHEN q.vec_id % 11 = 0 THEN 'no_acceptable_match' WHEN q.vec_id % 13 = 0 THEN 'needs_clarification' ELSE 'answerable' END AS response,
       (q.vec_id * 37) % 5 < 3 AS is_ok, q.vec_id % 10 > 1 AS answerable, (q.vec_id * 7919) % 1000 AS elapsed_ms
FROM {embeddings} q
"""
JUDGED = JUDGED.replace("{RECORDS}", RECORDS)
#: Raw fields of item cards, forty parts to a page; chr(92) is a backslash.
CARDS = """
SELECT p_partkey AS pid, CAST(floor(p_partkey / 40) AS BIGINT) AS page_id, CAST(p_partkey AS STRING) AS item_id,
       concat(CASE WHEN p_partkey % 7 = 0 THEN 'Expires Soon ' ELSE '' END, p_name, CASE p_partkey % 5 WHEN 0 THEN concat(' ', chr(92), 'u0026 Co') WHEN 1 THEN concat(' ', chr(92), '"Best', chr(92), '"') WHEN 2 THEN ' (12 oz)' WHEN 3 THEN ' (bunch)' ELSE '' END) AS item_name,
       CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('$', CAST(p_size AS STRING), '.49') END AS price_display,
       CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat(CAST(p_size AS STRING), '49') END AS unit_amount,
       CASE p_partkey % 8 WHEN 0 THEN concat('$', CAST(p_size AS STRING), '.25 on sale from $', CAST(p_size + 1 AS STRING), '.5') WHEN 4 THEN concat('$', CAST(p_size AS STRING), '.25') WHEN 5 THEN 'from $3' ELSE '' END AS item_price,
       CASE WHEN p_partkey % 6 = 0 THEN concat(CAST(p_size + 2 AS STRING), '00') ELSE '' END AS non_discount,
       CASE p_partkey % 9 WHEN 0 THEN '16 oz' WHEN 1 THEN '12 oz • $0.30/oz' WHEN 2 THEN '0 oz' ELSE '' END AS sold_as,
       CASE WHEN p_partkey % 3 = 1 THEN 'average rating of 4.5 stars, 1.2k' ELSE '' END AS rating_text,
       CASE WHEN p_partkey % 10 = 4 THEN CAST(p_partkey % 30 AS STRING) ELSE '' END AS item_limit,
       CASE p_partkey % 5 WHEN 0 THEN '25% off' WHEN 1 THEN '3 in stock' WHEN 2 THEN '1.2k+ recently sold' WHEN 3 THEN 'Out of stock' ELSE '' END AS badge1,
       CASE p_partkey % 7 WHEN 1 THEN 'SNAP' WHEN 2 THEN '20+ in stock' WHEN 3 THEN ' snap ' WHEN 4 THEN '0 in stock' ELSE '' END AS badge2,
       CASE p_partkey % 11 WHEN 0 THEN 'Best by 9/30' WHEN 1 THEN '10% OFF today' ELSE '' END AS label_badge,
       concat('https:', chr(92), '/', chr(92), '/cdn.example.com/fit=contain,width=1200,height=672/', CAST(p_partkey AS STRING), '.jpg') AS image
FROM {part}
"""
#: What a request expects, and the products that can be held against it.
WISHES = """
SELECT a.request_id, a.form, a.text, a.words, a.p_size, split_part(a.words, ' ', 2) AS noun, CASE WHEN a.request_id % 3 = 0 THEN replace(p.p_brand, '#', '') END AS brand,
       CASE CAST(a.request_id / 50 AS BIGINT) % 5 WHEN 0 THEN 'Large, any' WHEN 1 THEN 'Extra Large' WHEN 2 THEN 'Small' WHEN 3 THEN 'ECONOMY pack' END AS variant,
       CASE a.form WHEN 0 THEN concat(CAST(a.p_size AS STRING), ' oz') WHEN 1 THEN concat(CAST(a.p_size AS STRING), ' fl oz') WHEN 4 THEN concat(CAST(a.p_size AS STRING), ' lb') WHEN 5 THEN concat(CAST(a.p_size AS STRING), ' ct') END AS size_text,
       CAST(a.request_id / 50 AS BIGINT) % 7 = 3 AS any_size, CAST(a.request_id / 50 AS BIGINT) % 7 = 4 AS any_brand, CAST(a.request_id / 50 AS BIGINT) % 7 = 5 AS any_variant
FROM ({ASKS}) a JOIN {part} p ON p.p_partkey = a.request_id
"""
OFFERS = """
SELECT p_partkey % 5 AS store_id, CAST(p_partkey AS STRING) AS product_id, p_partkey AS pid, p_size, split_part(lower(p_name), ' ', 2) AS noun,
       concat(p_name, CASE WHEN p_partkey % 17 = 0 THEN 's ' ELSE ' ' END, replace(p_brand, '#', ''), ' ', lower(p_type), CASE p_partkey % 13 WHEN 0 THEN ' Extra Large' WHEN 1 THEN ' economy pack' WHEN 2 THEN ' medium roast' ELSE '' END) AS raw_title,
       CASE p_partkey % 6 WHEN 0 THEN concat(CAST(p_size AS STRING), ' oz') WHEN 1 THEN concat(CAST(p_size AS STRING), '.2 oz') WHEN 2 THEN concat(CAST(p_size AS STRING), ' lb') WHEN 3 THEN concat(CAST(p_size AS STRING), ' fl oz') WHEN 4 THEN '0.5 kg' ELSE 'bunch' END AS raw_size,
       p_partkey % 23 = 0 AS dimension_review
FROM {part}
"""
WISHES = WISHES.replace("{ASKS}", ASKS)
#: A log of decisions on documents: who decided what, and photos seen later; a third of it is on one key.
DECISIONS = """
SELECT CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id % 97 END AS request_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 11 AS STRING) END AS product_id, event_id AS seq,
       CASE WHEN event_id % 3 = 0 AND event_id > 9 THEN 'photo' WHEN event_id % 7 = 0 THEN 'decide' WHEN event_id % 5 IN (0, 1) THEN 'photo' WHEN event_id % 41 = 2 THEN 'guess' ELSE 'seed' END AS kind,
       CASE WHEN event_id % 4 < 2 THEN 'Needs clarification' WHEN event_id % 4 = 2 THEN 'Acceptable' WHEN event_id % 37 = 3 THEN 'Maybe' ELSE 'Incorrect' END AS label, event_id % 8 = 2 AS guess, event_type AS by
FROM {events}
"""
#: A labelled benchmark with faults of every kind that its validation looks for.
BENCH_REQUESTS = """
SELECT vec_id AS request_id, CAST(vec_id / 50 AS BIGINT) % 23 AS paraphrase_group, CASE CAST(vec_id / 50 AS BIGINT) % 5 WHEN 0 THEN 'no_acceptable_match' WHEN 1 THEN 'needs_clarification' ELSE 'answerable' END AS answerability,
       CASE WHEN vec_id % 3 = 0 THEN 'exact' ELSE 'flexible' END AS matching_mode, md5(concat('request ', CAST(vec_id AS STRING))) AS content_sha256, label, vec_id % 150 = 0 AS is_pilot
FROM {embeddings} WHERE vec_id % 50 = 0
UNION ALL SELECT vec_id, CAST(vec_id / 50 AS BIGINT) % 23, 'answerable', 'flexible', md5(concat('request ', CAST(vec_id AS STRING))), label, vec_id % 150 = 0 FROM {embeddings} WHERE vec_id % 50 = 0 AND vec_id % 350 = 0
"""
BENCH_CATALOG = """
SELECT vec_id % 5 AS store_id, CAST(vec_id AS STRING) AS product_id FROM {embeddings} WHERE vec_id % 31 <> 3
UNION ALL SELECT vec_id % 5, CAST(vec_id AS STRING) FROM {embeddings} WHERE vec_id % 101 = 7
"""
BENCH_POOL = """
SELECT q.vec_id AS request_id, d.vec_id % 5 AS store_id, CAST(d.vec_id AS STRING) AS product_id, d.vec_id AS pid FROM {embeddings} q JOIN {embeddings} d ON q.label = d.label WHERE q.vec_id % 50 = 0
UNION ALL SELECT q.vec_id, d.vec_id % 5, CAST(d.vec_id AS STRING), d.vec_id FROM {embeddings} q JOIN {embeddings} d ON q.label = d.label WHERE q.vec_id % 50 = 0 AND d.vec_id % 97 = 5
"""
BENCH_DECISIONS = """
SELECT q.vec_id AS request_id, d.vec_id % 5 AS store_id, CASE WHEN d.vec_id % 53 = 9 THEN concat('old', CAST(d.vec_id AS STRING)) ELSE CAST(d.vec_id AS STRING) END AS product_id,
       CASE WHEN d.vec_id % 61 = 2 THEN 'Maybe' WHEN d.vec_id % 67 = 1 THEN NULL WHEN CAST(q.vec_id / 50 AS BIGINT) % 6 = 1 THEN 'Incorrect' WHEN d.vec_id % 3 = 0 THEN 'Acceptable' WHEN d.vec_id % 3 = 1 THEN 'Needs clarification' ELSE 'Incorrect' END AS reviewer_label,
       CASE WHEN d.vec_id % 8 = 0 THEN 'Incorrect' WHEN d.vec_id % 8 = 1 THEN '' END AS conservative_label, CASE WHEN d.vec_id % 4 = 0 THEN true WHEN d.vec_id % 4 = 1 THEN d.vec_id % 16 = 1 END AS is_best_guess,
       CASE WHEN d.vec_id % 71 = 3 THEN 'c0' ELSE 'c1' END AS catalog_version_sha256, CASE WHEN d.vec_id % 73 = 3 THEN NULL ELSE 'r1' END AS request_version, CASE WHEN d.vec_id % 79 = 3 THEN 'g0' ELSE 'g1' END AS labeling_guideline_version,
       md5(concat('request ', CAST(CASE WHEN q.vec_id % 250 = 100 THEN 0 ELSE q.vec_id END AS STRING))) AS request_content_sha256
FROM {embeddings} q JOIN {embeddings} d ON q.label = d.label WHERE q.vec_id % 50 = 0 AND d.vec_id % 29 <> 4
"""
VIEWS = {"bench_requests": BENCH_REQUESTS, "bench_catalog": BENCH_CATALOG, "bench_pool": BENCH_POOL, "bench_decisions": BENCH_DECISIONS, "wishes": WISHES, "offers": OFFERS, "decisions": DECISIONS, "cards": CARDS, "catalog": CATALOG, "lines": LINES, "stock": STOCK, "requests": REQUESTS, "labels": LABELS, "records": RECORDS, "asks": ASKS, "judged": JUDGED}


#: Small tables that a view makes many rows of: dealt over the session's tasks first, since a small file is read by one.
SPREAD = {"catalog": ("part", "p_partkey")}
#: Views of all pairs of a request and the rows of its label: requests go to every task, and there are as many tasks as the pairs take.
PAIRED = ("bench_pool", "bench_decisions")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    if name in SPREAD:
        table, key = SPREAD[name]
        tables[table] = tables[table].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    if name in PAIRED:
        rows = tables["embeddings"].select("vec_id", "label")
        asked = F.col("vec_id") % 50 == 0
        pairs = rows.groupBy("label").agg((F.count("*") * F.count_if(asked)).alias("n")).agg(F.sum("n")).first()[0]
        tables |= {"embeddings": rows.repartition(tasks_for(spark, pairs or 0), "vec_id"), "asked": small(rows.where(asked))}
        sql = sql.replace("{embeddings} q", "{asked} q")
    return spark.sql(sql, **tables)


def oracle(*names: str) -> str:
    """Common table expressions of the views for DuckDB: ``fx_<name>``."""
    return ", ".join(f"fx_{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names)
