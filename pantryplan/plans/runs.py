"""Queries of prediction runs, selections, growing files and keys, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantryplan.operators import basket, gates, policies, retrieval, runners
from pantryplan.plans.fixtures import oracle, view
from pantryplan.plans.policies import BASE_SQL, FLOOR_HYBRID, FLOOR_LEXICAL, VECTORS_SQL, _conflict, _tfidf, lexical_index, lexical_scores, lexical_search, sides, vector_search
from pantryplan.plans.queries import CANDIDATE_SQL, candidates, query, read, stores
from pantryplan.sources import derived
from pantryplan.sources.settle import settled, shared_folder

#: baseline, search, gates by dimension, size and identity, floor.
BASELINES = [
    ("lexical", "lexical", False, False, False, FLOOR_LEXICAL), ("lexical_dimension", "lexical", True, False, False, FLOOR_LEXICAL), ("lexical_size", "lexical", True, True, False, 0.0), ("lexical_identity", "lexical", True, True, True, 0.0),
    ("vectors", "vectors", False, False, False, 0.0), ("vectors_size", "vectors", True, True, False, 0.0), ("hybrid_size", "hybrid", True, True, False, FLOOR_HYBRID), ("hybrid_identity", "hybrid", True, True, True, 0.0),
]
POOL = 10
KNOWN = "a.brand IS NOT NULL AND p.brand_ IS NOT NULL"
RECORDS_SQL = f"""{BASE_SQL}, {_tfidf('asked_', 'request_id', policies.HYBRID_DEPTH)}, {VECTORS_SQL.format(depth=policies.HYBRID_DEPTH)},
pool AS (SELECT request_id, store_id, product_id FROM lx WHERE rank <= {POOL} UNION SELECT request_id, store_id, product_id FROM vx WHERE rank <= {POOL}),
pl AS (SELECT request_id, store_id, product_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY request_id ORDER BY coalesce(score, 0) DESC, store_id, product_id) AS rank FROM pool JOIN prod USING (store_id, product_id) LEFT JOIN sc USING (request_id, words)),
pv AS (SELECT request_id, store_id, product_id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, store_id, product_id) AS rank FROM pool JOIN vs USING (request_id, store_id, product_id)),
lists AS (SELECT 'full_catalog' AS experiment, 'lexical' AS search, * FROM lx UNION ALL SELECT 'full_catalog', 'vectors', * FROM vx UNION ALL SELECT 'pool', 'lexical', * FROM pl UNION ALL SELECT 'pool', 'vectors', * FROM pv),
fuse AS (SELECT experiment, 'hybrid' AS search, request_id, store_id, product_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lists GROUP BY ALL),
fall AS (SELECT experiment, search, request_id, store_id, product_id, score FROM lists WHERE rank <= {policies.DEPTH} OR experiment = 'pool' UNION ALL
  SELECT * FROM fuse QUALIFY experiment = 'pool' OR row_number() OVER (PARTITION BY experiment, request_id ORDER BY score DESC, store_id, product_id) <= {policies.DEPTH}),
bl AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{s}', {d}, {z}, {i}, {f}::DOUBLE)" for n, s, d, z, i, f in BASELINES)}) t(baseline, search, bd, bs, bi, floor)),
tagged AS (SELECT experiment, baseline, f.request_id, f.store_id, f.product_id, f.score, CASE WHEN bd AND NOT coalesce(a.dimension = p.dimension_, true) THEN 'drop' WHEN bs AND coalesce(a.asked_unit = p.unit AND abs(p.size - a.asked) > 0.01::DOUBLE * abs(a.asked), false) THEN 'drop'
  WHEN NOT bi THEN 'keep' WHEN {_conflict('a.variants', 'p.variants_')} THEN 'drop' WHEN a.mode = 'exact' AND NOT ({KNOWN}) THEN 'review' WHEN {KNOWN} AND lower(a.brand) <> lower(p.brand_) THEN 'drop' ELSE 'keep' END AS tag
  FROM fall f JOIN bl USING (search) JOIN asked_ a USING (request_id) JOIN prod p USING (store_id, product_id)),
kept AS (SELECT *, row_number() OVER (PARTITION BY experiment, baseline, request_id ORDER BY score DESC, store_id, product_id) AS place FROM tagged WHERE tag = 'keep'),
best AS (SELECT experiment, baseline, request_id, count(*) AS n, max(score) AS top, string_agg(CASE WHEN place <= 5 THEN concat(CAST(store_id AS STRING), '/', product_id) END, ',' ORDER BY place) AS ids FROM kept GROUP BY 1, 2, 3),
uns AS (SELECT DISTINCT experiment, baseline, request_id, true AS unsure FROM tagged WHERE tag = 'review'),
said AS (SELECT e.experiment, bl.baseline, a.request_id, CASE WHEN needs_review THEN 'needs_clarification' WHEN n IS NULL THEN CASE WHEN unsure THEN 'needs_clarification' ELSE 'no_acceptable_match' END WHEN top < floor THEN 'no_acceptable_match' ELSE 'answerable' END AS response,
  CASE WHEN needs_review THEN 0 ELSE coalesce(n, 0) END AS n_survivors, top, ids FROM asked_ a CROSS JOIN bl CROSS JOIN (SELECT unnest(['full_catalog', 'pool']) AS experiment) e LEFT JOIN best USING (experiment, baseline, request_id) LEFT JOIN uns USING (experiment, baseline, request_id)),
rec AS (SELECT experiment, baseline, request_id, response, CAST(n_survivors AS INT) AS n_survivors, CASE WHEN response = 'answerable' THEN top END AS top_score, CASE WHEN response = 'answerable' THEN ids END AS ids FROM said)"""


def found_lists(spark, sf_dir, asked: DataFrame, items: DataFrame) -> DataFrame:
    """The lists of every search over the whole catalog and within the pools, each made once."""
    index, rank = lexical_index(items), F.col("rank")
    lexical = settled(lexical_search(asked, items, "request_id", policies.HYBRID_DEPTH, index))
    vectors = settled(vector_search(spark, sf_dir, asked, items, policies.HYBRID_DEPTH))
    # the union of both searches' first results, scored by each
    pool = settled(lexical.where(rank <= POOL).select("request_id", *policies.ID).unionByName(vectors.where(rank <= POOL).select("request_id", *policies.ID)).distinct())
    vec = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    seen = pool.join(vec.select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("q")), "request_id").join(vec.select(F.col("vec_id").cast("string").alias("product_id"), F.col("embedding").alias("v")), "product_id")
    seen = seen.select("request_id", *policies.ID, F.round(retrieval.dot(F.col("q"), F.col("v")), 6).alias("score"))
    ranked = lambda df: retrieval.top_k(df, ["request_id"], 2**31 - 1, policies.ID)
    pools = [settled(ranked(lexical_scores(pool, asked, items, index))), settled(ranked(seen))]
    out = []
    for experiment, lists, fused, keep in (("full_catalog", [lexical, vectors], policies.DEPTH, rank <= policies.DEPTH), ("pool", pools, 2**31 - 1, F.lit(True))):
        for search, rows in (("lexical", lists[0]), ("vectors", lists[1]), ("hybrid", retrieval.fuse(lists, ["request_id"], policies.ID, fused))):
            out.append(rows.where(keep).select(F.lit(experiment).alias("experiment"), F.lit(search).alias("search"), "request_id", *policies.ID, "score"))
    both = out[0]
    for rows in out[1:]:
        both = both.unionByName(rows)
    return both.join(items.drop("words", "raw_title", "price_cents"), policies.ID)


def all_records(spark, sf_dir) -> DataFrame:
    asked, items = sides(spark, sf_dir)
    lists, folder = settled(found_lists(spark, sf_dir, asked, items)), shared_folder(spark, "records")
    baselines = spark.createDataFrame(BASELINES, runners.SCHEMA)
    # a run that ends early, and the one that goes on with what it left
    for some in (baselines.where("search = 'vectors'"), baselines):
        runners.write_missing(spark, folder, some, lambda todo: runners.records(asked, lists, todo))
    return runners.read_records(spark, folder)


@query(f"{RECORDS_SQL} SELECT * FROM rec")
def prediction_records(spark, sf_dir):
    return all_records(spark, sf_dir)


@query(f"""{RECORDS_SQL}, ids AS (SELECT DISTINCT request_id, unnest(string_split(ids, ',')) AS id FROM rec WHERE experiment = 'full_catalog' AND ids IS NOT NULL),
np AS (SELECT request_id, CAST(string_split(id, '/')[1] AS BIGINT) AS store_id, string_split(id, '/')[2] AS product_id FROM ids) SELECT * FROM np ANTI JOIN pool USING (request_id, store_id, product_id)""")
def unlabelled_pairs(spark, sf_dir):
    asked, items = sides(spark, sf_dir)
    lists = settled(found_lists(spark, sf_dir, asked, items))
    made = runners.records(asked, lists, spark.createDataFrame(BASELINES, runners.SCHEMA))
    labelled = lists.where("experiment = 'pool'").select("request_id", *policies.ID).distinct()
    return runners.new_pairs(made, labelled)


DELTA_SQL = f"""{CANDIDATE_SQL}, enough AS (SELECT request, store_id, product_id, packages * price_cents AS cost_cents, score, round(greatest(0.0::DOUBLE, packages * size - asked), 6) AS excess, abs(size - asked) <= 0.01::DOUBLE * asked AS same FROM live WHERE packages IS NOT NULL AND score >= 0.75 AND price_cents >= 0),
pick AS (SELECT kind, request, store_id, product_id, cost_cents FROM (SELECT 'after' AS kind, * FROM enough UNION ALL SELECT 'before', * FROM enough WHERE same) QUALIFY row_number() OVER (PARTITION BY kind, request, store_id ORDER BY cost_cents, excess, score DESC, product_id) = 1),
delta AS (SELECT q.request, s.store_id, b.product_id AS before_product, b.cost_cents AS before_cents, a.product_id AS after_product, a.cost_cents AS after_cents, b.cost_cents - a.cost_cents AS saved_cents FROM asked q CROSS JOIN (SELECT DISTINCT store_id FROM fx_catalog) s
  LEFT JOIN pick b ON b.kind = 'before' AND b.request = q.request AND b.store_id = s.store_id LEFT JOIN pick a ON a.kind = 'after' AND a.request = q.request AND a.store_id = s.store_id),
classed AS (SELECT *, CASE WHEN before_cents IS NULL AND after_cents IS NULL THEN 'neither' WHEN before_cents IS NULL THEN 'gained' WHEN after_cents IS NULL THEN 'lost' WHEN saved_cents > 0 THEN 'cheaper' WHEN saved_cents < 0 THEN 'dearer' WHEN before_product = after_product THEN 'same' ELSE 'even' END AS change FROM delta)"""


def deltas(spark, sf_dir) -> DataFrame:
    asked, found = candidates(spark, sf_dir)
    live = found.where("state is null or state <> 'out_of_stock'").join(asked.select("request", "asked", "asked_unit"), "request")
    priced = settled(basket.arithmetic(live).where("cost_cents is not null").where(F.col("score") >= 0.75))
    order = [F.col("cost_cents"), F.col("excess"), F.desc("score"), F.col("product_id")]
    first = lambda df: basket.cheapest(df, ["request", "store_id"], order)
    same = priced.where(gates.size_fits(F.col("asked"), F.col("asked_unit"), F.col("size"), F.col("unit")))
    every = asked.select("request").crossJoin(stores(spark, sf_dir))
    return runners.selection_delta(first(same), first(priced), ["request", "store_id"], every)


@query(f"WITH {DELTA_SQL} SELECT * FROM classed")
def sufficiency_delta(spark, sf_dir):
    return deltas(spark, sf_dir)


@query(f"WITH {DELTA_SQL} SELECT store_id, change, count(*) AS n, CAST(coalesce(sum(saved_cents), 0) AS BIGINT) AS saved_cents FROM classed GROUP BY 1, 2")
def sufficiency_summary(spark, sf_dir):
    return runners.delta_summary(deltas(spark, sf_dir), ["store_id"])


# --- files and keys -------------------------------------------------------------------------------


@query("""SELECT CAST(user_id AS VARCHAR) AS item_id, CAST(event_id AS VARCHAR) AS position, CASE WHEN event_id % 2 = 1 THEN 'In stock' ELSE '' END AS stock_status, CASE WHEN event_id % 4 = 1 THEN '2026-01-01T00:00:00Z' END AS scraped_at, event_id % 4 <> 1 AS by_file FROM events
UNION ALL SELECT '', CAST(page_id AS VARCHAR), '', '2026-02-02T00:00:00Z', false FROM pages""")
def appended_items(spark, sf_dir):
    """Three batches with other columns each; rows without a time of their own get that of their file."""
    folder, events = shared_folder(spark, "items"), read(spark, sf_dir, "events")
    item = [F.col("user_id").alias("item_id"), F.col("event_id").alias("position")]
    derived.append_rows(events.where("event_id % 2 = 0").select(*item), folder)
    derived.append_rows(events.where("event_id % 2 = 1").select(F.lit("In stock").alias("stock_status"), F.when(F.col("event_id") % 4 == 1, "2026-01-01T00:00:00Z").otherwise("").alias("scraped_at"), *item), folder)
    derived.append_rows(read(spark, sf_dir, "pages").select(F.lit("2026-02-02T00:00:00Z").alias("scraped_at"), F.col("page_id").alias("position")), folder)
    rows = derived.read_appended(spark, folder)
    given = F.col("scraped_at").isin("2026-01-01T00:00:00Z", "2026-02-02T00:00:00Z")
    return rows.select("item_id", "position", "stock_status", F.when(given, F.col("scraped_at")).alias("scraped_at"), (~given & F.col("scraped_at").rlike(r"^20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ$")).alias("by_file"))


@query("SELECT CAST(page_id AS VARCHAR) AS page_id, coalesce(html, '') AS html, concat(' \"', url, '\",', chr(10), ' x ') AS url FROM pages")
def csv_round_trip(spark, sf_dir):
    folder, fields = shared_folder(spark, "csv"), ("page_id", "url", "html")
    derived.write_csv(read(spark, sf_dir, "pages").withColumn("url", F.concat(F.lit(' "'), "url", F.lit('",\n x '))), folder, fields)
    return derived.read_csv(spark, folder, fields)


KEY_COLUMNS, PARAMS = ["store_id", "product_id", "raw_title", "nth"], {"model": "hashing", "dimensions": 64, "version": "v1"}


@query(f"""WITH {oracle('catalog')}, r AS (SELECT store_id, product_id, raw_title, CAST(product_id AS BIGINT) * 8 + store_id AS nth FROM fx_catalog),
d AS (SELECT sha256(concat(count(*), '|', coalesce(sum(('0x' || left(md5(store_id || chr(31) || product_id || chr(31) || raw_title || chr(31) || nth), 12))::BIGINT), 0))) AS sha FROM r)
SELECT sha256(concat(sha, '|{{"dimensions": 64, "model": "hashing", "version": "v1"}}')) AS "key", (SELECT count(*) FROM r) AS n_rows, 1 AS n_builds FROM d""")
def derived_key(spark, sf_dir):
    """The key of the catalog's derived texts, asked for twice and built once."""
    rows = view(spark, sf_dir, "catalog").withColumn("nth", F.col("product_id").cast("long") * 8 + F.col("store_id"))
    folder, built = shared_folder(spark, "derived"), []

    def build(df: DataFrame) -> DataFrame:
        built.append(1)
        return df.select("store_id", "product_id", F.lower("raw_title").alias("text"))

    for _ in range(2):
        kept = derived.load_or_build(rows, KEY_COLUMNS, PARAMS, folder, build)
    return kept.agg(F.count("*").alias("n_rows")).select(F.lit(derived.cache_key(rows, KEY_COLUMNS, PARAMS)).alias("key"), "n_rows", F.lit(len(built)).alias("n_builds"))
