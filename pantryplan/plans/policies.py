"""Queries of the match policies: retrieval, gates and responses over written requests.

Requests are every part whose key is divisible by 50, searched against the whole
catalog; those of the list runner are the lines of every list whose id is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pantryplan.functions import identity, lineparse
from pantryplan.functions import stock as stock_states
from pantryplan.operators import basket, gates, metrics, policies, retrieval
from pantryplan.plans.fixtures import oracle, view
from pantryplan.sources.settle import settled
from pantryplan.plans.queries import ACCEPT, CANDIDATE_SQL, FLOOR, LEXICON_SQL, LINE_SQL, SIZE_SQL, STOCK_SQL, distinct_requests, met, named_products, parse_distinct, parsed_lines, query, read, resolved_requests, sizes, stores

FLOOR_LEXICAL, FLOOR_HYBRID = 0.2, 0.016
#: What the gates read of a product.
GATED = ("dimension_", "size", "unit", "brand_", "variants_")


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _stripped(brand: str) -> str:
    last = f"len(string_split({brand}, ' ')) > 1 AND list_contains({_list(identity.GENERIC)}, lower(string_split({brand}, ' ')[-1]))"
    return f"CASE WHEN {last} THEN array_to_string(string_split({brand}, ' ')[1:len(string_split({brand}, ' ')) - 1], ' ') ELSE {brand} END"


def _variants(tokens: str, brand: str) -> str:
    own = f"list_transform(regexp_extract_all(coalesce({brand}, ''), '[A-Za-z0-9&''.\\-]+'), lambda x: lower(x))"
    ts = f"list_transform(list_filter(list_transform({tokens}, lambda x: lower(x)), lambda x: NOT list_contains({own}, x)), lambda x: trim(x, '.'))"
    size, known = identity.SIZE_LIKE.replace("'", "''"), _list(identity.VARIANTS)
    pick = f"list_transform(range(1, len(vt) + 1), lambda i: CASE WHEN regexp_matches(vt[i], '{size}') THEN NULL WHEN list_contains({known}, vt[i]) THEN vt[i] WHEN i < len(vt) AND list_contains({known}, concat(vt[i], '-', vt[i + 1])) THEN concat(vt[i], '-', vt[i + 1]) END)"
    return f"(SELECT list_sort(list_distinct(list_filter({pick}, lambda x: x IS NOT NULL))) FROM (SELECT {ts} AS vt))"


def _conflict(a: str, b: str) -> str:
    one = lambda g: f"(len(list_intersect({a}, {_list(g)})) > 0 AND len(list_intersect({b}, {_list(g)})) > 0 AND list_sort(list_intersect({a}, {_list(g)})) <> list_sort(list_intersect({b}, {_list(g)})))"
    return "(" + " OR ".join(map(one, identity.EXCLUSIVE)) + ")"


TOKENS = "regexp_extract_all({0}, '[A-Za-z0-9&''.\\-]+')"
#: brand and variants of titles, and of requests.
IDENTITY_SQL = f"""{LEXICON_SQL},
gr AS (SELECT raw_title, ts, CASE WHEN len(ts) >= 1 THEN ts[1] END AS g1, CASE WHEN len(ts) >= 2 THEN array_to_string(ts[1:2], ' ') END AS g2, CASE WHEN len(ts) >= 3 THEN array_to_string(ts[1:3], ' ') END AS g3
  FROM (SELECT DISTINCT raw_title, {TOKENS.format('raw_title')} AS ts FROM fx_catalog)),
br AS (SELECT raw_title, ts, CASE WHEN a.n IS NOT NULL THEN CASE WHEN b.n IS NULL OR b.n < 0.5 * a.n THEN g1 WHEN c.n IS NULL OR c.n < 0.5 * b.n THEN g2 ELSE g3 END
  WHEN b.n IS NOT NULL THEN CASE WHEN c.n IS NULL OR c.n < 0.5 * b.n THEN g2 ELSE g3 END WHEN c.n IS NOT NULL THEN g3
  WHEN list_contains({_list(identity.STORE_BRANDS)}, g3) THEN g3 WHEN list_contains({_list(identity.STORE_BRANDS)}, g2) THEN g2 WHEN list_contains({_list(identity.STORE_BRANDS)}, g1) THEN g1 END AS found
  FROM gr LEFT JOIN lexicon a ON a.gram = g1 LEFT JOIN lexicon b ON b.gram = g2 LEFT JOIN lexicon c ON c.gram = g3),
bs AS (SELECT raw_title, ts, {_stripped('found')} AS found FROM br), bt AS (SELECT raw_title, ts, {_stripped('found')} AS brand FROM bs),
ident AS (SELECT raw_title, brand, {_variants('ts', 'brand')} AS variants FROM bt)"""
ASKED_SQL = f"""fx_rq AS (SELECT request_id, text, mode, form = 3 AS needs_review, CASE form WHEN 0 THEN 'weight' WHEN 1 THEN 'volume' WHEN 2 THEN 'count' WHEN 4 THEN 'weight' WHEN 5 THEN 'count' END AS dimension,
  CAST(CASE form WHEN 2 THEN 2 WHEN 3 THEN NULL WHEN 4 THEN p_size * 16 ELSE p_size END AS DOUBLE) AS asked, CASE form WHEN 0 THEN 'oz' WHEN 1 THEN 'fl oz' WHEN 2 THEN 'ct' WHEN 4 THEN 'oz' WHEN 5 THEN 'ct' END AS asked_unit FROM fx_asks),
rg AS (SELECT request_id, n, i, array_to_string(ts[i:i + n - 1], ' ') AS gram FROM (SELECT request_id, {TOKENS.format('text')} AS ts FROM fx_rq) a, (SELECT unnest([1, 2, 3]) AS n) b, range(1, 30) t(i) WHERE i + n - 1 <= len(ts)),
rf AS (SELECT request_id, arg_min(gram, (3 - n) * 1000 + i) AS found FROM rg WHERE length(gram) >= 3 AND (gram IN (SELECT gram FROM lexicon) OR list_contains({_list(identity.STORE_BRANDS)}, gram))
  AND len(list_filter(string_split(gram, ' '), lambda p: regexp_full_match(p, '[0-9]+'))) = 0 AND len(list_filter(string_split(gram, ' '), lambda p: NOT list_contains({_list(identity.GENERIC)}, lower(p)))) > 0 GROUP BY 1),
rs AS (SELECT request_id, {_stripped('found')} AS found FROM rf), rt AS (SELECT request_id, {_stripped('found')} AS brand FROM rs),
ru AS (SELECT q.*, rt.brand, {TOKENS.format('text')} AS ts FROM fx_rq q LEFT JOIN rt USING (request_id)),
asked_ AS (SELECT request_id, text, mode, needs_review, dimension, asked, asked_unit, brand, {_variants('ts', 'brand')} AS variants FROM ru),
prod AS (SELECT s.store_id, s.product_id, s.raw_title, s.price_cents, s.dimension AS dimension_, s.canonical_total AS size, s.canonical_unit AS unit, i.brand AS brand_, i.variants AS variants_, trim(concat(s.raw_title, ' ', coalesce(i.brand, ''), ' ', array_to_string(i.variants, ' '))) AS words FROM sizes s JOIN ident i USING (raw_title))"""


def _tfidf(queries: str, key: str, depth: int) -> str:
    """Lexical search of ``queries`` (key, text) over ``prod``: lx with rank up to ``depth``."""
    words = lambda t: f"unnest(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]{{2,}}'))"
    return f"""pw AS (SELECT words, {words('words')} AS term FROM (SELECT DISTINCT words FROM prod)), ptf AS (SELECT words, term, count(*) AS tf FROM pw GROUP BY 1, 2), pc AS (SELECT words, count(*) AS c FROM prod GROUP BY 1),
pidf AS (SELECT term, ln((1 + (SELECT count(*) FROM prod)) / (1 + sum(c))) + 1 AS idf FROM ptf JOIN pc USING (words) GROUP BY term),
pr AS (SELECT words, term, tf * idf AS raw FROM ptf JOIN pidf USING (term)), pn AS (SELECT words, sqrt(sum(raw * raw)) AS norm FROM pr GROUP BY 1),
qtf AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, {words('text')} AS term FROM {queries}) GROUP BY 1, 2), qr AS (SELECT {key}, term, tf * idf AS raw FROM qtf JOIN pidf USING (term)), qn AS (SELECT {key}, sqrt(sum(raw * raw)) AS norm FROM qr GROUP BY 1),
sc AS (SELECT q.{key}, pr.words, round(sum(pr.raw * (q.raw / qn.norm)) / min(pn.norm), 6) AS score FROM qr q JOIN qn USING ({key}) JOIN pr ON pr.term = q.term JOIN pn ON pn.words = pr.words GROUP BY 1, 2),
lx AS (SELECT {key}, store_id, product_id, score, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, store_id, product_id) AS rank FROM sc JOIN prod USING (words) WHERE score > 0 QUALIFY rank <= {depth})"""


VECTORS_SQL = """vs AS (SELECT q.vec_id AS request_id, p.store_id, p.product_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(d.embedding[i] AS DOUBLE))), 6) AS score
  FROM embeddings q JOIN asked_ a ON a.request_id = q.vec_id JOIN embeddings d ON true JOIN prod p ON CAST(p.product_id AS BIGINT) = d.vec_id),
vx AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, store_id, product_id) AS rank FROM vs WHERE score > 0 QUALIFY rank <= {depth})"""


def _decided(found: str, size: bool, by_identity: bool, floor: float) -> str:
    fits = "AND NOT coalesce(a.asked_unit = p.unit AND abs(p.size - a.asked) > 0.01::DOUBLE * abs(a.asked), false)" if size else ""
    known = "a.brand IS NOT NULL AND p.brand_ IS NOT NULL"
    tag = f"CASE WHEN {_conflict('a.variants', 'p.variants_')} THEN 'drop' WHEN a.mode = 'exact' AND NOT ({known}) THEN 'review' WHEN {known} AND lower(a.brand) <> lower(p.brand_) THEN 'drop' ELSE 'keep' END" if by_identity else "'keep'"
    return f"""tagged AS (SELECT f.request_id, f.store_id, f.product_id, f.score, {tag} AS tag FROM {found} f JOIN asked_ a USING (request_id) JOIN prod p USING (store_id, product_id) WHERE (a.dimension IS NULL OR p.dimension_ IS NULL OR a.dimension = p.dimension_) {fits}),
kept AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, store_id, product_id) AS place FROM tagged WHERE tag = 'keep'),
best AS (SELECT request_id, count(*) AS n, max(score) AS top, string_agg(CASE WHEN place <= 5 THEN concat(CAST(store_id AS STRING), '/', product_id) END, ',' ORDER BY place) AS ids FROM kept GROUP BY 1),
said AS (SELECT a.request_id, CASE WHEN needs_review THEN 'needs_clarification' WHEN n IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM tagged t WHERE t.request_id = a.request_id AND tag = 'review') THEN 'needs_clarification' ELSE 'no_acceptable_match' END WHEN top < {floor} THEN 'no_acceptable_match' ELSE 'answerable' END AS response,
  CASE WHEN needs_review THEN 0 ELSE coalesce(n, 0) END AS n_survivors, top, ids FROM asked_ a LEFT JOIN best USING (request_id))
SELECT request_id, response, n_survivors, CASE WHEN response = 'answerable' THEN top END AS top_score, CASE WHEN response = 'answerable' THEN ids END AS ids FROM said"""


BASE_SQL = f"WITH {IDENTITY_SQL.replace('t AS (SELECT store_id', 't_ AS (SELECT store_id').replace('FROM t, (SELECT', 'FROM t_, (SELECT')}, {SIZE_SQL}, {oracle('asks')}, {ASKED_SQL}"
LEXICAL_SQL = f"{BASE_SQL}, {_tfidf('asked_', 'request_id', policies.DEPTH)}"
HYBRID_SQL = f"""{BASE_SQL}, {_tfidf('asked_', 'request_id', policies.HYBRID_DEPTH)}, {VECTORS_SQL.format(depth=policies.HYBRID_DEPTH)},
fu AS (SELECT request_id, store_id, product_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT request_id, store_id, product_id, rank FROM lx UNION ALL SELECT request_id, store_id, product_id, rank FROM vx) GROUP BY 1, 2, 3),
hx AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, store_id, product_id) AS rank FROM fu QUALIFY rank <= {policies.DEPTH})"""


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["store_id", "product_id", "raw_title", "price_cents", F.col("dimension").alias("dimension_"), F.col("canonical_total").alias("size"), F.col("canonical_unit").alias("unit")]
    return settled(sizes(spark, sf_dir).select(*fields))


def products(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """The catalog with sizes, identity and search text."""
    rows = catalog_rows(spark, sf_dir) if rows is None else rows
    titles = identity.brands(rows.select("raw_title").distinct(), identity.brand_lexicon(rows) if lexicon is None else lexicon).withColumnRenamed("brand", "brand_")
    titles = titles.withColumn("variants_", identity.variant_tokens(F.col("raw_title"), F.col("brand_")))
    words = policies.catalog_text(F.col("raw_title"), F.col("brand_"), F.array_join("variants_", " "))
    titles = settled(titles.select("raw_title", "brand_", "variants_", words.alias("words")))
    return settled(rows.join(retrieval.small(titles), "raw_title"))


def requests(spark: SparkSession, sf_dir: str, lexicon: DataFrame | None = None) -> DataFrame:
    """Parsed written requests with their identity."""
    asks = view(spark, sf_dir, "asks").select("request_id", "text", "mode")
    parsed = parse_distinct(asks, "text", lineparse.parse_lines).withColumn("r", lineparse.requested_total(F.col("text"), F.col("parsed")))
    lexicon = identity.brand_lexicon(view(spark, sf_dir, "catalog")) if lexicon is None else lexicon
    named = identity.request_identity(asks, lexicon, "request_id", "text")
    fields = parsed.select("request_id", "text", "mode", "parsed.needs_review", F.array_join("parsed.review_reasons", "; ").alias("review_reason"), "parsed.dimension", F.col("r.total").alias("asked"), F.col("r.unit").alias("asked_unit"))
    return settled(fields.join(named, "request_id"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests and products; the catalog is read once, and its lexicon serves both."""
    rows = catalog_rows(spark, sf_dir)
    lexicon = settled(identity.brand_lexicon(rows))
    return requests(spark, sf_dir, lexicon), products(spark, sf_dir, rows, lexicon)


def lexical_index(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Term weights of the products' texts, their norms, and idfs: each distinct text is weighed once, for as many rows as have it."""
    texts = items.groupBy("words").agg(F.count("*").alias("rows"))
    counts = settled(retrieval.term_counts(texts, "words", "words"))
    df = counts.join(texts, "words").groupBy("term").agg(F.sum("rows").alias("df"))
    idfs = df.crossJoin(F.broadcast(texts.agg(F.sum("rows").alias("n")))).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = settled(counts.join(idfs, "term").select("words", "term", (F.col("tf") * F.col("idf")).alias("raw")))
    return raw, raw.groupBy("words").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm")), idfs


def lexical_search(asked: DataFrame, items: DataFrame, key: str, depth: int, index: tuple[DataFrame, DataFrame, DataFrame] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Products by the cosine of their text, with the columns of ``items`` in ``carry``.

    Requests that hold the same known words as often are one search, and a text has a row among
    a request's ``depth`` best only where its first row is: what is scored depends on how
    many searches and texts differ, not on how many requests and products have them.
    """
    raw, norm, idfs = index or lexical_index(items)
    counts = settled(retrieval.term_counts(asked, key, "text").join(idfs.select("term"), "term"))
    same = settled(counts.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "term", "tf"))), " ").alias("search")))
    one = same.groupBy("search").agg(F.min(key).alias(key))
    q = retrieval.weights(counts.join(one, key).select("search", "term", "tf"), idfs, "search").withColumnRenamed("w", "wq")
    hits = raw.join(retrieval.small(q), "term").groupBy("search", "words").agg(F.sum(F.col("raw") * F.col("wq")).alias("dot"))
    rows = items.select("words", *policies.ID, *carry).withColumn("nth", F.row_number().over(Window.partitionBy("words").orderBy(*policies.ID))).where(F.col("nth") <= depth)
    rows = settled(rows)
    first = rows.where("nth = 1").select("words", *(F.col(c).alias(f"first_{c}") for c in policies.ID))
    scored = hits.join(norm, "words").select("search", "words", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where("score > 0")
    kept = retrieval.top_k(scored.join(first, "words"), ["search"], depth, [f"first_{c}" for c in policies.ID]).select("search", "words", "score")
    best = settled(retrieval.top_k(kept.join(rows.drop("nth"), "words").drop("words"), ["search"], depth, policies.ID))
    return same.join(retrieval.small(best), "search").drop("search")


def lexical_scores(pairs: DataFrame, asked: DataFrame, items: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """The same cosine of given pairs (request_id, store_id, product_id) alone, whatever their rank; 0 without a common term."""
    raw, norm, idfs = index
    q = retrieval.weights(retrieval.term_counts(asked, "request_id", "text"), idfs, "request_id").withColumnRenamed("w", "wq")
    pairs = pairs.join(items.select("store_id", "product_id", "words"), policies.ID)
    hits = pairs.select("request_id", "words").distinct().join(raw, "words").join(q, ["request_id", "term"]).groupBy("request_id", "words").agg(F.sum(F.col("raw") * F.col("wq")).alias("dot"))
    scored = hits.join(norm, "words").select("request_id", "words", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    return pairs.join(scored, ["request_id", "words"], "left").select("request_id", *policies.ID, F.coalesce("score", F.lit(0.0)).alias("score"))


def vector_search(spark: SparkSession, sf_dir: str, asked: DataFrame, items: DataFrame, depth: int) -> DataFrame:
    """Products by the dot product of their vector; of equal ones a vector's first store decides which can be among the best."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = vectors.join(asked.select(F.col("request_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("qvec"))
    first = items.groupBy("product_id").agg(F.min("store_id").alias("store_id"))
    held = vectors.select(F.col("vec_id").cast("string").alias("product_id"), F.col("embedding").alias("vec")).join(first, "product_id")
    found = retrieval.nearest(q, held, depth, "request_id", "product_id", policies.ID)
    return retrieval.top_k(found.join(items.select("store_id", "product_id"), "product_id"), ["request_id"], depth, policies.ID)


def hybrid_search(spark: SparkSession, sf_dir: str, asked: DataFrame, items: DataFrame) -> DataFrame:
    lists = [lexical_search(asked, items, "request_id", policies.HYBRID_DEPTH), vector_search(spark, sf_dir, asked, items, policies.HYBRID_DEPTH)]
    return retrieval.fuse(lists, ["request_id"], policies.ID, policies.DEPTH)


def run(spark: SparkSession, sf_dir: str, search: str, size: bool, by_identity: bool, floor: float = 0.0) -> DataFrame:
    asked, items = sides(spark, sf_dir)
    if search == "lexical":
        found = lexical_search(asked, items, "request_id", policies.DEPTH, carry=GATED).drop("rank")
        return policies.decide(asked, policies.gated(asked.drop("text"), found, size, by_identity), floor)
    found = {"vectors": lambda: vector_search(spark, sf_dir, asked, items, policies.DEPTH), "hybrid": lambda: hybrid_search(spark, sf_dir, asked, items)}[search]()
    found = found.drop("rank").join(items.drop("words", "raw_title", "price_cents"), policies.ID)
    return policies.decide(asked, policies.gated(asked.drop("text"), found, size, by_identity), floor)


@query(f"WITH {IDENTITY_SQL} SELECT store_id, product_id, brand, array_to_string(variants, ',') AS variants, CASE WHEN brand IS NULL THEN 'brand_unknown' ELSE 'resolved' END AS status FROM fx_catalog JOIN ident USING (raw_title)")
def catalog_identity(spark, sf_dir):
    return products(spark, sf_dir).select("store_id", "product_id", F.col("brand_").alias("brand"), F.array_join("variants_", ",").alias("variants"), F.when(F.col("brand_").isNull(), "brand_unknown").otherwise("resolved").alias("status"))


@query(f"{BASE_SQL} SELECT request_id, brand, array_to_string(variants, ',') AS variants FROM asked_")
def request_identity(spark, sf_dir):
    return requests(spark, sf_dir).select("request_id", "brand", F.array_join("variants", ",").alias("variants"))


@query(f"{LEXICAL_SQL}, {_decided('lx', False, False, FLOOR_LEXICAL)}")
def policy_dimension(spark, sf_dir):
    return run(spark, sf_dir, "lexical", False, False, FLOOR_LEXICAL)


@query(f"{LEXICAL_SQL}, {_decided('lx', True, False, 0.0)}")
def policy_size(spark, sf_dir):
    return run(spark, sf_dir, "lexical", True, False)


@query(f"{LEXICAL_SQL}, {_decided('lx', True, False, FLOOR_LEXICAL)}")
def policy_refloored(spark, sf_dir):
    return policies.refloored(run(spark, sf_dir, "lexical", True, False), FLOOR_LEXICAL)


@query(f"{LEXICAL_SQL}, {_decided('lx', True, True, 0.0)}")
def policy_identity(spark, sf_dir):
    return run(spark, sf_dir, "lexical", True, True)


@query(f"{BASE_SQL}, {VECTORS_SQL.format(depth=policies.DEPTH)}, {_decided('vx', True, False, 0.0)}")
def policy_vectors(spark, sf_dir):
    return run(spark, sf_dir, "vectors", True, False)


@query(f"{HYBRID_SQL} SELECT request_id, store_id, product_id, score, CAST(rank AS INT) AS rank FROM hx")
def hybrid_retrieval(spark, sf_dir):
    return hybrid_search(spark, sf_dir, *sides(spark, sf_dir))


@query(f"{HYBRID_SQL}, {_decided('hx', True, False, FLOOR_HYBRID)}")
def policy_hybrid(spark, sf_dir):
    return run(spark, sf_dir, "hybrid", True, False, FLOOR_HYBRID)


@query(f"{HYBRID_SQL}, {_decided('hx', True, True, 0.0)}")
def policy_hybrid_identity(spark, sf_dir):
    return run(spark, sf_dir, "hybrid", True, True)


MATCH_SQL = f"""{BASE_SQL}, {_tfidf('asked_', 'request_id', policies.LIST_DEPTH)}, {_decided('lx', True, True, 0.0).rpartition('kept AS')[0].rstrip().rstrip(',')},
won AS (SELECT request_id, store_id, product_id, score FROM tagged WHERE tag = 'keep' AND score >= 0.35 QUALIFY row_number() OVER (PARTITION BY request_id, store_id ORDER BY score DESC, product_id) = 1),
unsure AS (SELECT request_id, bool_or(tag = 'review') AS unsure FROM tagged GROUP BY 1),
matches AS (SELECT a.request_id, w.store_id, w.product_id, w.score, CASE WHEN needs_review THEN 'needs_clarification' WHEN w.product_id IS NOT NULL THEN 'answerable' WHEN coalesce(unsure, false) THEN 'needs_clarification' ELSE 'no_acceptable_match' END AS response,
  CASE WHEN needs_review THEN '{lineparse.NO_SIZE}' WHEN w.product_id IS NOT NULL THEN CASE WHEN coalesce(unsure, false) THEN '{policies.SOME_UNCONFIRMED}' ELSE '' END WHEN coalesce(unsure, false) THEN '{policies.UNCONFIRMED}' ELSE '{policies.NOTHING.format(0.35)}' END AS note
  FROM asked_ a LEFT JOIN unsure USING (request_id) LEFT JOIN won w ON w.request_id = a.request_id AND NOT a.needs_review)"""


def matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked, items = sides(spark, sf_dir)
    found = lexical_search(asked, items, "request_id", policies.LIST_DEPTH, carry=GATED).drop("rank")
    return policies.line_matches(asked, policies.gated(asked.drop("text"), found, True, True)), items


@query(f"{MATCH_SQL} SELECT * FROM matches")
def line_matcher(spark, sf_dir):
    return matches(spark, sf_dir)[0]


@query(f"""{MATCH_SQL}, m AS (SELECT request_id % 250 AS list_id, * FROM matches), l AS (SELECT * FROM m WHERE response = 'answerable'), n AS (SELECT list_id, count(DISTINCT CASE WHEN response = 'answerable' THEN request_id END) AS n_answerable FROM m GROUP BY 1),
h AS (SELECT list_id, store_id, count(*) AS n_matched, CAST(coalesce(sum(CASE WHEN CAST(product_id AS BIGINT) % 37 <> 5 THEN price_cents END), 0) AS BIGINT) AS subtotal_cents, bool_and(CAST(product_id AS BIGINT) % 37 <> 5) AS fully_priced FROM l JOIN prod USING (store_id, product_id) GROUP BY 1, 2),
cg AS (SELECT n.list_id, s.store_id, r_name, n_answerable, coalesce(n_matched, 0) AS n_matched, coalesce(subtotal_cents, 0) AS subtotal_cents, coalesce(fully_priced, true) AS fully_priced, n_answerable > 0 AND coalesce(n_matched, 0) = n_answerable AS complete FROM n CROSS JOIN (SELECT CAST(r_regionkey AS BIGINT) AS store_id, r_name FROM region) s LEFT JOIN h ON h.list_id = n.list_id AND h.store_id = s.store_id)
SELECT list_id, store_id, n_answerable, n_matched, subtotal_cents, fully_priced, complete, CAST(CASE WHEN complete AND fully_priced THEN row_number() OVER (PARTITION BY list_id, complete AND fully_priced ORDER BY subtotal_cents, r_name, store_id) END AS INT) AS rank FROM cg""")
def simple_comparison(spark, sf_dir):
    """Some products have no known price, so some complete stores aren't ranked."""
    found, items = matches(spark, sf_dir)
    prices = items.select("store_id", "product_id", F.when(F.col("product_id").cast("long") % 37 != 5, F.col("price_cents")).alias("price_cents"))
    named = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("store_id"), F.col("r_name").alias("store_name"))
    return policies.simple_comparison(found.withColumn("list_id", F.col("request_id") % 250), prices, named)


@query(f"""{LEXICAL_SQL}, {_decided('lx', False, False, 0.0).rpartition('best AS')[0].rstrip().rstrip(',')},
top AS (SELECT k.request_id, k.store_id, k.product_id, a.brand, p.brand_, a.variants, p.variants_, a.mode, a.dimension, p.dimension_, a.asked, a.asked_unit, p.size, p.unit FROM kept k JOIN asked_ a USING (request_id) JOIN prod p USING (store_id, product_id) WHERE place = 1 AND NOT needs_review),
b AS (SELECT *, string_split(lower(brand), ' ') AS x, string_split(lower(brand_), ' ') AS y FROM top)
SELECT request_id, store_id, product_id, array_to_string(list_filter([CASE WHEN mode = 'exact' AND x IS NOT NULL AND y IS NOT NULL AND x[1:least(len(x), len(y))] <> y[1:least(len(x), len(y))] THEN 'brand_conflict' END, CASE WHEN {_conflict('variants', 'variants_')} THEN 'variant_conflict' END,
CASE WHEN dimension <> dimension_ THEN 'dimension_conflict' END, CASE WHEN asked_unit = unit AND abs(size - asked) / asked > 0.01::DOUBLE THEN 'size_conflict' END], lambda v: v IS NOT NULL), ',') AS violations FROM b""")
def constraint_violations(spark, sf_dir):
    asked, items = sides(spark, sf_dir)
    found = lexical_search(asked, items, "request_id", policies.DEPTH, carry=GATED).drop("rank")
    kept = policies.gated(asked.drop("text"), found, False, False).join(asked.where("not needs_review").select("request_id"), "request_id", "left_semi")
    top = retrieval.top_k(kept, ["request_id"], 1, policies.ID)
    return policies.violations(top).select("request_id", "store_id", "product_id", F.array_join("violations", ",").alias("violations"))


def _explained(key: str, accept: str, floor: str) -> str:
    """SQL of explanations: ``told`` by ``key`` and store, from candidates (with titles), live and asked rows."""
    say = lambda template, *values: "concat(" + ", ".join(x for v, p in zip(("''", *values), template.split("{}")) for x in (v, f"'{p}'")) + ")"
    return f"""band AS (SELECT *, CASE WHEN packages IS NOT NULL AND price_cents >= 0 THEN packages * price_cents END AS cost_cents, CASE WHEN packages IS NOT NULL AND price_cents >= 0 THEN round(greatest(0.0::DOUBLE, packages * size - asked), 6) END AS excess,
  coalesce(score >= {accept} AND round(max(CASE WHEN score >= {accept} THEN score END) OVER (PARTITION BY {key}, store_id) - score, 9) <= 0.01, false) AS in_band FROM live),
spot AS (SELECT *, CASE WHEN in_band AND cost_cents IS NOT NULL THEN row_number() OVER (PARTITION BY {key}, store_id, in_band AND cost_cents IS NOT NULL ORDER BY cost_cents, excess, score DESC, product_id) END AS place, row_number() OVER (PARTITION BY {key}, store_id ORDER BY score DESC, product_id) AS i FROM band),
owns AS (SELECT * FROM spot WHERE place = 1), rivals AS (SELECT * FROM spot WHERE place = 2),
worse AS (SELECT s.*, row_number() OVER (PARTITION BY s.{key}, s.store_id ORDER BY s.cost_cents, s.excess, s.score DESC, s.product_id) AS nth FROM spot s JOIN owns o ON o.{key} = s.{key} AND o.store_id = s.store_id WHERE s.score >= {accept} AND NOT s.in_band AND s.cost_cents < o.cost_cents),
worst AS (SELECT {key}, store_id, string_agg(CASE WHEN nth <= 3 THEN concat(product_id, ':', cost_cents) END, ',' ORDER BY nth) AS some, max(CASE WHEN nth = 1 THEN title END) AS cheaper, max(CASE WHEN nth = 1 THEN cost_cents END) AS cheaper_cost FROM worse GROUP BY 1, 2),
agg AS (SELECT {key}, store_id, max(score) AS top_score, count(*) AS n_candidates, count(CASE WHEN score >= {accept} AND cost_cents IS NOT NULL THEN 1 END) AS considered, count(CASE WHEN score >= {accept} AND cost_cents IS NULL THEN 1 END) AS n_unresolved, string_agg(CASE WHEN i <= 5 THEN product_id END, ',' ORDER BY i) AS shown FROM spot GROUP BY 1, 2),
away AS (SELECT {key}, store_id, string_agg(DISTINCT product_id, ',' ORDER BY product_id) AS out_of_stock FROM candidates WHERE state = 'out_of_stock' GROUP BY 1, 2),
told AS (SELECT a.{key}, s.store_id, CASE WHEN top_score IS NULL OR top_score < {floor} THEN 'missing' WHEN top_score >= {accept} AND o.product_id IS NOT NULL THEN 'priced' ELSE 'review' END AS state, CASE WHEN top_score IS NULL OR top_score < {floor} THEN 'no candidate cleared the review floor' WHEN top_score >= {accept} AND o.product_id IS NOT NULL THEN NULL ELSE 'candidates shown, not priced' END AS reason,
  concat(printf('%g', a.asked), ' ', a.asked_unit) AS requested, o.product_id, o.title, concat(printf('%g', o.size), ' ', o.unit) AS package_size, o.packages, o.price_cents AS package_price_cents, o.cost_cents, o.excess, CASE WHEN o.excess <> 0 THEN {say(basket.LEAVES, 'o.packages', "printf('%g', o.excess)", 'o.unit')} END AS excess_note,
  round(o.price_cents / o.size, 6) AS unit_price, coalesce(o.state, 'unverified') AS stock, coalesce(o.state, 'unverified') <> 'unverified' AS verified,
  CASE WHEN r.product_id IS NOT NULL AND r.cost_cents > o.cost_cents THEN {say(basket.CHEAPEST, 'o.cost_cents', 'r.cost_cents', 'r.title', 'r.cost_cents - o.cost_cents')} WHEN r.product_id IS NOT NULL THEN {say(basket.TIED, 'r.title', 'o.cost_cents')}
    WHEN w.cheaper IS NOT NULL THEN {say(basket.BEST_MATCH, 'w.cheaper', 'o.cost_cents - w.cheaper_cost')} WHEN considered <= 1 THEN '{basket.ONLY_PRICED}' ELSE '{basket.ONLY_ACCEPTED}' END AS chosen_because,
  CASE WHEN r.product_id IS NOT NULL THEN concat_ws('|', r.product_id, r.title, r.cost_cents, r.packages, printf('%g', r.excess)) END AS runner_up, CASE WHEN r.product_id IS NULL THEN coalesce(w.some, '') END AS cheaper_but_worse, n_unresolved, coalesce(n_candidates, 0) AS n_candidates, coalesce(shown, '') AS shown, coalesce(out_of_stock, '') AS out_of_stock
  FROM asked a CROSS JOIN (SELECT CAST(r_regionkey AS BIGINT) AS store_id FROM region) s LEFT JOIN agg g ON g.{key} = a.{key} AND g.store_id = s.store_id LEFT JOIN owns o ON o.{key} = a.{key} AND o.store_id = s.store_id LEFT JOIN rivals r ON r.{key} = a.{key} AND r.store_id = s.store_id
  LEFT JOIN worst w ON w.{key} = a.{key} AND w.store_id = s.store_id LEFT JOIN away y ON y.{key} = a.{key} AND y.store_id = s.store_id),
said AS (SELECT {key}, store_id, state, reason, requested, {', '.join(f"CASE WHEN state = 'priced' THEN {c} END AS {c}" for c in TOLD)}, n_candidates, CASE WHEN state <> 'priced' THEN shown END AS candidates, out_of_stock FROM told)"""


TOLD = ("product_id", "title", "package_size", "packages", "package_price_cents", "cost_cents", "excess", "excess_note", "unit_price", "stock", "verified", "chosen_because", "runner_up", "cheaper_but_worse", "n_unresolved")
#: The list runner: lines of chosen lists, merged where they ask for one product, searched deep, gated and resolved at every store.
RUN_SQL = f"""{BASE_SQL}, {oracle('lines', 'stock')}, {LINE_SQL}, last AS (SELECT item_id, arg_max(stock_status, event_id) AS stock_status FROM fx_stock GROUP BY 1),
chosen AS (SELECT list_id, min(pos) AS pos, count(*) AS n_written, string_agg(text, '; ' ORDER BY pos) AS texts, min(matching_mode) AS matching_mode, CASE WHEN NOT bool_or(needs_review) THEN arg_min(text, pos) END AS text, round(sum(quantity), 6) AS asked, min(canonical_unit) AS asked_unit FROM typed WHERE list_id % 50 = 0
  GROUP BY list_id, CASE WHEN needs_review THEN concat('#', CAST(pos AS STRING)) ELSE concat(product, '|', canonical_unit, '|', matching_mode) END),
keyed_ AS (SELECT *, CASE WHEN text IS NOT NULL THEN concat(text, '|', CAST(CAST(asked AS BIGINT) AS VARCHAR)) END AS line FROM chosen), asked AS (SELECT DISTINCT line, text, asked, asked_unit FROM keyed_ WHERE line IS NOT NULL),
wanted AS (SELECT DISTINCT text FROM asked), {_tfidf('wanted', 'text', policies.LIST_DEPTH)},
candidates AS (SELECT w.line, f.store_id, f.product_id, p.raw_title AS title, f.score, p.size, p.unit, p.price_cents, CASE WHEN l.stock_status IS NOT NULL THEN {STOCK_SQL} END AS state FROM lx f JOIN asked w USING (text) JOIN prod p USING (store_id, product_id) LEFT JOIN last l ON l.item_id = f.product_id
  WHERE (p.dimension_ IS NULL OR p.dimension_ = CASE w.asked_unit WHEN 'oz' THEN 'weight' WHEN 'fl oz' THEN 'volume' ELSE 'count' END) AND p.size > 0 AND p.unit = w.asked_unit),
live AS (SELECT c.*, w.asked, CASE WHEN floor(w.asked / c.size) >= 1 AND w.asked / c.size <= floor(w.asked / c.size) * 1.01::DOUBLE THEN CAST(floor(w.asked / c.size) AS BIGINT) ELSE CAST(ceil(w.asked / c.size) AS BIGINT) END AS packages FROM candidates c JOIN asked w USING (line) WHERE c.state IS NULL OR c.state <> 'out_of_stock'),
{_explained('line', '{accept}', '{floor}')},
every AS (SELECT c.list_id, c.pos, c.n_written, c.texts, c.matching_mode, s.store_id, coalesce(d.state, 'review') AS state, d.* EXCLUDE (line, store_id, state) FROM keyed_ c CROSS JOIN (SELECT CAST(r_regionkey AS BIGINT) AS store_id FROM region) s LEFT JOIN said d ON d.line = c.line AND d.store_id = s.store_id),
basket AS (SELECT list_id, store_id, CAST(sum(n_written) AS BIGINT) AS n_written, count(*) AS n_lines, count(CASE WHEN state = 'priced' THEN 1 END) AS n_priced, count(CASE WHEN state = 'review' THEN 1 END) AS n_review, count(CASE WHEN state = 'missing' THEN 1 END) AS n_missing, CAST(CASE WHEN bool_and(state = 'priced') THEN sum(cost_cents) END AS BIGINT) AS total_cents FROM every GROUP BY 1, 2)"""
RUN_ACCEPT, RUN_FLOOR = 0.45, 0.25


RUN_SQL = RUN_SQL.replace("{accept}", str(RUN_ACCEPT)).replace("{floor}", str(RUN_FLOOR))


def list_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Merged lines of whole lists, and each distinct request explained at each store: search, dimension gate, size sufficiency, resolution."""
    items = products(spark, sf_dir)
    lines = lineparse.merge_lines(parsed_lines(spark, sf_dir).where("list_id % 50 = 0"))
    ask = F.when(~F.col("needs_review"), F.concat_ws("|", F.get("texts", 0), F.col("quantity").cast("long")))
    lines = settled(lines.select("list_id", "pos", F.col("n_lines").alias("n_written"), F.array_join("texts", "; ").alias("texts"), F.get("texts", 0).alias("text"), "matching_mode", ask.alias("line"), F.col("quantity").alias("asked"), F.col("canonical_unit").alias("asked_unit")))
    asked = lines.where("line is not null").select("line", "text", "asked", "asked_unit").distinct()
    dimension = F.when(F.col("asked_unit") == "oz", "weight").when(F.col("asked_unit") == "fl oz", "volume").otherwise("count")
    found = lexical_search(asked.select("text").distinct(), items, "text", policies.LIST_DEPTH, carry=("raw_title", "dimension_", "size", "unit", "price_cents")).drop("rank")
    found = found.withColumnRenamed("raw_title", "title").join(asked, "text")
    enough = gates.sufficiency(F.col("asked"), F.col("asked_unit"), F.col("size"), F.col("unit")) == "sufficient"
    found = found.where(gates.same_or_unknown(dimension, F.col("dimension_")) & enough)
    last = view(spark, sf_dir, "stock").groupBy(F.col("item_id").alias("product_id")).agg(F.max_by("stock_status", "event_id").alias("stock_status"))
    found = found.join(last, "product_id", "left").withColumn("state", F.when(F.col("stock_status").isNotNull(), stock_states.classify(F.col("stock_status"))["state"]))
    found = settled(found.select("line", "store_id", "product_id", "title", "score", "size", "unit", "price_cents", "state"))
    resolved = basket.resolve(asked.withColumn("needs_review", F.lit(False)), stores(spark, sf_dir), found, ["line"], RUN_ACCEPT, RUN_FLOOR)
    return lines, settled(basket.explain_lines(asked, found, resolved, ["line"], RUN_ACCEPT).join(resolved.select("line", "store_id", "excluded"), ["line", "store_id"]))


def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every merged line at every store; one to review has a row without a candidate."""
    lines, told = list_run(spark, sf_dir)
    own = ["list_id", "pos", "n_written", "texts", "matching_mode"]
    made = lines.where("line is not null").select(*own, "line").join(told, "line").drop("line")
    none = lines.where("line is null").select(*own).crossJoin(stores(spark, sf_dir)).withColumns({"state": F.lit("review"), "excluded": F.lit(0).cast("long")})
    return made.unionByName(none, allowMissingColumns=True)


@query(f"{RUN_SQL} SELECT *, coalesce(total_cents = min(total_cents) OVER (PARTITION BY list_id), false) AS is_winner FROM basket")
def list_end_to_end(spark, sf_dir):
    """From written lists to the stores that win: as many lines as were written, and as are left after merging."""
    rows = list_lines(spark, sf_dir)
    n = rows.groupBy("list_id", "store_id").agg(F.sum("n_written").alias("n_written"), F.count("*").alias("n_lines"))
    out = basket.compare(basket.totals(rows)).join(n, ["list_id", "store_id"])
    return out.select("list_id", "store_id", "n_written", "n_lines", "n_priced", "n_review", "n_missing", "total_cents", "is_winner")


@query(f"{RUN_SQL} SELECT * EXCLUDE (texts, n_written), CASE WHEN n_written > 1 THEN texts END AS merged_from FROM every")
def list_explanations(spark, sf_dir):
    return list_lines(spark, sf_dir).withColumn("merged_from", F.when(F.col("n_written") > 1, F.col("texts"))).drop("texts", "n_written", "excluded")


@query(f"""WITH {CANDIDATE_SQL.replace('o.size, o.unit, o.price_cents, CASE', 'o.raw_title AS title, o.size, o.unit, o.price_cents, CASE').replace('own AS (SELECT store_id, product_id,', 'own AS (SELECT store_id, product_id, raw_title,')}, {_explained('request', str(ACCEPT), str(FLOOR))} SELECT * FROM said""")
def line_explanations(spark, sf_dir):
    asked, own = settled(distinct_requests(spark, sf_dir)), named_products(spark, sf_dir)
    by = ["name", "store_id"]
    told = settled(basket.deciding(own, by, ACCEPT, 3, ("title",)))
    about = settled(basket.summary(own, by, ACCEPT))
    return basket.explain_lines(asked, met(asked, told), resolved_requests(spark, sf_dir, asked=asked, own=own), ["request"], ACCEPT, about=about, group=("name",))
