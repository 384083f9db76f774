"""Queries of benchmark validation, exports, splits and keys, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from pantryplan.operators import labelling, validation
from pantryplan.plans.fixtures import oracle, view
from pantryplan.plans.queries import query, read

VERSIONS = {"catalog_version_sha256": "c1", "request_version": "r1", "labeling_guideline_version": "g1"}
CATALOG_SHA_COLUMNS = ["store_id", "product_id"]


def _digest(table: str, columns: list[str]) -> str:
    """SQL of ``validation.digest``."""
    text = " || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in columns)
    return f"(SELECT sha256(concat(count(*), '|', coalesce(sum(('0x' || left(md5({text}), 12))::BIGINT), 0))) FROM {table})"


BENCH_SQL = f"""{oracle('bench_requests', 'bench_catalog', 'bench_pool', 'bench_decisions')},
rq AS (SELECT request_id, count(*) AS times, min(paraphrase_group) AS g, min(answerability) AS kind, min(content_sha256) AS content FROM fx_bench_requests GROUP BY 1),
pr AS (SELECT request_id, store_id, product_id, count(*) AS times FROM fx_bench_pool GROUP BY ALL), pilots AS (SELECT DISTINCT request_id FROM fx_bench_requests WHERE is_pilot UNION SELECT -7),
dp AS (SELECT pr.*, concat_ws('|', pr.request_id, pr.store_id, pr.product_id) AS key, d.request_id IS NOT NULL AS has, d.* EXCLUDE (request_id, store_id, product_id) FROM pr LEFT JOIN fx_bench_decisions d USING (request_id, store_id, product_id)),
pos AS (SELECT DISTINCT request_id FROM dp WHERE reviewer_label = 'Acceptable'),
gl AS (SELECT g, store_id, product_id, count(DISTINCT reviewer_label) AS kinds, string_agg(DISTINCT reviewer_label, ',' ORDER BY reviewer_label) AS labels FROM dp JOIN rq USING (request_id) GROUP BY 1, 2, 3),
found AS (SELECT 'no_duplicate_request_ids' AS "check", CAST(request_id AS VARCHAR) AS example, 1 AS n FROM rq WHERE times > 1
UNION ALL SELECT 'pilot_ids_present_in_requests', CAST(request_id AS VARCHAR), 1 FROM pilots WHERE request_id NOT IN (SELECT request_id FROM rq)
UNION ALL SELECT 'no_duplicate_catalog_identities', concat_ws('|', store_id, product_id), count(*) FROM fx_bench_catalog GROUP BY store_id, product_id HAVING count(*) > 1
UNION ALL SELECT 'every_pair_product_in_catalog', key, times FROM dp WHERE (store_id, product_id) NOT IN (SELECT (store_id, product_id) FROM fx_bench_catalog)
UNION ALL SELECT 'every_pair_has_a_decision', key, times FROM dp WHERE NOT has
UNION ALL SELECT 'no_duplicate_pairs_within_a_pool', key, times - 1 FROM dp WHERE times > 1
UNION ALL SELECT 'all_reviewer_labels_valid', concat_ws('|', key, reviewer_label), times FROM dp WHERE has AND coalesce(reviewer_label, '') NOT IN ('Acceptable', 'Needs clarification', 'Incorrect')
UNION ALL SELECT 'no_version_or_hash_mismatches', concat(key, '|catalog_version_sha256'), times FROM dp WHERE has AND catalog_version_sha256 IS DISTINCT FROM 'c1'
UNION ALL SELECT 'no_version_or_hash_mismatches', concat(key, '|request_version'), times FROM dp WHERE has AND request_version IS DISTINCT FROM 'r1'
UNION ALL SELECT 'no_version_or_hash_mismatches', concat(key, '|labeling_guideline_version'), times FROM dp WHERE has AND labeling_guideline_version IS DISTINCT FROM 'g1'
UNION ALL SELECT 'no_version_or_hash_mismatches', concat(key, '|request_content_sha256'), dp.times FROM dp JOIN rq USING (request_id) WHERE has AND request_content_sha256 IS DISTINCT FROM content
UNION ALL SELECT 'guessed_labels_carry_conservative_interpretation', key, times FROM dp WHERE is_best_guess AND coalesce(conservative_label, '') = ''
UNION ALL SELECT 'decisions_outside_current_pool', concat_ws('|', request_id, store_id, product_id), 1 FROM fx_bench_decisions WHERE (request_id, store_id, product_id) NOT IN (SELECT (request_id, store_id, product_id) FROM pr)
UNION ALL SELECT 'no_paraphrase_group_label_conflicts', concat_ws('|', g, store_id, product_id, labels), 1 FROM gl WHERE kinds > 1
UNION ALL SELECT 'pilot_groups_disjoint_from_non_pilot_requests', CAST(request_id AS VARCHAR), 1 FROM rq WHERE request_id NOT IN (SELECT request_id FROM pilots) AND g IN (SELECT g FROM rq SEMI JOIN pilots USING (request_id))
UNION ALL SELECT 'every_no_match_request_has_an_audit_entry', CAST(request_id AS VARCHAR), 1 FROM rq WHERE kind = 'no_acceptable_match' AND request_id % 100 <> 0
UNION ALL SELECT 'answerable_requests_with_no_known_positive_in_pool', CAST(request_id AS VARCHAR), 1 FROM rq WHERE kind = 'answerable' AND request_id NOT IN (SELECT request_id FROM pos)
UNION ALL SELECT 'manifest_catalog_hash_matches_file', concat('stale|', {_digest('fx_bench_catalog', CATALOG_SHA_COLUMNS)}), 1),
named AS (SELECT unnest([{', '.join(f"'{c}'" for c in validation.CHECKS)}]) AS "check", unnest([{', '.join(f"'{k}'" for k in validation.CHECKS.values())}]) AS kind),
sums AS (SELECT "check", CAST(sum(n) AS BIGINT) AS n, list(DISTINCT example ORDER BY example)[1:10] AS examples FROM found GROUP BY 1)"""


@query(f"""WITH {BENCH_SQL} SELECT "check", CASE WHEN kind = 'info' THEN 'info' WHEN n IS NULL THEN CASE WHEN kind = 'warn' THEN 'info' ELSE 'pass' END ELSE kind END AS status, coalesce(n, 0) AS n, array_to_string(coalesce(examples, []), ' ; ') AS examples FROM named LEFT JOIN sums USING ("check")""")
def benchmark_validation(spark, sf_dir):
    catalog, requests, pool, decisions = (view(spark, sf_dir, f"bench_{n}") for n in ("catalog", "requests", "pool", "decisions"))
    pilots = requests.where("is_pilot").select("request_id").unionByName(spark.range(1).select(F.lit(-7).cast("long").alias("request_id")))
    audits = requests.where("request_id % 100 = 0").select("request_id").distinct()
    stale = validation.manifest_findings({"catalog": (catalog, CATALOG_SHA_COLUMNS)}, {"catalog": "stale"})
    found = [*validation.findings(catalog, requests, pool, decisions, VERSIONS, pilots, audits), *stale]
    return validation.report(found).withColumn("examples", F.array_join("examples", " ; "))


@query(f"""WITH {oracle('bench_pool', 'bench_decisions')} SELECT request_id, store_id, product_id, reviewer_label, coalesce(conservative_label, reviewer_label) AS conservative_label, coalesce(is_best_guess, false) AS is_best_guess,
catalog_version_sha256, request_version, labeling_guideline_version FROM fx_bench_pool JOIN fx_bench_decisions USING (request_id, store_id, product_id)""")
def benchmark_pairs(spark, sf_dir):
    return validation.export_pairs(view(spark, sf_dir, "bench_pool"), view(spark, sf_dir, "bench_decisions"))


SHARES = {"dev": 0.6, "validation": 0.2, "test": 0.2}
#: An assignment that breaks each invariant.
ASSIGNED = """SELECT request_id, CASE WHEN request_id % 1900 = 50 THEN 'spare' WHEN paraphrase_group % 5 < 3 THEN 'dev' WHEN paraphrase_group = 4 AND request_id % 100 = 0 THEN 'dev' WHEN paraphrase_group % 5 = 3 AND matching_mode = 'flexible' THEN 'validation' ELSE 'test' END AS split
FROM {r} WHERE request_id % 1350 <> 200 UNION ALL SELECT -1, 'dev'"""
SPLIT_SQL = f"""{oracle('bench_requests')}, rq AS (SELECT request_id, min(paraphrase_group) AS g, min(matching_mode) AS mode FROM fx_bench_requests GROUP BY 1),
asg AS ({ASSIGNED.format(r='fx_bench_requests')}), j AS (SELECT a.request_id AS aid, r.*, split FROM rq r FULL JOIN asg a ON a.request_id = r.request_id),
gs AS (SELECT g, count(DISTINCT split) AS n, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM j WHERE g IS NOT NULL GROUP BY 1),
ms AS (SELECT coalesce(mode, 'all') AS mode, count(*) AS n FROM j WHERE mode IS NOT NULL GROUP BY GROUPING SETS ((mode), ())), hs AS (SELECT coalesce(mode, 'all') AS mode, split, count(*) AS n FROM j WHERE mode IS NOT NULL AND split IS NOT NULL GROUP BY GROUPING SETS ((mode, split), (split))),
sh AS (SELECT ms.mode, t.split, target, round(coalesce(hs.n, 0) / ms.n, 6) AS share FROM ms CROSS JOIN (VALUES ('dev', 0.6::DOUBLE), ('validation', 0.2::DOUBLE), ('test', 0.2::DOUBLE)) t(split, target) LEFT JOIN hs ON hs.mode = ms.mode AND hs.split = t.split)"""


@query(f"""WITH {SPLIT_SQL} SELECT 'group_in_one_split' AS invariant, CAST(g AS VARCHAR) AS subject, splits AS detail FROM gs WHERE n > 1
UNION ALL SELECT 'pinned_group_in_its_split', CAST(g AS VARCHAR), concat('dev>', splits) FROM gs WHERE g % 4 = 0 AND splits <> 'dev' UNION ALL SELECT 'every_request_assigned', CAST(request_id AS VARCHAR), '' FROM j WHERE g IS NOT NULL AND split IS NULL
UNION ALL SELECT 'only_requests_assigned', CAST(aid AS VARCHAR), split FROM j WHERE g IS NULL UNION ALL SELECT 'request_assigned_once', CAST(coalesce(request_id, aid) AS VARCHAR), CAST(count(*) AS VARCHAR) FROM j GROUP BY coalesce(request_id, aid) HAVING count(*) > 1
UNION ALL SELECT 'known_splits', split, CAST(count(*) AS VARCHAR) FROM j WHERE split = 'spare' GROUP BY split UNION ALL SELECT 'share_of_split', concat(mode, '|', split), printf('%.3f', share) FROM sh WHERE abs(share - target) > 0.1""")
def split_invariants(spark, sf_dir):
    requests = view(spark, sf_dir, "bench_requests")
    assigned = spark.sql(ASSIGNED, r=requests)
    once = requests.groupBy("request_id").agg(F.min("paraphrase_group").alias("paraphrase_group"), F.min("matching_mode").alias("matching_mode"))
    pins = once.where("paraphrase_group % 4 = 0").select("paraphrase_group", F.lit("dev").alias("pin")).distinct()
    return validation.split_invariants(once, assigned, pins, SHARES)


@query(f"""WITH {oracle('bench_requests')}, rq AS (SELECT DISTINCT request_id, paraphrase_group AS g, label, is_pilot FROM fx_bench_requests), s AS (SELECT g, string_agg(DISTINCT concat(label % 2, '|', label % 3), ';' ORDER BY concat(label % 2, '|', label % 3)) AS products, list(DISTINCT request_id) AS ids, bool_or(is_pilot) AS pinned FROM rq GROUP BY 1)
SELECT array_to_string(list_sort(list(g)), ',') AS groups, array_to_string(list_sort(flatten(list(ids))), ',') AS request_ids, products, count(CASE WHEN pinned THEN 1 END) AS n_pinned FROM s GROUP BY products HAVING count(*) > 1""")
def shared_references(spark, sf_dir):
    requests = view(spark, sf_dir, "bench_requests")
    references = requests.select("request_id", (F.col("label") % 2).alias("store_id"), (F.col("label") % 3).alias("product_id"))
    found = validation.shared_references(requests, references, requests.where("is_pilot").select("paraphrase_group"))
    return found.select(F.array_join(F.transform("groups", lambda g: g.cast("string")), ",").alias("groups"), F.array_join(F.transform("request_ids", lambda r: r.cast("string")), ",").alias("request_ids"), F.array_join("products", ";").alias("products"), "n_pinned")
