import glob
import os
import random
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from pantryplan.operators import retrieval, runners, validation
from pantryplan.plans import fixtures
from pantryplan.sources import derived

VERSIONS = {"catalog_version_sha256": "c", "request_version": "r", "labeling_guideline_version": "g"}
DECISION = "request_id long, store_id long, product_id string, reviewer_label string, conservative_label string, is_best_guess boolean, catalog_version_sha256 string, request_version string, labeling_guideline_version string, request_content_sha256 string"
REQUEST = "request_id long, paraphrase_group long, answerability string, matching_mode string, content_sha256 string"


def run(spark, catalog, requests, pool, decisions, pilots=(1,), audits=()):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    catalog, requests, pool, decisions = df(catalog, "store_id long, product_id string"), df(requests, REQUEST), df(pool, "request_id long, store_id long, product_id string"), df(decisions, DECISION)
    sha = validation.digest(catalog, ["store_id", "product_id"]).first().sha256
    manifest = validation.manifest_findings({"catalog": (catalog.repartition(3), ["store_id", "product_id"])}, {"catalog": sha})
    found = [validation.pair_findings(catalog, requests, pool, decisions, VERSIONS), *validation.group_findings(catalog, requests, pool, decisions, df([(p,) for p in pilots], "request_id long"), df([(a,) for a in audits], "request_id long")), *manifest]
    return {r.check: (r.status, r.n, r.examples) for r in validation.report(found).collect()}


def good(i, p="a", label="Acceptable", guess=None, kept=None):
    return (i, 7, p, label, kept, guess, "c", "r", "g", f"h{i}")


def test_a_sound_benchmark_passes(spark):
    got = run(spark, [(7, "a"), (7, "b")], [(1, 1, "answerable", "exact", "h1"), (2, 2, "no_acceptable_match", "exact", "h2")], [(1, 7, "a"), (2, 7, "b")], [good(1), good(2, "b", "Incorrect")], audits=(2,))
    assert set(got) == set(validation.CHECKS) and all(v == ("info" if validation.CHECKS[k] != "fail" else "pass", 0, []) for k, v in got.items())


def test_each_fault_is_counted_and_the_least_examples_named(spark):
    requests = [(1, 1, "answerable", "exact", "h1"), (1, 1, "answerable", "exact", "h1"), (2, 1, "no_acceptable_match", "flexible", "h2"), (3, 3, "needs_clarification", "exact", "h3")]
    pool = [(1, 7, "a"), (1, 7, "a"), (1, 7, "a"), (2, 7, "a"), (3, 7, "zz")] + [(3, 7, f"m{i:02}") for i in range(15)]
    decisions = [good(1, label="Incorrect", guess=True, kept=""), good(2, label="Acceptable"), (3, 7, "zz", None, None, False, None, "r", "x", "h3"), good(3, "gone")]
    got = run(spark, [(7, "a"), (7, "a")] + [(7, f"m{i:02}") for i in range(15)], requests, pool, decisions, pilots=(1, 9))
    want = {
        "no_duplicate_request_ids": ("fail", 1, ["1"]), "pilot_ids_present_in_requests": ("fail", 1, ["9"]), "no_duplicate_catalog_identities": ("fail", 2, ["7|a"]), "every_pair_product_in_catalog": ("fail", 1, ["3|7|zz"]),
        "every_pair_has_a_decision": ("fail", 15, [f"3|7|m{i:02}" for i in range(10)]), "no_duplicate_pairs_within_a_pool": ("fail", 2, ["1|7|a"]), "all_reviewer_labels_valid": ("fail", 1, ["3|7|zz"]),
        "no_version_or_hash_mismatches": ("fail", 2, ["3|7|zz|catalog_version_sha256", "3|7|zz|labeling_guideline_version"]), "guessed_labels_carry_conservative_interpretation": ("fail", 3, ["1|7|a"]), "decisions_outside_current_pool": ("info", 1, ["3|7|gone"]),
        "no_paraphrase_group_label_conflicts": ("fail", 1, ["1|7|a|Acceptable,Incorrect"]), "pilot_groups_disjoint_from_non_pilot_requests": ("fail", 1, ["2"]), "every_no_match_request_has_an_audit_entry": ("fail", 1, ["2"]),
        "answerable_requests_with_no_known_positive_in_pool": ("warn", 1, ["1"]), "manifest_catalog_hash_matches_file": ("pass", 0, []), "manifest_decisions_hash_matches_file": ("pass", 0, []),
    }
    assert got == want


def test_digest(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    sha = lambda d: validation.digest(d, ["k", "v"]).first().sha256
    assert sha(df) == sha(df.repartition(5).orderBy(F.desc("k"))) and len({sha(df), sha(df.distinct()), sha(df.fillna("")), sha(df.limit(0)), sha(df.withColumn("v", F.lit("a")))}) == 5


def test_split_invariants_of_a_sound_split(spark):
    requests = spark.createDataFrame([(i, i // 2, "exact" if i % 4 < 2 else "flexible") for i in range(40)], "request_id long, paraphrase_group long, matching_mode string")
    split = F.when(F.col("paraphrase_group") < 12, "dev").when(F.col("paraphrase_group") < 16, "validation").otherwise("test")
    pins = spark.createDataFrame([(3, "dev")], "paraphrase_group long, pin string")
    shares = {"dev": 0.6, "validation": 0.2, "test": 0.2}
    assigned = requests.select("request_id", split.alias("split"))
    assert validation.split_invariants(requests, assigned, pins, shares).count() == 0
    assert validation.split_invariants(requests.limit(0), assigned.limit(0), pins, shares).count() == 0
    broken = {r.invariant for r in validation.split_invariants(requests, assigned.withColumn("split", F.when(F.col("request_id") == 6, "test").otherwise(F.col("split"))), pins, shares).collect()}
    assert broken == {"group_in_one_split", "pinned_group_in_its_split"}


def records(spark, baselines):
    rows = spark.range(3).select(F.lit("full_catalog").alias("experiment"), F.col("id").alias("request_id"), F.lit("answerable").alias("response"), F.lit(1).alias("n_survivors"), F.lit(0.5).alias("top_score"), F.lit("1/a").alias("ids"))
    return rows.crossJoin(baselines.select("baseline"))


def test_a_second_run_writes_what_is_missing(spark, tmp_path):
    path, planned = f"{tmp_path}/records", []
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "baseline string")

    def plan(todo):
        planned.append(sorted(r.baseline for r in todo.collect()))
        return records(spark, todo)

    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/baseline=*/part-*")}
    assert runners.write_missing(spark, path, names("a", "b"), plan) == 2
    first = files()
    assert runners.write_missing(spark, path, names("a", "b"), plan) == 0 and files() == first
    assert runners.write_missing(spark, path, names("a", "b", "c"), plan) == 1 and {f: t for f, t in files().items() if "baseline=c" not in f} == first
    assert runners.write_missing(spark, path, names("a", "b", "c"), plan, again=("b",)) == 1
    assert planned == [["a", "b"], ["c"], ["b"]]
    assert {f for f in files() if "baseline=a" in f} == {f for f in first if "baseline=a" in f}
    assert {r.baseline: r["count"] for r in runners.read_records(spark, path).groupBy("baseline").count().collect()} == {"a": 3, "b": 3, "c": 3}


def test_selection_delta_classes(spark):
    schema = "k string, product_id string, cost_cents long"
    before = spark.createDataFrame([("same", "p", 5), ("cheaper", "p", 5), ("dearer", "p", 5), ("even", "p", 5), ("lost", "p", 5), ("neither", "p", None), (None, "p", 3)], schema)
    after = spark.createDataFrame([("same", "p", 5), ("cheaper", "q", 4), ("dearer", "q", 6), ("even", "q", 5), ("gained", "q", 1), (None, "p", 2), ("elsewhere", "q", 1)], schema)
    every = spark.createDataFrame([(x,) for x in ("same", "cheaper", "dearer", "even", "lost", "gained", "neither", None)], "k string")
    got = runners.selection_delta(before, after, ["k"], every).collect()
    assert {r.k: r.change for r in got} == {x: x for x in ("same", "cheaper", "dearer", "even", "lost", "gained", "neither")} | {None: "cheaper"} and len(got) == 8
    assert {r.change: (r.n, r.saved_cents) for r in runners.delta_summary(runners.selection_delta(before, after, ["k"], every), []).collect()}["cheaper"] == (2, 2)


def test_appended_files_keep_their_own_time(spark, tmp_path):
    path = f"{tmp_path}/items"
    derived.append_rows(spark.createDataFrame([("1", None)], "item_id string, name string"), path)
    for f in glob.glob(f"{path}/*.parquet"):
        os.utime(f, (0, 86400))
    derived.append_rows(spark.createDataFrame([("2", "2026-03-04T05:06:07Z", 7), ("3", "", 8)], "item_id string, scraped_at string, price int"), path)
    got = {r.item_id: r for r in derived.read_appended(spark, path).collect()}
    assert got["1"].scraped_at == "1970-01-02T00:00:00Z" and got["1"].name == "" and got["1"].price == ""
    assert got["2"].scraped_at == "2026-03-04T05:06:07Z" and got["2"].price == "7" and got["3"].scraped_at > "2026"
    assert derived.read_appended(spark, path, ("price", "item_id", "later")).columns == ["price", "item_id", "later"]


def test_builds_are_counted(spark, tmp_path):
    built, rows = [], spark.createDataFrame([(1, "a"), (2, "b")], "nth int, text string")

    def build(df):
        built.append(1)
        return df.select(F.upper("text").alias("t"))

    load = lambda df, **params: sorted(r.t for r in derived.load_or_build(df, ["nth", "text"], {"v": 1} | params, f"{tmp_path}", build).collect())
    assert load(rows) == load(rows.repartition(2).orderBy(F.desc("nth"))) == ["A", "B"] and len(built) == 1
    assert load(rows, model="x") == ["A", "B"] and len(built) == 2
    assert load(rows.withColumn("nth", 3 - F.col("nth"))) == ["A", "B"] and len(built) == 3
    assert load(rows.withColumn("text", F.lit("c"))) == ["C", "C"] and len(built) == 4
    assert load(rows) == ["A", "B"] and len(built) == 4


def test_csv_keeps_quotes_and_line_ends(spark, tmp_path):
    rows = [(' "a", b\n', None, "x"), ("", "é", "y")]
    derived.write_csv(spark.createDataFrame(rows, "b string, a string, extra string"), f"{tmp_path}/c", ("a", "b"))
    assert sorted(tuple(r) for r in derived.read_csv(spark, f"{tmp_path}/c", ("a", "b")).collect()) == [("", ' "a", b\n'), ("é", "")]


def test_shares_at_a_half_digit_are_written_by_their_value(spark):
    # 439 of 2,000 is 0.2195, whose double lies above it; 1,561 of 2,000 is 0.7805, below
    requests = spark.range(2000).select(F.col("id").alias("request_id"), F.col("id").alias("paraphrase_group"), F.lit("exact").alias("matching_mode"))
    assigned = spark.range(2000).select(F.col("id").alias("request_id"), F.when(F.col("id") < 439, "dev").otherwise("test").alias("split"))
    pins = spark.createDataFrame([], "paraphrase_group long, pin string")
    got = {r.subject: r.detail for r in validation.split_invariants(requests, assigned, pins, {"dev": 0.6, "test": 0.2}).where("invariant = 'share_of_split'").collect()}
    assert got == {f"{m}|{s}": f"{n / 2000:.3f}" for m in ("exact", "all") for s, n in (("dev", 439), ("test", 1561))}


def brute(catalog, requests, pool, decisions, pilots, audits):
    """check: (n, examples) of what pool and decisions show, one row after the other."""
    found = defaultdict(list)
    text = lambda *c: "|".join(str(x) for x in c if x is not None)
    content, group = {}, {}
    for r, g, _, _, sha in requests:
        content[r] = min(sha, content.get(r, sha))
        group[r] = min(g, group.get(r, g))
    times, positive, labels = Counter(pool), set(), defaultdict(set)
    whole = lambda k: None not in k
    for key, n in times.items():
        on = [d for d in decisions if d[:3] == key and whole(key)]
        for d in on or [None]:
            if None in key[1:] or key[1:] not in catalog:
                found["every_pair_product_in_catalog"].append((text(*key), n))
            if n > 1:
                found["no_duplicate_pairs_within_a_pool"].append((text(*key), n - 1))
            if d is None:
                found["every_pair_has_a_decision"].append((text(*key), n))
                continue
            if d[3] not in ("Acceptable", "Needs clarification", "Incorrect"):
                found["all_reviewer_labels_valid"].append((text(*key, d[3]), n))
            wanted = zip(("catalog_version_sha256", "request_version", "labeling_guideline_version", "request_content_sha256"), (*VERSIONS.values(), content.get(key[0])), d[6:])
            found["no_version_or_hash_mismatches"] += [(text(*key, c), n) for c, want, has in wanted if want != has]
            if d[5] and not d[4]:
                found["guessed_labels_carry_conservative_interpretation"].append((text(*key), n))
            if d[3] == "Acceptable":
                positive.add(key[0])
            if key[0] in group and d[3] is not None:
                labels[group[key[0]], *key[1:]].add(d[3])
    found["decisions_outside_current_pool"] = [(text(*d[:3]), 1) for d in decisions if not whole(d[:3]) or d[:3] not in times]
    found["no_paraphrase_group_label_conflicts"] = [(text(*k, ",".join(sorted(v))), 1) for k, v in labels.items() if len(v) > 1]
    kinds = {r: min(q[2] for q in requests if q[0] == r) for r in content}
    found["answerable_requests_with_no_known_positive_in_pool"] = [(str(r), 1) for r in content if kinds[r] == "answerable" and r not in positive]
    return {c: (sum(n for _, n in rows), sorted({e for e, _ in rows})[:10]) for c, rows in found.items() if rows}


def test_checks_of_a_pool_agree_with_brute_force_however_it_is_dealt(spark, monkeypatch):
    pick, some = random.Random(5), lambda *values: pick.choice(values)
    requests = [(r, some(1, 2, 3), some("answerable", "needs_clarification"), "exact", f"h{r}") for r in [*range(12), 3, 3, 5]]
    key = lambda: (some(*range(14), None), some(1, 2, None), some("a", "b", "c", "é", None))
    pool = [key() for _ in range(300)]
    decisions = [(*key(), some("Acceptable", "Needs clarification", "Incorrect", "Maybe", "", None), some("", None, "Incorrect"), some(True, False, None), some("c", "x", None), some("r", None), "g", some("h1", "h2", "h3", None)) for _ in range(250)]
    catalog = {(s, p) for s in (1, 2) for p in "abé"} | {(1, None), (None, "a")}
    want = brute(catalog, requests, pool, decisions, (1,), ())
    assert len(want) == 9
    for rows in (50, 1_000_000):
        monkeypatch.setattr(retrieval, "TASK_ROWS", rows, raising=False)
        got = run(spark, sorted(catalog, key=str), requests, pool, decisions)
        assert {c: got[c][1:] for c in want} == want


def test_pairs_are_made_and_met_in_as_many_tasks_as_they_take(spark, tmp_path, monkeypatch):
    spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5)).alias("embedding"), F.lit(1).alias("label")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(retrieval, "TASK_ROWS", 10_000, raising=False)
    tables = {n: fixtures.view(spark, str(tmp_path), f"bench_{n}") for n in ("catalog", "requests", "pool", "decisions")}
    for name in ("pool", "decisions"):
        made = [r["count"] for r in tables[name].groupBy(F.spark_partition_id()).count().collect()]
        assert sum(made) > 170_000 and max(made) < 30_000
    met, settled = [], validation.settled
    monkeypatch.setattr(validation, "settled", lambda df: met.append(df) or settled(df))
    validation.pair_findings(*tables.values(), VERSIONS)
    plan = met[-1]._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression [store_id" in line]
    n = tables["pool"].count() + tables["decisions"].count()
    assert len(dealt) == 1 and int(dealt[0].split("], ")[-1].split(",")[0]) == -(-n // 10_000)


def test_a_key_is_never_cut_in_two():
    h = [-3] * 4 + [-1] * 9 + [0, 2, 2, 5]
    batch = lambda hs: pa.RecordBatch.from_arrays([pa.array(hs, pa.int64())], ["h"])
    tables = [t.column("h").to_pylist() for t in validation._whole_keys((batch(h[i : i + 3]) for i in range(0, len(h), 3)), 4)]
    assert sum(tables, []) == h and sum(len(set(t)) for t in tables) == len(set(h)) and len([t for t in tables if t]) > 2
