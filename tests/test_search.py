import numpy as np
from pyspark.sql import functions as F

from pantryplan.operators import retrieval

SCHEMA = "id long, vec array<double>"


def test_tiles_keep_all_that_can_be_best():
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(30, 8)), rng.normal(size=(500, 8))
    x[100:200] = x[7]
    at, to, total = retrieval.tile_best(q, x, 5)
    for i in range(30):
        exact = [float(sum(a * b for a, b in zip(q[i], v))) for v in x]
        best = sorted((n for n in range(500) if round(exact[n], 6) > 0), key=lambda n: (-round(exact[n], 6), n))[:5]
        mine = {t: s for a, t, s in zip(at, to, total) if a == i}
        assert set(best) <= set(mine) and all(mine[n] == exact[n] for n in best)
    # copies don't add up: at most five of a hundred and one leave the tile
    assert max(np.isin(to[at == i], [7, *range(100, 200)]).sum() for i in range(30)) <= 5


def test_search_is_exact_and_sends_no_more_than_its_best(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(2000)] + [(3000, None), (3001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3002, [9.0]), (3003, [])]
    items = spark.createDataFrame(rows, SCHEMA)
    queries = items.where("id % 100 = 0 and id < 2000").select(F.col("id").alias("q"), F.col("vec").alias("qvec"))
    found = retrieval.vector_search(queries, items, 4, "q", "id").collect()
    for q in range(0, 2000, 100):
        score = {i: round(sum(a * b for a, b in zip(rows[q][1], rows[i][1])), 6) for i in range(2000)}
        best = sorted(score, key=lambda i: (-score[i], i))[:4]
        assert [r.id for r in sorted((r for r in found if r.q == q), key=lambda r: r.rank)] == best
    # 40,000 pairs, of which each block of items sends four a query
    assert retrieval.nearest(queries, items, 4, "q", "id").count() <= 20 * 4 * items.rdd.getNumPartitions() + 20


def test_tiles_share_a_bar(spark):
    """A task sends what its earlier tiles don't exclude, not the best of each tile; copies of vectors, of queries too, stay exact."""
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(6, 4096, 8)).round(3)
    vecs[3:] = vecs[2]
    rows = vecs.reshape(-1, 8)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], SCHEMA).coalesce(1)
    asked = items.where("id % 2000 = 0").select(F.col("id").alias("q"), F.col("vec").alias("qvec"))
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        sent = retrieval.nearest(asked, items, 40, "q", "id").count()
        found = retrieval.vector_search(asked.unionByName(asked.where("q = 0").withColumn("q", F.lit(-1))), items, 40, "q", "id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert sent < 13 * 40 * 5  # six tiles sent 13 * 40 * 6 and more
    at = {-1: 0} | {q: q for q in range(0, len(rows), 2000)}
    for q, i in at.items():
        score = np.round(sum(rows[i][d] * rows[:, d] for d in range(8)), 6)
        best = np.lexsort((np.arange(len(rows)), -score))[:40].tolist()
        assert [r.id for r in sorted((r for r in found if r.q == q), key=lambda r: r.rank)] == best


def test_nearest_kinds(spark):
    items = spark.createDataFrame([(i, i % 7 if i % 11 else None) for i in range(200)], "p long, kind int")
    asked = spark.createDataFrame([(1, 3), (2, 3), (3, 0), (4, None)], "q long, kind int")
    got = retrieval.nearest_kinds(asked, items, 40, "q", "p", "kind").collect()
    for q, kind in ((1, 3), (2, 3), (3, 0), (4, None)):
        far = lambda p: abs(kind - p % 7) if kind is not None and p % 11 else 99  # noqa: E731, B023
        assert [r.p for r in sorted((r for r in got if r.q == q), key=lambda r: r.rank)] == sorted(range(200), key=lambda p: (far(p), p))[:40]


def test_labels_of_pairs_are_those_of_the_view(spark):
    from pantryplan.plans import queries
    from pantryplan.plans.fixtures import view

    sf = "/root/testdata/sf0.001"
    every = view(spark, sf, "labels")
    pairs = spark.createDataFrame([tuple(r) for r in every.where("product_id % 7 = 1").select("request_id", "product_id").collect()], "request_id long, product_id long")
    got = queries.labels_of(spark, sf, pairs)
    assert sorted(got.collect()) == sorted(every.where("product_id % 7 = 1").collect())
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_equal_requests_are_one_lexical_search(spark, monkeypatch):
    from pantryplan.plans import policies

    texts = ["red pan", "red pan lid", "blue pot"]
    items = spark.createDataFrame([(s, str(p), texts[p % 3]) for s in range(2) for p in range(150)], "store_id long, product_id string, words string")
    asked = spark.createDataFrame([(i, f"{i % 9} x red pan") for i in range(40)] + [(90, "blue"), (91, "none of these")], "request_id long, text string")
    seen, top_k = [], retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda df, *a: (seen.append(df.count()), top_k(df, *a))[1])
    got = policies.lexical_search(asked, items, "request_id", 60).collect()
    first = lambda p: sorted([(s, str(n)) for s in range(2) for n in range(p, 150, 3)])
    for i in range(40):
        assert [(r.store_id, r.product_id) for r in sorted((r for r in got if r.request_id == i), key=lambda r: r.rank)] == first(0)[:60]
    assert [(r.store_id, r.product_id, r.score) for r in sorted((r for r in got if r.request_id == 90), key=lambda r: r.rank)] == [(*x, 0.707107) for x in first(2)[:60]]
    assert len(got) == 41 * 60
    # two searches meet three texts, of which no more than 60 rows each are ranked: not 41 requests by 300 products
    assert max(seen) <= 3 * 60
