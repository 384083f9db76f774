"""Queries whose pairs grow faster than their tables: pairs must not be shuffled, sorted or written."""

from __spark_entry__ import queries
from pantryplan.operators import integrity

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_label_transitions_join_no_pairs(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, None, "b"), (4, "a", None)], "k long, before string, after string")
    got = {(r.before, r.after): r.n for r in integrity.transitions_in(rows).collect()}
    assert got == {("a", "b"): 2, (None, "b"): 1, ("a", None): 1}
    # the only join left is the one that makes the pairs
    assert plan(spark, "label_transitions").count("Join") == 1


def test_bands_and_bests_are_found_by_name_and_not_for_each_request(spark):
    for name in ("near_tie_select", "store_best"):
        lines = plan(spark, name).splitlines()
        windows = [line for line in lines if "Window" in line]
        assert windows and not any("request#" in line for line in windows), windows
        # requests meet what was found last: nothing is grouped or sorted above that join
        assert next(i for i, line in enumerate(lines) if "Join" in line) < next(i for i, line in enumerate(lines) if "Window" in line)


def test_baskets_are_explained_from_lines_that_are_dealt_once(spark):
    from pantryplan.operators import basket
    from pantryplan.plans import queries as plans

    rows = plans.dealt_lines(spark, SF)
    want = plans.resolved(spark, SF)
    assert sorted(map(str, rows.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {r.state for r in rows.select("state").distinct().collect()} == {"priced", "review", "missing"}
    told = basket.explain_all(rows)
    both = basket.explain(basket.compare(basket.totals(want)), want)
    assert sorted(map(str, told.collect())) == sorted(map(str, both.collect()))
    # behind the deal by list there is no other shuffle: five rows of stores of each line never travel
    told = queries()["basket_explanations"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in told and "Exchange" not in told[: told.index("REPARTITION_BY_NUM")].rsplit("Exchange", 1)[0].replace("BroadcastExchange", "")


def test_lexical_search_keeps_no_counts_and_ships_no_products(spark, monkeypatch):
    from pantryplan.operators import retrieval

    kept, settle = [], retrieval.settled
    monkeypatch.setattr(retrieval, "settled", lambda df: kept.append(df.columns) or settle(df))
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} same {'w1 ' * (i % 4)}") for i in range(60)] + [(3, "w1 again"), (70, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 same"), (2, "w5 nowhere"), (3, None)], "item_id long, text string")
    found = retrieval.tfidf_search(asked, docs, 4, "item_id", "doc_id")
    # a document of two rows is one
    import math
    import re
    from collections import Counter

    rows = docs.collect()
    tf = {}
    for r in rows:
        tf.setdefault(r.doc_id, Counter()).update(re.findall(r"\w{2,}", (r.text or "").lower()))
    df = Counter(t for c in tf.values() for t in c)
    unit = lambda c: {t: n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items() if t in df}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    want = []
    for q in asked.collect():
        a = unit(Counter(re.findall(r"\w{2,}", (q.text or "").lower())))
        scores = ((round(sum(x * unit(c).get(t, 0) for t, x in a.items()) / norm(a) / norm(unit(c)), 6), d) for d, c in tf.items() if a and c)
        want += [(q.item_id, d, s) for s, d in sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1]))[:4]]
    assert sorted((r.item_id, r.doc_id) for r in found.collect()) == sorted(w[:2] for w in want)
    assert max(abs(r.score - w[2]) for r, w in zip(sorted(found.collect()), sorted(want), strict=True)) <= 2e-6
    assert kept and not any("doc_id" in columns for columns in kept)
