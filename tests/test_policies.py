import pytest
from pyspark.sql import functions as F

from pantryplan.functions import identity
from pantryplan.operators import basket, metrics, policies
from pantryplan.sources import catalog


def test_numbers_as_shown(spark):
    values = [0.0, 12.0, 12.5, 0.3, 1.0 / 3, 123456.7]
    got = [r.s for r in spark.createDataFrame([(v,) for v in values], "v double").select(basket.number(F.col("v")).alias("s")).collect()]
    assert got == [f"{v:g}" for v in values]


def test_why_a_package_was_chosen(spark):
    rows = [(100, 3, "B", 120, None, None), (100, 3, "B", 100, None, None), (100, 3, None, None, "C", 90), (100, 1, None, None, None, None), (100, 2, None, None, None, None)]
    df = spark.createDataFrame(rows, "c long, n long, r string, rc long, o string, oc long")
    got = [r.w for r in df.select(basket.because(*map(F.col, ("c", "n", "r", "rc", "o", "oc"))).alias("w")).collect()]
    assert got == [
        "cheapest accepted option: 100c against 120c for B, a 20c difference",
        "tied on cost with B at 100c; broken by less excess, then by match score",
        "best match among accepted options; C is 10c cheaper but scores further from the request than the near-tie band (0.01) allows",
        "the only candidate that could be priced",
        "the only accepted candidate",
    ]


def test_override_computes_anew_or_raises(spark):
    fields = "list_id long, pos int, store_id long"
    old = spark.createDataFrame([(1, 1, 0, "review", "p", 3, 300, 5.0, "q", "in_stock", 0), (1, 2, 0, "priced", "x", 1, 100, 0.0, None, "in_stock", 0)], f"{fields}, state string, product_id string, packages long, cost_cents long, excess double, runner_up string, stock string, excluded long")
    kind = f"{fields}, product_id string, asked double, asked_unit string, size double, unit string, price_cents long, stock string"
    hand = spark.createDataFrame([(1, 1, 0, "n", 20.0, "oz", 12.0, "oz", 250, "unverified")], kind)
    got = {r.pos: r for r in basket.override(old, hand).collect()}
    r = got[1]
    assert (r.state, r.product_id, r.packages, r.cost_cents, r.excess, r.runner_up, r.stock, r.overridden) == ("priced", "n", 2, 500, 4.0, None, "unverified", True)
    assert (got[2].product_id, got[2].overridden) == ("x", False)
    bad = spark.createDataFrame([(1, 1, 0, "n", None, "oz", 12.0, "oz", 250, "unverified")], kind)
    with pytest.raises(Exception, match="can't be priced"):
        basket.override(old, bad).collect()


def test_variants_and_request_brands(spark):
    titles = [("Horizon Organic 2% Milk Sea Salt 12 oz", "Horizon"), ("Vanilla. low fat", None), ("Whole Foods whole milk", "Whole Foods"), (None, None)]
    got = [r.v for r in spark.createDataFrame(titles, "t string, b string").select(identity.variant_tokens(F.col("t"), F.col("b")).alias("v")).collect()]
    assert got == [["milk", "organic", "sea-salt"], ["low-fat", "vanilla"], ["milk"], []]
    lexicon = spark.createDataFrame([("Chobani", 9), ("Chobani Flip", 5), ("Acme Dry", 6)], "gram string, n long")
    asks = spark.createDataFrame([(1, "2 Chobani Flip cups"), (2, "12 oz Barissimo coffee"), (3, "some Acme Dry beans"), (4, "milk"), (5, None)], "id long, text string")
    got = {r.id: r.brand for r in identity.request_identity(asks, lexicon, "id", "text").collect()}
    assert got == {1: "Chobani Flip", 2: "Barissimo", 3: "Acme", 4: None, 5: None}


def test_snapshots_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "d1"), (1, "b", "d1"), (1, "a", "d2"), (2, "c", "d1")], "store_id long, item string, at string")
    assert sorted(r.item for r in catalog.latest_snapshot(rows, "at").collect()) == ["a"]
    assert sorted(r.item for r in catalog.latest_snapshot(rows, "at", ["store_id"]).collect()) == ["a", "c"]
    assert catalog.latest_snapshot(rows.limit(0), "at").count() == 0
    rows.withColumnRenamed("at", "run").write.partitionBy("run").parquet(str(tmp_path / "runs"))
    assert [r.item for r in catalog.latest_run(spark, str(tmp_path / "runs")).collect()] == ["a"]
    with pytest.raises(ValueError):
        catalog.markdown(spark.range(catalog.REPORT_ROWS + 1))
    assert catalog.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |"


def test_identity_review_and_floors(spark):
    asked = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "request_id long, needs_review boolean")
    tagged = spark.createDataFrame([(1, 0, "a", 0.5, "keep"), (1, 1, "b", 0.5, "keep"), (2, 0, "a", 0.9, "review"), (3, 0, "a", 0.9, "keep")], "request_id long, store_id long, product_id string, score double, tag string")
    got = {r.request_id: (r.response, r.ids) for r in policies.decide(asked, tagged).collect()}
    assert got == {1: ("answerable", "0/a,1/b"), 2: ("needs_clarification", None), 3: ("needs_clarification", None), 4: ("no_acceptable_match", None)}
    again = {r.request_id: r.response for r in policies.refloored(policies.decide(asked, tagged), 0.6).collect()}
    assert again[1] == "no_acceptable_match" and again[2] == "needs_clarification"


def test_cut_keeps_the_meaning_of_a_response(spark):
    rows = spark.createDataFrame([("needs_clarification", 0.9), ("no_acceptable_match", 0.9), ("answerable", None), ("answerable", 0.9), ("answerable", 0.5), ("answerable", 0.1)], "response string, score double")
    assert [r.o for r in rows.select(metrics.cut(0.75, 0.45).alias("o")).collect()] == ["review", "no_match", "no_match", "accept", "review", "no_match"]
