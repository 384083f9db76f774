from pyspark.sql import functions as F

from pantryplan.operators import basket, policies
from pantryplan.sources import catalog
from pantryplan.streaming import snapshots


def test_only_priced_stores_are_ranked(spark):
    kind = "list_id long, request_id long, store_id long, product_id string, response string"
    rows = [(1, 1, 1, "a", "answerable"), (1, 1, 2, "b", "answerable"), (1, 1, 3, "c", "answerable"), (1, 2, 1, "d", "answerable"), (1, 2, 2, "e", "answerable"), (1, 2, 3, "f", "answerable"), (1, 3, None, None, "needs_clarification"), (2, 4, None, None, "no_acceptable_match")]
    prices = spark.createDataFrame([(1, "a", None), (1, "d", 1), (2, "b", 500), (2, "e", 100), (3, "c", 200), (3, "f", 400)], "store_id long, product_id string, price_cents long")
    stores = spark.createDataFrame([(1, "Z"), (2, "Y"), (3, "X"), (4, "W")], "store_id long, store_name string")
    got = {(r.list_id, r.store_id): (r.complete, r.fully_priced, r.subtotal_cents, r.rank) for r in policies.simple_comparison(spark.createDataFrame(rows, kind), prices, stores).collect()}
    # a store with an unknown price isn't cheapest; ties go by name; a list without an answerable line is complete nowhere
    assert got[1, 1] == (True, False, 1, None) and got[1, 2] == (True, True, 600, 2) and got[1, 3] == (True, True, 600, 1) and got[1, 4] == (False, True, 0, None)
    assert [got[2, s] for s in (1, 2, 3, 4)] == [(False, True, 0, None)] * 4


def test_notes_of_matches(spark):
    asked = spark.createDataFrame([(1, True, "vague quantity"), (2, True, ""), (3, False, ""), (4, False, ""), (5, False, ""), (6, False, "")], "request_id long, needs_review boolean, review_reason string")
    tagged = spark.createDataFrame([(3, 1, "a", 0.9, "keep"), (3, 1, "b", 0.9, "review"), (4, 1, "a", 0.9, "review"), (5, 1, "a", 0.1, "keep"), (6, 1, "a", 0.9, "keep")], "request_id long, store_id long, product_id string, score double, tag string")
    got = {r.request_id: (r.response, r.note) for r in policies.line_matches(asked, tagged).collect()}
    assert got == {
        1: ("needs_clarification", "vague quantity"), 2: ("needs_clarification", "ambiguous request"), 3: ("answerable", "some candidates could not be identity-confirmed"), 4: ("needs_clarification", "could not confirm brand or variant for this request"),
        5: ("no_acceptable_match", "no product in the snapshot satisfies this request above the 0.35 score floor"), 6: ("answerable", ""),
    }


def test_explanations_of_one_request(spark):
    asked = spark.createDataFrame([("r", 16.0, "oz", False)], "line string, asked double, asked_unit string, needs_review boolean")
    kind = "line string, store_id long, product_id string, title string, score double, size double, unit string, price_cents long, state string"
    rows = [
        ("r", 1, "a", "Best", 0.90, 12.0, "oz", 300, "in_stock"), ("r", 1, "b", "Second", 0.895, 16.0, "oz", 700, None), ("r", 1, "c", "Gone", 0.99, 16.0, "oz", 1, "out_of_stock"),
        ("r", 2, "a", "Best", 0.90, 16.0, "oz", 500, None), ("r", 2, "b", "Cheap", 0.80, 16.0, "oz", 400, None), ("r", 2, "d", "Cheaper", 0.80, 16.0, "oz", 300, None), ("r", 2, "e", "No size", 0.9, None, "oz", 300, None),
        ("r", 3, "a", "Low", 0.2, 16.0, "oz", 500, None),
    ]
    found, stores = spark.createDataFrame(rows, kind), spark.createDataFrame([(1,), (2,), (3,), (4,)], "store_id long")
    resolved = basket.resolve(asked, stores, found, ["line"], 0.75, 0.1)
    got = {r.store_id: r for r in basket.explain_lines(asked, found, resolved, ["line"], 0.75).collect()}
    one, two, three, four = (got[i] for i in (1, 2, 3, 4))
    assert (one.product_id, one.packages, one.package_price_cents, one.cost_cents, one.excess_note, one.verified, one.out_of_stock) == ("a", 2, 300, 600, "buying 2 package(s) leaves 8 oz more than requested", True, "c")
    assert one.chosen_because == "cheapest accepted option: 600c against 700c for Second, a 100c difference" and one.runner_up == "b|Second|700|1|0" and one.cheaper_but_worse is None and one.package_size == "12 oz" and one.requested == "16 oz"
    assert two.chosen_because == "best match among accepted options; Cheaper is 200c cheaper but scores further from the request than the near-tie band (0.01) allows" and two.cheaper_but_worse == "d:300,b:400"
    assert two.runner_up is None and two.n_unresolved == 1 and two.verified is False and two.excess_note is None
    assert (three.state, three.candidates, three.title) == ("review", "a", None) and (four.state, four.reason, four.n_candidates) == ("missing", "no candidate cleared the review floor", 0)


def test_complete_groups(spark):
    rows = spark.createDataFrame([("a", i % 12) for i in range(30)] + [("b", i) for i in range(9)] * 3 + [("c", i) for i in range(10)], "g string, k int")
    got = sorted((r.g, r.k) for r in catalog.complete_groups(rows, "g", "k").collect())
    assert got == [("a", i) for i in range(10)] + [("c", i) for i in range(10)]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    files, table, checkpoint = (f"{tmp_path}/{x}" for x in ("files", "table", "checkpoint"))
    add = lambda rows: spark.createDataFrame(rows, snapshots.SCHEMA).write.mode("append").parquet(files)
    state = lambda: {r.item_id: (r.snapshot_id, r.state) for r in snapshots.current(snapshots.kept_states(spark, table)).collect()}
    add([("x", 1, "d1", "Out of stock"), ("y", 2, "d1", "Many in stock")])
    snapshots.keep_up(spark, files, table, checkpoint).awaitTermination()
    assert state() == {"x": ("d1", "out_of_stock"), "y": ("d1", "many_in_stock")}
    add([("x", 4, "d2", "In stock (3)"), ("y", 0, "d0", "Out of stock")])
    snapshots.keep_up(spark, files, table, checkpoint).awaitTermination()
    # y isn't in the newest snapshot, and its late row changes nothing
    assert state() == {"x": ("d2", "in_stock")}
    assert {r.item_id: r.snapshot_id for r in snapshots.kept_states(spark, table).collect()} == {"x": "d2", "y": "d1"}


def test_overlay_keeps_what_details_do_not_say(spark):
    items = spark.createDataFrame([("1", "a", "b"), ("2", "a", "b")], "item_id string, u string, v string")
    details = spark.createDataFrame([("1", "", "new"), ("3", "x", "x")], "item_id string, u string, v string")
    assert sorted(tuple(r) for r in catalog.overlay(items, details, "item_id", ["u", "v"]).select("item_id", "u", "v").collect()) == [("1", "a", "new"), ("2", "a", "b")]
    assert catalog.overlay(items, details, "item_id", ["u"]).where(F.col("v") != "b").count() == 0


def test_products_that_decide_resolve_as_all_do(spark):
    import random

    from pantryplan.operators import basket

    rng = random.Random(11)
    rows = [("n", rng.randrange(2), str(i), rng.choice([0.5, 0.8, 0.804, 0.9]), rng.choice([None, 0.0, 8.0, 16.0]), rng.choice([None, "oz", "ct"]), rng.choice([None, -1, 100, 150, 200]), rng.choice([None, "out_of_stock", "in_stock"])) for i in range(3000)]
    own = spark.createDataFrame(rows, "name string, store_id int, product_id string, score double, size double, unit string, price_cents long, state string")
    asked = spark.createDataFrame([(f"r{a}{u}", "n", False, a, u) for a in (1.0, 16.0, 40.0, 0.0) for u in ("oz", "ct", "lb")], "request string, name string, needs_review boolean, asked double, asked_unit string")
    told = basket.deciding(own, ["name", "store_id"])
    stores = spark.createDataFrame([(0,), (1,), (2,)], "store_id int")
    made = [basket.resolve(asked, stores, asked.select("request", "name").join(p, "name").drop("name"), ["request"], 0.75, 0.45).orderBy("request", "store_id").collect() for p in (own, told)]
    assert made[0] == made[1] and any(r.runner_up for r in made[0])
    # four scores of two sizes and units make at most two rows each, however many products there are
    assert told.count() <= 2 * (4 * 2 * 2 * 2 + 4 + 1)


def test_explanations_from_products_that_decide_are_those_from_all(spark):
    import random

    rng = random.Random(13)
    rows = [("n", rng.randrange(2), str(i), f"t{i}", rng.choice([0.5, 0.8, 0.804, 0.808, 0.812]), rng.choice([None, 0.0, 8.0, 16.0]), rng.choice([None, "oz", "ct"]), rng.choice([None, -1, *range(100, 160)]), rng.choice([None, "out_of_stock", "in_stock"])) for i in range(2000)]
    own = spark.createDataFrame(rows, "name string, store_id int, product_id string, title string, score double, size double, unit string, price_cents long, state string")
    asked = spark.createDataFrame([(f"r{a}{u}", "n", False, a, u) for a in (1.0, 16.0, 40.0, 0.0) for u in ("oz", "ct", "lb")], "request string, name string, needs_review boolean, asked double, asked_unit string")
    stores, by = spark.createDataFrame([(0,), (1,), (2,)], "store_id int"), ["name", "store_id"]
    told = basket.deciding(own, by, 0.75, 3, ("title",))
    every, few = (asked.select("request", "name").join(p, "name").drop("name") for p in (own, told))
    one, two = (basket.resolve(asked, stores, p, ["request"], 0.75, 0.45).orderBy("request", "store_id") for p in (every, few))
    assert one.collect() == two.collect()
    about = basket.summary(own, by, 0.75)
    first, second = basket.explain_lines(asked, every, one, ["request"], 0.75), basket.explain_lines(asked, few, two, ["request"], 0.75, about=about, group=("name",))
    assert first.orderBy("request", "store_id").collect() == second.orderBy("request", "store_id").collect()
    assert first.where("cheaper_but_worse like '%,%' or runner_up is not null").count() > 0
    # by store two in the band and three outside it of each size and unit, the best score and those out of stock
    assert told.count() <= 2 * (2 * 2 * 5 + 2)
