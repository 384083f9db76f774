"""Match policies: search, then gates in one fixed order, then a response for each request.

Every policy takes tables: ``requests`` (request_id, needs_review, dimension, asked,
asked_unit, mode, brand, variants) and ``found`` (request_id, store_id, product_id,
score, and the product's dimension_, size, unit, brand_ and variants_). A request
without candidates is a row too. Equal scores are ordered by store_id and product_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantryplan.functions import identity
from pantryplan.operators import gates

TOP = 5
#: Candidates that a gated policy asks of its retriever, and each retriever of a hybrid.
DEPTH, HYBRID_DEPTH, LIST_DEPTH = max(TOP * 4, 20), 50, 400
ID = ["store_id", "product_id"]
# The notes of a matched line; where the parser has a reason for its review, that is the note.
AMBIGUOUS, UNCONFIRMED, SOME_UNCONFIRMED = "ambiguous request", "could not confirm brand or variant for this request", "some candidates could not be identity-confirmed"
NOTHING = "no product in the snapshot satisfies this request above the {:.2f} score floor"


def catalog_text(title: Column, brand: Column, variants: Column) -> Column:
    """What a product is searched by."""
    return F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(brand, F.lit("")), F.coalesce(variants, F.lit(""))))


def gated(requests: DataFrame, found: DataFrame, size: bool = True, by_identity: bool = False) -> DataFrame:
    """Candidates with ``tag`` keep, review or drop: dimension first, then size, then identity."""
    both = found.join(requests.drop("needs_review"), "request_id")
    passes = gates.same_or_unknown(F.col("dimension"), F.col("dimension_"))
    if size:
        passes = passes & gates.size_fits(F.col("asked"), F.col("asked_unit"), F.col("size"), F.col("unit"))
    if by_identity:
        conflict = identity.variants_conflict(F.col("variants"), F.col("variants_"))
        tag = gates.identity(F.col("mode"), F.col("brand"), F.col("brand_"), conflict)
    else:
        tag = F.lit("keep")
    return both.withColumn("tag", F.when(passes, tag).otherwise("drop")).where("tag <> 'drop'")


def decide(requests: DataFrame, tagged: DataFrame, floor: float | Column = 0.0, k: int = TOP, by: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """``by``, response, n_survivors and the ids of the ``k`` best of each request that is answered.

    A line to review asks for clarification, and so does one all of whose candidates
    are gone and some for want of a known identity; no survivor, or none that reaches
    the floor, is no match.
    """
    kept = tagged.where("tag = 'keep'")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), *ID))
    best = kept.withColumn("place", place).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.max("score").alias("top"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= k, F.struct("place", F.concat_ws("/", *ID).alias("id"))))).alias("ids"),
    )
    unsure = tagged.groupBy(*by).agg(F.bool_or(F.col("tag") == "review").alias("unsure"))
    out = requests.join(best, list(by), "left").join(unsure, list(by), "left")
    response = (
        F.when(F.col("needs_review"), "needs_clarification")
        .when(F.col("n").isNull(), F.when(F.coalesce("unsure", F.lit(False)), "needs_clarification").otherwise("no_acceptable_match"))
        .when(F.col("top") < floor, "no_acceptable_match")
        .otherwise("answerable")
    )
    out = out.withColumn("response", response)
    answered = F.col("response") == "answerable"
    ids = F.array_join(F.transform("ids", lambda x: x["id"]), ",")
    n = F.when(F.col("needs_review"), 0).otherwise(F.coalesce("n", F.lit(0)))
    return out.select(*by, "response", n.alias("n_survivors"), F.when(answered, F.col("top")).alias("top_score"), F.when(answered, ids).alias("ids"))


def refloored(decided: DataFrame, floor: float) -> DataFrame:
    """Records made without a floor, answered anew at one: nothing is searched again."""
    low = (F.col("response") == "answerable") & (F.col("top_score") < floor)
    return decided.withColumns({"response": F.when(low, "no_acceptable_match").otherwise(F.col("response")), "ids": F.when(low, None).otherwise(F.col("ids")), "top_score": F.when(low, None).otherwise(F.col("top_score"))})


def line_matches(requests: DataFrame, tagged: DataFrame, floor: float = 0.35) -> DataFrame:
    """The demo's answer: the best product of each store above a floor; response and note come with every request.

    ``requests`` have ``review_reason``, the parser's, which is the note of a line to review.
    """
    kept = tagged.where((F.col("tag") == "keep") & (F.col("score") >= floor))
    place = F.row_number().over(Window.partitionBy("request_id", "store_id").orderBy(F.desc("score"), "product_id"))
    best = kept.withColumn("place", place).where("place = 1").select("request_id", "store_id", "product_id", "score")
    unsure = tagged.groupBy("request_id").agg(F.bool_or(F.col("tag") == "review").alias("unsure"))
    asked = requests.select("request_id", "needs_review", "review_reason").join(unsure, "request_id", "left").withColumn("unsure", F.coalesce("unsure", F.lit(False)))
    best = best.join(asked.where("not needs_review"), "request_id", "left_semi").withColumn("hit", F.lit(True))
    out = asked.join(best, "request_id", "left")
    response = F.when(F.col("needs_review"), "needs_clarification").when(F.col("hit"), "answerable").when(F.col("unsure"), "needs_clarification").otherwise("no_acceptable_match")
    note = (
        F.when(F.col("needs_review"), F.coalesce(F.nullif("review_reason", F.lit("")), F.lit(AMBIGUOUS)))
        .when(F.col("hit"), F.when(F.col("unsure"), SOME_UNCONFIRMED).otherwise(""))
        .otherwise(F.when(F.col("unsure"), UNCONFIRMED).otherwise(NOTHING.format(floor)))
    )
    return out.select("request_id", "store_id", "product_id", "score", response.alias("response"), note.alias("note"))


def simple_comparison(matches: DataFrame, prices: DataFrame, stores: DataFrame) -> DataFrame:
    """A store's subtotal at one package a line; complete if all answerable lines, and one at least, have a match there.

    Only stores that are complete and have a price for every match are ranked, by
    subtotal and name. Every list of ``matches`` has a row a store.
    """
    lines = matches.where("response = 'answerable'")
    n = matches.select("list_id").distinct().join(lines.select("list_id", "request_id").distinct().groupBy("list_id").agg(F.count("*").alias("n_answerable")), "list_id", "left").fillna({"n_answerable": 0})
    held = lines.join(prices, ID, "left").groupBy("list_id", "store_id").agg(F.count("*").alias("n_matched"), F.coalesce(F.sum("price_cents"), F.lit(0)).alias("subtotal_cents"), F.bool_and(F.col("price_cents").isNotNull()).alias("fully_priced"))
    # the stores are a short list
    grid = n.crossJoin(stores.select("store_id", "store_name"))
    out = grid.join(held, ["list_id", "store_id"], "left").fillna({"n_matched": 0, "subtotal_cents": 0}).withColumn("fully_priced", F.coalesce("fully_priced", F.lit(True)))
    out = out.withColumn("complete", (F.col("n_answerable") > 0) & (F.col("n_matched") == F.col("n_answerable")))
    ranked = F.col("complete") & F.col("fully_priced")
    order = Window.partitionBy("list_id", ranked).orderBy("subtotal_cents", "store_name", "store_id")
    return out.withColumn("rank", F.when(ranked, F.row_number().over(order))).drop("store_name")


def violations(top: DataFrame) -> DataFrame:
    """Conflicts of an accepted first result, derived anew from request and product; a NULL on either side is none.

    Reads brand, variants, dimension, asked, asked_unit and mode of the request, and
    brand_, variants_, dimension_, size and unit of the product.
    """
    exact = (F.col("mode") == "exact") & F.col("brand").isNotNull() & F.col("brand_").isNotNull()
    brand = exact & identity.brand_prefix_conflict(F.col("brand"), F.col("brand_"))
    size = (F.col("asked_unit") == F.col("unit")) & (F.abs(F.col("size") - F.col("asked")) / F.col("asked") > gates.SIZE_TOLERANCE)
    tags = [("brand_conflict", brand), ("variant_conflict", identity.variants_conflict(F.col("variants"), F.col("variants_"))), ("dimension_conflict", F.col("dimension") != F.col("dimension_")), ("size_conflict", size)]
    return top.withColumn("violations", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in tags))))
