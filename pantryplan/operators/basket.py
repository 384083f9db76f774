"""Basket arithmetic: packages, cheapest accepted product, store totals, winners.

Money is BIGINT cents; an overflow raises. Selection looks only at candidates
within ``BAND`` of the best accepted score, then at cost, excess, score and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantryplan.operators.gates import outcome
from pantryplan.operators.retrieval import small

TOLERANCE = 0.01
BAND = 0.01
# Why a package was chosen, and what is said of its excess; {} are titles and amounts.
CHEAPEST, TIED = "cheapest accepted option: {}c against {}c for {}, a {}c difference", "tied on cost with {} at {}c; broken by less excess, then by match score"
BEST_MATCH = "best match among accepted options; {} is {}c cheaper but scores further from the request than the near-tie band (0.01) allows"
ONLY_PRICED, ONLY_ACCEPTED = "the only candidate that could be priced", "the only accepted candidate"
LEAVES = "buying {} package(s) leaves {} {} more than requested"


def filled(template: str, *values: Column) -> Column:
    """A text with its ``{}`` replaced; null if a value is."""
    parts = template.split("{}")
    return F.concat(F.lit(parts[0]), *(x for v, p in zip(values, parts[1:], strict=True) for x in (v.cast("string"), F.lit(p))))


def packages_needed(asked: Column, size: Column) -> Column:
    """Whole packages; an overshoot of up to a hundredth of the whole number is rounding."""
    q = asked / size
    whole = F.floor(q).cast("long")
    return F.when((asked > 0) & (size > 0), F.when((whole >= 1) & (q <= whole * (1 + TOLERANCE)), whole).otherwise(F.ceil(q).cast("long")))


def arithmetic(df: DataFrame) -> DataFrame:
    """packages, cost_cents and excess where units are known and equal, else NULL."""
    usable = (F.col("asked_unit") == F.col("unit")) & F.col("asked").isNotNull() & F.col("size").isNotNull() & (F.col("price_cents") >= 0)
    out = df.withColumn("packages", F.when(usable, packages_needed(F.col("asked"), F.col("size"))))
    return out.withColumn("cost_cents", F.col("packages") * F.col("price_cents")).withColumn("excess", F.when(F.col("packages").isNotNull(), F.round(F.greatest(F.lit(0.0), F.col("packages") * F.col("size") - F.col("asked")), 6)))


def unit_price(cents: Column, total: Column) -> Column:
    return F.try_divide(cents, total)


def near_tie(df: DataFrame, by: list[str], accept: float) -> DataFrame:
    """Adds ``in_band``: accepted and within ``BAND`` of the group's best accepted score."""
    ok = F.col("score") >= accept
    best = F.max(F.when(ok, F.col("score"))).over(Window.partitionBy(*by))
    return df.withColumn("in_band", F.coalesce(ok & (F.round(best - F.col("score"), 9) <= BAND), F.lit(False)))


def select(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``place`` among the priced rows of the band: 1 is chosen, 2 the runner-up; NULL for the others."""
    priced = F.col("in_band") & F.col("cost_cents").isNotNull()
    order = Window.partitionBy(*by, priced).orderBy("cost_cents", "excess", F.desc("score"), "product_id")
    return df.withColumn("place", F.when(priced, F.row_number().over(order)))


def cheapest(priced: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in ``order``."""
    return priced.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("place = 1").drop("place")


def deciding(products: DataFrame, by: list[str], accept: float | None = None, cheaper: int = 0, also: tuple[str, ...] = ()) -> DataFrame:
    """Of products that requests meet as a group (``by``), those that can decide anything in ``resolve``, with ``weight``, for how many products of the group a row stands.

    Products of one score, size and unit differ for a request by price and id alone, so
    only the first two by these can be chosen or runner-up: the number of rows depends on how many
    sizes there are, not on how many products. Those without a price or size count
    by their score, and those out of stock by their number.

    The best score of a group is the same for every request, and so is the band. With
    ``accept`` given, products of the band differ by size, price and score: two of a size
    and unit stay, of the accepted ones outside the band the ``cheaper`` first, and the best score is a row by itself.
    """
    gone = F.coalesce(F.col("state") == "out_of_stock", F.lit(False))
    usable = ~gone & F.col("unit").isNotNull() & (F.col("size") > 0) & (F.col("price_cents") >= 0)
    kind = F.when(gone, "gone").when(usable, "usable").otherwise("unpriced")
    rows = products.withColumn("__kind", F.coalesce(kind, F.lit("unpriced")))
    if accept is None:
        order = Window.partitionBy(*by, "score", "size", "unit").orderBy("price_cents", "product_id")
        first = rows.where("__kind = 'usable'").withColumn("__n", F.row_number().over(order)).where("__n <= 2")
        rest = rows.where("__kind = 'unpriced'").groupBy(*by, "score").agg(F.lit(None).cast("string").alias("state"))
    else:
        rest = rows.where("__kind <> 'gone'").groupBy(*by).agg(F.max("score").alias("score"), F.lit(None).cast("string").alias("state"))
        top = rest.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("score").alias("__best"))
        near = rows.where((F.col("__kind") == "usable") & (F.col("score") >= accept)).join(small(top), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
        near = near.withColumn("__in", F.round(F.col("__best") - F.col("score"), 9) <= BAND)
        order = Window.partitionBy(*by, "size", "unit", "__in").orderBy("price_cents", F.desc("score"), "product_id")
        first = near.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= F.when(F.col("__in"), 2).otherwise(cheaper))
    out = rows.where("__kind = 'gone'").groupBy(*by).agg(F.count("*").alias("weight")).withColumn("state", F.lit("out_of_stock"))
    both = first.select(*by, "product_id", "score", "size", "unit", "price_cents", "state", *also).unionByName(rest, allowMissingColumns=True)
    return both.withColumn("weight", F.lit(1).cast("long")).unionByName(out, allowMissingColumns=True)


def summary(products: DataFrame, by: list[str], accept: float, top: int = 5) -> DataFrame:
    """What an explanation says of all products of a group, whatever is asked: how many there are, how many are accepted and, by unit, can be priced, the ``top`` best and those out of stock."""
    gone = F.coalesce(F.col("state") == "out_of_stock", F.lit(False))
    ok, usable = F.col("score") >= accept, F.col("unit").isNotNull() & (F.col("size") > 0) & (F.col("price_cents") >= 0)
    live = products.where(~gone)
    n = live.groupBy(*by).agg(F.count("*").alias("n_candidates"), F.count(F.when(ok, 1)).alias("n_accepted"))
    units = live.where(ok & usable).groupBy(*by, "unit").agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("unit", "n"))).alias("priceable"))
    first = live.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "product_id"))).where(F.col("__i") <= top)
    shown = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "product_id"))), lambda x: x["product_id"]).alias("shown"))
    away = products.where(gone).groupBy(*by).agg(F.array_sort(F.collect_set("product_id")).alias("out_of_stock"))
    return n.join(units, by, "left").join(shown, by, "left").join(away, by, "full_outer")


def resolve(requests: DataFrame, stores: DataFrame, candidates: DataFrame, keys: list[str], accept: float, floor: float) -> DataFrame:
    """A row for each request and store, those without candidates too.

    ``requests``: keys, needs_review, asked, asked_unit. ``candidates``: keys, store_id,
    product_id, score, size, unit, price_cents, state, and a weight where they come from
    ``deciding``. Products out of stock leave first; state is priced, review or missing.
    """
    by = [*keys, "store_id"]
    live = candidates.where("state is null or state <> 'out_of_stock'").join(requests.select(*keys, "asked", "asked_unit"), keys)
    placed = select(near_tie(arithmetic(live), by, accept), by)
    best = placed.groupBy(*by).agg(
        F.max("score").alias("top_score"),
        F.max(F.when(F.col("place") == 1, F.struct("product_id", "packages", "cost_cents", "excess", F.coalesce("state", F.lit("unverified")).alias("stock")))).alias("chosen"),
        F.max(F.when(F.col("place") == 2, F.col("product_id"))).alias("runner_up"),
    )
    weight = F.sum("weight") if "weight" in candidates.columns else F.count("*")
    out_of_stock = candidates.where("state = 'out_of_stock'").groupBy(*by).agg(weight.alias("excluded"))
    # the stores are a short list, crossed with the requests so that a missing one is a row
    grid = requests.select(*keys, "needs_review").crossJoin(stores.select("store_id"))
    cut = outcome(F.col("needs_review"), F.col("top_score"), accept, floor)
    state = F.when(cut == "no_match", "missing").when((cut == "accept") & F.col("chosen").isNotNull(), "priced").otherwise("review")
    out = grid.join(best, by, "left").join(out_of_stock, by, "left").withColumn("state", state)
    priced = F.col("state") == "priced"
    pick = [F.when(priced, F.col(f"chosen.{c}")).alias(c) for c in ("product_id", "packages", "cost_cents", "excess", "stock")]
    return out.select(*by, "state", *pick, F.when(priced, F.col("runner_up")).alias("runner_up"), F.coalesce("excluded", F.lit(0)).alias("excluded"))


def override(resolved: DataFrame, choices: DataFrame) -> DataFrame:
    """Choices made by hand win over any state; everything about the line is computed anew.

    ``choices``: list_id, pos, store_id, product_id, asked, asked_unit, size, unit,
    price_cents, stock. A choice that can't be priced (no amount asked, no size, or
    other units) is an error. The runner-up of the old choice goes.
    """
    by = ["list_id", "pos", "store_id"]
    priced = arithmetic(choices)
    failed = F.raise_error(F.concat(F.lit("an override can't be priced: product "), F.coalesce("product_id", F.lit("?")), F.lit(" for list "), F.col("list_id").cast("string")))
    cost = F.when(F.col("cost_cents").isNull(), failed.cast("long")).otherwise(F.col("cost_cents"))
    fields = ["product_id", "packages", "cost_cents", "excess", "stock"]
    hand = priced.withColumn("cost_cents", cost).select(*by, F.lit(True).alias("by_hand"), *(F.col(c).alias(f"h_{c}") for c in fields))
    out = resolved.join(hand, by, "left").withColumn("by_hand", F.coalesce("by_hand", F.lit(False)))
    new = {c: F.when(F.col("by_hand"), F.col(f"h_{c}")).otherwise(F.col(c)) for c in fields}
    new |= {"state": F.when(F.col("by_hand"), "priced").otherwise(F.col("state")), "runner_up": F.when(~F.col("by_hand"), F.col("runner_up"))}
    return out.withColumns(new).drop(*(f"h_{c}" for c in fields)).withColumnRenamed("by_hand", "overridden")


def totals(resolved: DataFrame, *more: Column) -> DataFrame:
    """A basket for each list and store, with ``more`` aggregates of its lines; without a total unless every line is priced."""
    count = lambda c: F.count(F.when(c, 1))
    state = F.col("state")
    out = resolved.groupBy("list_id", "store_id").agg(
        count(state == "priced").alias("n_priced"), count(state == "review").alias("n_review"), count(state == "missing").alias("n_missing"),
        count((state == "priced") & (F.col("stock") != "unverified")).alias("n_verified"), F.sum("excluded").alias("n_excluded"), F.sum("cost_cents").alias("priced_cents"), *more,
    )
    complete = (F.col("n_priced") > 0) & (F.col("n_review") + F.col("n_missing") == 0)
    return out.withColumn("complete", complete).withColumn("total_cents", F.when(complete, F.col("priced_cents"))).drop("priced_cents")


def compare(baskets: DataFrame) -> DataFrame:
    """Rank of complete stores by total, whether each wins and whether the win is shared."""
    whole = Window.partitionBy("list_id")
    least = F.min("total_cents").over(whole)
    wins = F.coalesce(F.col("total_cents") == least, F.lit(False))
    order = Window.partitionBy("list_id").orderBy(F.asc_nulls_last("total_cents"), "store_id")
    out = baskets.withColumn("rank", F.when(F.col("complete"), F.row_number().over(order))).withColumn("is_winner", wins)
    out = out.withColumn("is_tie", F.col("is_winner") & (F.sum(F.col("is_winner").cast("int")).over(whole) > 1))
    return out.withColumn("no_winner_reason", F.when(least.isNull(), "no store can complete this basket"))


def number(x: Column) -> Column:
    """A number as it is shown to shoppers: six significant digits, no zeros at the end."""
    digits = F.greatest(F.lit(5) - F.floor(F.log10(F.abs(x))), F.lit(0)).cast("int")
    short = F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits))
    return F.regexp_replace(F.regexp_replace(short.cast("decimal(24,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def because(chosen_cost: Column, considered: Column, rival: Column, rival_cost: Column, cheaper: Column, cheaper_cost: Column) -> Column:
    """Why a package was chosen: from the runner-up in the band, or a cheaper one outside it, by their titles and costs."""
    delta = rival_cost - chosen_cost
    return (
        F.when(rival.isNotNull() & (delta > 0), filled(CHEAPEST, chosen_cost, rival_cost, rival, delta))
        .when(rival.isNotNull(), filled(TIED, rival, chosen_cost))
        .when(cheaper.isNotNull(), filled(BEST_MATCH, cheaper, chosen_cost - cheaper_cost))
        .when(considered <= 1, ONLY_PRICED)
        .otherwise(ONLY_ACCEPTED)
    )


def explain_lines(requests: DataFrame, candidates: DataFrame, resolved: DataFrame, keys: list[str], accept: float, top: int = 5, cheaper: int = 3, about: DataFrame | None = None, group: tuple[str, ...] = ()) -> DataFrame:
    """An explanation of each resolved request at each store.

    Priced lines tell the package, its price and unit price, excess and stock, why it was
    chosen, and the runner-up, or else up to ``cheaper`` accepted packages outside the band
    that cost less; others show the ``top`` best candidates. Out-of-stock products are
    listed for both. ``candidates`` have product_id, title, score, size, unit,
    price_cents and state: all of a request, at most as many as a search returns, or those
    of ``deciding``. With these goes ``about``, the ``summary`` of all products by the columns ``group`` of the requests, and store.
    """
    by, group = [*keys, "store_id"], list(group) or keys
    about = summary(candidates, by, accept, top) if about is None else about
    live = candidates.where("state is null or state <> 'out_of_stock'").join(requests.select(*keys, "asked", "asked_unit"), keys)
    placed = select(near_tie(arithmetic(live), by, accept), by)
    chosen = lambda n: F.max(F.when(F.col("place") == n, F.struct("product_id", "title", "size", "unit", "price_cents", "packages", "cost_cents", "excess")))
    own_cost = F.max(F.when(F.col("place") == 1, F.col("cost_cents"))).over(Window.partitionBy(*by))
    out_of_band = (F.col("score") >= accept) & ~F.col("in_band") & (F.col("cost_cents") < F.col("own_cost"))
    best = placed.withColumn("own_cost", own_cost).groupBy(*by).agg(
        chosen(1).alias("own"), chosen(2).alias("rival"),
        F.slice(F.array_sort(F.collect_list(F.when(out_of_band, F.struct("cost_cents", "excess", (-F.col("score")).alias("s"), "product_id", "title")))), F.lit(1), F.lit(cheaper)).alias("cheaper"),
    )
    out = resolved.drop("product_id", "packages", "cost_cents", "excess", "runner_up").join(best, by, "left").join(requests.select(*dict.fromkeys([*keys, *group]), "asked", "asked_unit"), keys, "left").join(about, [*group, "store_id"], "left")
    considered = F.when(F.col("asked") > 0, F.coalesce(F.try_element_at("priceable", F.col("asked_unit")), F.lit(0))).otherwise(F.lit(0))
    out = out.withColumn("considered", considered).withColumn("n_unresolved", F.col("n_accepted") - F.col("considered"))
    priced = F.col("state") == "priced"
    reason = F.when(F.col("state") == "missing", "no candidate cleared the review floor").when(F.col("state") == "review", "candidates shown, not priced")
    first = F.get("cheaper", 0)
    rest = F.array_join(F.transform("cheaper", lambda c: F.concat(c["product_id"], F.lit(":"), c["cost_cents"].cast("string"))), ",")
    fields = {
        "product_id": F.col("own.product_id"), "title": F.col("own.title"), "package_size": F.concat_ws(" ", number(F.col("own.size")), "own.unit"), "packages": F.col("own.packages"), "package_price_cents": F.col("own.price_cents"),
        "cost_cents": F.col("own.cost_cents"), "excess": F.col("own.excess"), "excess_note": F.when(F.col("own.excess") != 0, filled(LEAVES, F.col("own.packages"), number(F.col("own.excess")), F.col("own.unit"))),
        "unit_price": F.round(unit_price(F.col("own.price_cents"), F.col("own.size")), 6), "stock": F.col("stock"), "verified": F.col("stock") != "unverified",
        "chosen_because": because(F.col("own.cost_cents"), F.col("considered"), F.col("rival.title"), F.col("rival.cost_cents"), first["title"], first["cost_cents"]),
        "runner_up": F.when(F.col("rival").isNotNull(), F.concat_ws("|", "rival.product_id", "rival.title", F.col("rival.cost_cents").cast("string"), F.col("rival.packages").cast("string"), number(F.col("rival.excess")))),
        "cheaper_but_worse": F.when(F.isnull("rival"), rest), "n_unresolved": F.col("n_unresolved"),
    }
    return out.select(
        *by, "state", reason.alias("reason"), F.concat_ws(" ", number(F.col("asked")), "asked_unit").alias("requested"), *(F.when(priced, c).alias(n) for n, c in fields.items()), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.when(~priced, F.array_join(F.coalesce("shown", F.array().cast("array<string>")), ",")).alias("candidates"), F.array_join(F.coalesce("out_of_stock", F.array().cast("array<string>")), ",").alias("out_of_stock"),
    )


def _lines() -> Column:
    return F.array_sort(F.collect_list(F.struct("pos", "state", "product_id", "packages", "cost_cents", "excess", "stock", "runner_up"))).alias("lines")


def explain(compared: DataFrame, resolved: DataFrame) -> DataFrame:
    """A JSON document for each list and store: total, completeness, counts of lines and of verified ones, and its lines in the order of the list."""
    return _documents(compared.join(resolved.groupBy("list_id", "store_id").agg(_lines()), ["list_id", "store_id"]))


def explain_all(resolved: DataFrame) -> DataFrame:
    """``explain`` for all baskets of resolved lines, which are read once: where they are dealt by list, nothing is shuffled."""
    return _documents(compare(totals(resolved, _lines())))


def _documents(compared: DataFrame) -> DataFrame:
    counts = F.struct(
        F.col("n_priced").alias("priced"), F.col("n_review").alias("review"), F.col("n_missing").alias("missing"), F.col("n_verified").alias("verified"), (F.col("n_priced") - F.col("n_verified")).alias("unverified"), F.col("n_excluded").alias("out_of_stock_excluded"),
    ).alias("counts")
    return compared.select("list_id", "store_id", F.to_json(F.struct("complete", "total_cents", "rank", "is_winner", counts, "lines")).alias("explanation"))
