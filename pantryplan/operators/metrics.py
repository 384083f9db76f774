"""Match quality: label lookup, ranking metrics, confusion, sweeps and cut points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantryplan.operators.gates import outcome
from pantryplan.operators.retrieval import small

RESPONSES = ("answerable", "needs_clarification", "no_acceptable_match")


def first_label(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Of labels from several files the earliest: ``priority`` up."""
    return labels.groupBy(*keys).agg(F.min_by("label", F.struct("priority", "label")).alias("label"))


def first_given(sources: list[tuple[Column, Column]]) -> Column:
    """The same of sources that are columns of one row: the label of the first whose condition, that it has this row, holds. Nothing is shuffled."""
    (has, label), *rest = sources
    out = F.when(has, label)
    for has, label in rest:
        out = out.when(has, label)
    return out


def share(part: Column, whole: Column) -> Column:
    """NULL, not 0, where nothing was counted."""
    return F.round(F.try_divide(F.sum(F.when(part & whole, 1).otherwise(0)), F.sum(F.when(whole, 1).otherwise(0))), 6)


def ranking(results: DataFrame, labels: DataFrame, requests: DataFrame, key: str, item: str, k: int = 5) -> DataFrame:
    """A row a request: success at 1, hit and reciprocal rank at ``k``; no result counts as 0."""
    ok = results.where(F.col("rank") <= k).join(labels.select(key, item, "label"), [key, item], "left").withColumn("ok", F.coalesce(F.col("label") == "Acceptable", F.lit(False)))
    per = ok.groupBy(key).agg(F.min(F.when(F.col("ok"), F.col("rank"))).alias("first"))
    return requests.join(per, key, "left").select(*requests.columns, (F.col("first") == 1).alias("s"), "first").select(
        *requests.columns, F.coalesce(F.col("s").cast("int"), F.lit(0)).alias("success"), F.when(F.col("first").isNotNull(), 1).otherwise(0).alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr")
    )


def pool_recall(results: DataFrame, labels: DataFrame, requests: DataFrame, key: str, item: str, k: int = 5) -> DataFrame:
    """Share of a request's acceptable items among its ``k`` best; requests without any are NULL."""
    good = labels.where("label = 'Acceptable'").select(key, item)
    n = good.groupBy(key).agg(F.count("*").alias("n_good"))
    # results are few beside labels
    found = good.join(small(results.where(F.col("rank") <= k).select(key, item), 500_000), [key, item]).groupBy(key).agg(F.count("*").alias("n_found"))
    return requests.select(key).join(n, key, "left").join(found, key, "left").select(key, F.coalesce("n_good", F.lit(0)).alias("n_good"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.when(F.col("n_good") > 0, F.round(F.coalesce("n_found", F.lit(0)) / F.col("n_good"), 6)).alias("recall"))


def confusion(records: DataFrame) -> DataFrame:
    """All nine cells of truth by response, zeros too."""
    enum = records.sparkSession.createDataFrame([(r,) for r in RESPONSES], "x string")
    grid = enum.withColumnRenamed("x", "truth").crossJoin(enum.withColumnRenamed("x", "response"))
    counts = records.groupBy("truth", "response").agg(F.count("*").alias("n"))
    return grid.join(counts, ["truth", "response"], "left").select("truth", "response", F.coalesce("n", F.lit(0)).alias("n"))


def returns(records: DataFrame, by: list[str]) -> DataFrame:
    """Return coverage, false return and false abstention by group."""
    said, true = F.col("response") == "answerable", F.col("truth") == "answerable"
    return records.groupBy(*by).agg(share(said, F.lit(True)).alias("coverage"), share(said & ~true, ~true).alias("false_return"), share(~said & true, true).alias("false_abstention"))


def latency(records: DataFrame, by: list[str], ms: str) -> DataFrame:
    """Upper median, and the 95th percentile as the value at int(0.95 n) (none under 20 values)."""
    order = Window.partitionBy(*by).orderBy(ms)
    placed = records.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    return placed.groupBy(*by).agg(
        F.max("n").alias("n"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2) + 1, F.col(ms))).alias("median"),
        F.max(F.when((F.col("n") >= 20) & (F.col("i") == F.floor(F.col("n") * 95 / 100)), F.col(ms))).alias("p95"),
    )


def threshold_curve(records: DataFrame, steps: int = 16, wrong: float = 2.0, missed: float = 1.0) -> DataFrame:
    """Cost of each floor 0, 0.05, ... over records (score, is_ok, answerable): a wrong return and a missed answer cost."""
    grid = records.sparkSession.range(steps + 1).select(F.round(F.col("id") * 0.05, 2).alias("threshold"))
    # a constant grid, crossed with the records and folded at once
    at = records.crossJoin(F.broadcast(grid)).withColumn("returned", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))
    bad, miss = F.col("returned") & ~F.col("is_ok"), ~F.col("returned") & F.col("answerable")
    return at.groupBy("threshold").agg(F.sum(F.when(F.col("returned") & F.col("is_ok"), 1).otherwise(0)).alias("n_ok"), F.sum(F.when(bad, 1).otherwise(0)).alias("n_wrong"), F.sum(F.when(miss, 1).otherwise(0)).alias("n_missed"), F.round(F.sum(F.when(bad, wrong).when(miss, missed).otherwise(0.0)), 6).alias("cost"))


def best_threshold(curve: DataFrame) -> DataFrame:
    return curve.orderBy("cost", F.desc("n_ok"), "threshold").limit(1)


def returned_accuracy(records: DataFrame, by: list[str], label: str) -> DataFrame:
    """Of answered requests those that should be answered, with an acceptable first result; every answer counts below the line."""
    said = F.col("response") == "answerable"
    right = said & (F.col("truth") == "answerable") & F.coalesce(F.col(label) == "Acceptable", F.lit(False))
    return records.groupBy(*by).agg(F.count(F.when(said, 1)).alias("n"), F.count(F.when(right, 1)).alias("n_correct"), share(right, said).alias("accuracy"))


def success_bounds(records: DataFrame, by: list[str], label: str) -> DataFrame:
    """First results by what their label confirms; unlabelled ones are in the denominator alone."""
    said = F.col("response") == "answerable"
    count = lambda c: F.count(F.when(said & c, 1))
    out = records.groupBy(*by).agg(F.count("*").alias("n"), count(F.col(label) == "Acceptable").alias("confirmed_correct"), count(F.col(label) == "Incorrect").alias("confirmed_incorrect"), count(F.col(label) == "Needs clarification").alias("unresolved"))
    rate = lambda x: F.round(F.try_divide(x, F.col("n")), 6)
    return out.withColumns({"lower_bound": rate(F.col("confirmed_correct")), "upper_bound": rate(F.col("confirmed_correct") + F.col("unresolved"))})


def guess_exposure(records: DataFrame, by: list[str]) -> DataFrame:
    """How many answered first results rest on a guessed label."""
    said = F.col("response") == "answerable"
    return records.groupBy(*by).agg(F.count(F.when(said, 1)).alias("n_scored"), F.count(F.when(said & F.col("is_best_guess"), 1)).alias("n_guessed"))


def excluded(requests: DataFrame, audit: DataFrame) -> DataFrame:
    """request_id of dev requests without a match whose audit hasn't confirmed that there is none."""
    sure = audit.where(F.col("confidence").isin("confirmed", "confirmed by construction")).select("request_id")
    return requests.where("split = 'dev' and truth = 'no_acceptable_match'").select("request_id").join(sure, "request_id", "left_anti")


def cut(accept: Column | float, floor: Column | float) -> Column:
    """Outcome of a stored record: what was to be clarified stays for review, what had no result stays without."""
    no_answer = (F.col("response") != "answerable") | F.col("score").isNull()
    return F.when(F.col("response") == "needs_clarification", "review").when(no_answer, "no_match").otherwise(outcome(F.lit(False), F.col("score"), accept, floor))


def dev_grid(records: DataFrame, by: list[str], points: int = 17) -> DataFrame:
    """0 and ``points`` equal steps from the least to the greatest first score of answered records, by group."""
    ends = records.where("response = 'answerable' and score is not null").groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.round(F.col("lo") + i * (F.col("hi") - F.col("lo")) / (points - 1), 6))
    return ends.select(*by, F.explode(F.array_distinct(F.concat(F.array(F.lit(0.0)), steps))).alias("value"))


def cut_surface(records: DataFrame, by: list[str], review_costs: tuple[float, ...], label: str) -> DataFrame:
    """Average cost of each pair accept >= floor of a group's grid at each cost of a review.

    A wrong answer costs 2 and a missed one 1. The grid is some eighteen values a
    group, so a record is held against 171 pairs and folded at once.
    """
    grid = dev_grid(records, by)
    pairs = grid.withColumnRenamed("value", "accept").join(grid.withColumnRenamed("value", "floor"), by).where("floor <= accept")
    at = records.join(F.broadcast(pairs), by).withColumn("out", cut(F.col("accept"), F.col("floor")))
    right = (F.col("truth") == "answerable") & F.coalesce(F.col(label) == "Acceptable", F.lit(False))
    cost = F.when(F.col("out") == "accept", F.when(right, 0.0).otherwise(2.0)).when((F.col("out") == "no_match") & (F.col("truth") == "answerable"), 1.0).otherwise(0.0)
    count = lambda c: F.count(F.when(c, 1))
    folded = at.groupBy(*by, "accept", "floor").agg(F.count("*").alias("n"), count(F.col("out") == "accept").alias("n_accept"), count(F.col("out") == "review").alias("n_review"), count(F.col("out") == "no_match").alias("n_no_match"), count((F.col("out") == "accept") & right).alias("n_correct"), F.sum(F.when(F.col("out") == "review", 0.0).otherwise(cost)).alias("cost"))
    costs = F.explode(F.array(*map(F.lit, review_costs))).alias("review_cost")
    return folded.select("*", costs).withColumn("avg_cost", F.round((F.col("cost") + F.col("n_review") * F.col("review_cost")) / F.col("n"), 9)).drop("cost")


def best_cut(surface: DataFrame, by: list[str]) -> DataFrame:
    """The cheapest pair; of equals the one with more correct answers, the narrower band, the lower cut."""
    order = F.struct("avg_cost", (-F.col("n_correct")).alias("c"), (F.col("accept") - F.col("floor")).alias("w"), "accept")
    return surface.groupBy(*by).agg(F.min_by(F.struct("accept", "floor", "avg_cost", "n_correct", "n_accept", "n_review", "n_no_match"), order).alias("b")).select(*by, "b.*")


def outcome_report(records: DataFrame, by: list[str], accept: float, floor: float, labels: dict[str, str], criterion: float = 0.95) -> DataFrame:
    """Outcomes of each group and the precision of automatic matches by label view; NULL where nothing was accepted."""
    at = records.withColumn("out", cut(accept, floor))
    said = F.col("out") == "accept"
    count = lambda c: F.count(F.when(c, 1))
    right = {v: said & (F.col("truth") == "answerable") & F.coalesce(F.col(c) == "Acceptable", F.lit(False)) for v, c in labels.items()}
    n = [F.count("*").alias("n"), count(said).alias("n_accept"), count(F.col("out") == "review").alias("n_review"), count(F.col("out") == "no_match").alias("n_no_match")]
    unjudged = count(said & F.col(next(iter(labels.values()))).isNull()).alias("n_unjudged")
    out = at.groupBy(*by).agg(*n, unjudged, *(share(r, said).alias(f"precision_{v}") for v, r in right.items()))
    return out.withColumns({f"meets_{v}": F.coalesce(F.col(f"precision_{v}") >= criterion, F.lit(False)) for v in labels})


def ranking_views(results: DataFrame, labels: DataFrame, requests: DataFrame, key: str, item: str, views: dict[str, str], by: list[str], k: int = 5) -> DataFrame:
    """Success, hit and reciprocal rank by label view and every subset of ``by``: a long table, NULL where an axis is summed up.

    Results are joined with their labels once for all views.
    """
    judged = results.where(F.col("rank") <= k).join(labels.select(key, item, *views.values()), [key, item], "left")
    per = judged.groupBy(key).agg(*(F.min(F.when(F.col(c) == "Acceptable", F.col("rank"))).alias(v) for v, c in views.items()))
    rows = requests.select(key, *by).join(per, key, "left").select(*by, F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(v).alias("first")) for v in views))).alias("x")).select(*by, "x.*")
    # the view is kept, the other axes are summed up in every way
    sets = rows.withColumn("s", F.coalesce((F.col("first") == 1).cast("int"), F.lit(0))).withColumn("h", F.col("first").isNotNull().cast("int"))
    out = sets.cube("view", *by).agg(F.grouping("view").alias("all_views"), F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("success"), F.round(F.avg("h"), 6).alias("hit"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
    return out.where("all_views = 0").drop("all_views")


def outcome_rates(records: DataFrame, by: list[str], accept: float, floor: float) -> DataFrame:
    """The partition of each group, and of every sum of groups, in rates; and automatic matches that only the practical view takes for right."""
    out = cut(accept, floor)
    rows = records.withColumn("out", out)
    said = F.col("out") == "accept"
    rate = lambda what: F.round(F.avg((F.col("out") == what).cast("int")), 6)
    ok = lambda c: F.coalesce(F.col(c) == "Acceptable", F.lit(False))
    only = said & (F.col("truth") == "answerable") & ok("practical_label") & ~ok("conservative_label")
    return rows.cube(*by).agg(F.count("*").alias("n"), rate("accept").alias("automatic_match_rate"), rate("review").alias("review_rate"), rate("no_match").alias("abstention_rate"), F.count_if(only).alias("n_practical_only"), (F.count_if(F.col("out").isin("accept", "review", "no_match")) == F.count("*")).alias("sums_to_one"))
