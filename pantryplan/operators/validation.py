"""Validation and export of a labelled benchmark, and invariants of its splits.

Findings are rows, never errors: a check has a status, the number of what offends and
the ten least examples of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantryplan.operators.labelling import LABELS, OK
from pantryplan.operators.retrieval import small, tasks_for
from pantryplan.sources.settle import settled

PAIR = ("request_id", "store_id", "product_id")
VERSIONS = ("catalog_version_sha256", "request_version", "labeling_guideline_version", "request_content_sha256")
# The checks of a benchmark, and what a finding of each means.
CHECKS = {
    "manifest_catalog_hash_matches_file": "fail", "manifest_decisions_hash_matches_file": "fail", "no_duplicate_request_ids": "fail", "pilot_ids_present_in_requests": "fail", "no_duplicate_catalog_identities": "fail",
    "every_pair_product_in_catalog": "fail", "every_pair_has_a_decision": "fail", "no_duplicate_pairs_within_a_pool": "fail", "all_reviewer_labels_valid": "fail", "no_version_or_hash_mismatches": "fail",
    "guessed_labels_carry_conservative_interpretation": "fail", "decisions_outside_current_pool": "info", "no_paraphrase_group_label_conflicts": "fail", "pilot_groups_disjoint_from_non_pilot_requests": "fail",
    "every_no_match_request_has_an_audit_entry": "fail", "answerable_requests_with_no_known_positive_in_pool": "warn",
}
#: Of these, what pool and decisions show of several rows; and requests with a known positive, which are no finding.
OF_GROUPS, POSITIVE = ("decisions_outside_current_pool", "no_paraphrase_group_label_conflicts"), "known_positive"
#: Where a row comes from.
LISTED, POOLED, DECIDED = 0, 1, 2
#: Rows of pairs that a task looks at together.
CHUNK = 250_000


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row with ``sha256``: of the number of rows and of a sum over their hashes, so that neither their order nor their partitions matter. To make order count, give a column of it."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    number = F.conv(F.left(F.md5(text), F.lit(12)), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").alias("total")).select(F.sha2(F.concat_ws("|", "n", "total"), 256).alias("sha256"))


def _key(*columns: str) -> Column:
    return F.concat_ws("|", *(F.col(c).cast("string") for c in columns))


class Tally:
    """n and the least ``examples`` examples of each check; of ``whole`` checks all examples."""

    def __init__(self, examples: int = 10, whole: tuple[str, ...] = ()):
        self.examples, self.whole, self.n, self.least = examples, whole, Counter(), {}

    def add(self, check: str, examples: pa.Array, n: int) -> None:
        kept = self.least.setdefault(check, set())
        self.n[check] += n
        if examples.null_count:
            kept.add(None)
        known = kept - {None}
        full = check not in self.whole and len(known) >= self.examples
        known.update(pc.unique(examples.filter(pc.less(examples, max(known))) if full else examples.drop_null()).to_pylist())
        self.least[check] = {None} & kept | (known if check in self.whole else set(sorted(known)[: self.examples]))

    def batches(self) -> Iterator[pa.RecordBatch]:
        """check, example and n; the first example of a check has n of all."""
        rows = [(check, e, 0 if i else self.n[check]) for check, kept in self.least.items() for i, e in enumerate(kept)]
        for start in range(0, len(rows), 10_000):
            columns = zip(zip(*rows[start : start + 10_000]), (pa.string(), pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["check", "example", "n"])


FOUND = "check string, example string, n long"


def condensed(findings: DataFrame, examples: int = 10) -> DataFrame:
    """Findings with the same report in fewer rows: of each task and check the least ``examples`` examples, and n of all."""

    def condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(examples)
        for batch in batches:
            for check in batch.column("check").unique().to_pylist():
                rows = batch.filter(pc.equal(batch.column("check"), check))
                tally.add(check, rows.column("example"), pc.sum(rows.column("n")).as_py())
        yield from tally.batches()

    return findings.select("check", "example", "n").mapInArrow(condense, FOUND)


def _whole_keys(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows from batches in the order of ``h``, none of which ends within an ``h``."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            yield table.slice(0, cut)
            rest = table.slice(cut)
            # a key of more rows than a table's is not looked through again at each batch
            held, n = rest.to_batches(), 0 if cut == 0 else rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each value, null among them."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers."""
    return pd.factorize(a * (b.max() + 1) + b)[0] if len(a) else a


def _joined(*texts: pa.Array | pa.Scalar) -> pa.Array:
    """SQL's ``concat_ws('|', ...)``: nulls are left out. The empty text in front keeps rows of nulls alone, which Arrow drops."""
    return pc.utf8_slice_codeunits(pc.binary_join_element_wise(pa.scalar(""), *texts, "|", null_handling="skip"), start=1)


def _tests(rows: pa.Table, faults: list[tuple[str, str]], tally: Tally) -> None:
    """Add what ``rows`` show; they hold all rows of their products."""
    request, store, product, g, label = (rows.column(c).combine_chunks() for c in (*PAIR, "g", "reviewer_label"))
    part, fault, known = (rows.column(c).to_numpy() for c in ("part", "faults", "known"))
    listed, pooled, decided = part == LISTED, part == POOLED, part == DECIDED
    null = lambda column: column.is_null().to_numpy(zero_copy_only=False)
    placed = ~null(store) & ~null(product)
    whole = placed & ~null(request)
    item = _both(_codes(rows.column("store_id")), _codes(rows.column("product_id")))
    pair = _both(item, _codes(rows.column("request_id")))
    count = lambda key, of: np.bincount(key[of], minlength=len(key))[key]
    times, answers = count(pair, pooled) * whole, count(pair, decided) * whole
    judged, each, once = decided & (times > 0), np.maximum(answers, 1), np.ones(len(pair), np.int64)
    again = np.zeros(len(pair), bool)
    again[pooled] = pd.Series(pair[pooled]).duplicated().to_numpy()

    def add(name, test, n, end=None):
        if test.any():
            keep = pa.array(test)
            texts = [c.filter(keep) for c in (request, store, product)] + ([] if end is None else [end.filter(keep) if isinstance(end, pa.Array) else pa.scalar(end)])
            tally.add(name, _joined(*texts), int(n[test].sum()))

    # a pair of the pool counts once for each decision on it
    add("every_pair_product_in_catalog", pooled & ~(placed & (count(item, listed) > 0)), each)
    add("every_pair_has_a_decision", pooled & (answers == 0), once)
    add("no_duplicate_pairs_within_a_pool", again, each)
    add("all_reviewer_labels_valid", judged & ~pc.is_in(label, pa.array(LABELS)).to_numpy(zero_copy_only=False), times, label)
    for i, (name, end) in enumerate(faults):
        add(name, judged & (fault >> i & 1 == 1), times, end)
    add("decisions_outside_current_pool", decided & (times == 0), once)
    positive = judged & pc.fill_null(pc.equal(label, OK), False).to_numpy(zero_copy_only=False)
    tally.add(POSITIVE, request.filter(pa.array(positive)), int(positive.sum()))

    # labels of a product in a group of paraphrases
    at = np.flatnonzero(judged & known & ~null(label))
    seen = pd.DataFrame({"group": _both(item, _codes(rows.column("g")))[at], "kind": _codes(rows.column("reviewer_label"))[at], "at": at}).drop_duplicates(["group", "kind"])
    seen = seen[seen.group.duplicated(keep=False)].sort_values("group", kind="stable")
    if len(seen):
        starts = np.flatnonzero(np.diff(seen.group.to_numpy(), prepend=-1))
        texts = np.split(label.take(pa.array(seen["at"].to_numpy())).to_numpy(zero_copy_only=False), starts[1:])
        first = pa.array(seen["at"].to_numpy()[starts])
        texts = pa.array([",".join(sorted(t)) for t in texts], pa.string())
        tally.add("no_paraphrase_group_label_conflicts", _joined(g.take(first), store.take(first), product.take(first), texts), len(starts))


def _met(catalog: DataFrame, requests: DataFrame, pool: DataFrame, decisions: DataFrame, versions: dict[str, str]) -> DataFrame:
    """check, example and n of all that shows where pool, decisions and catalog meet, condensed, and the requests with a known positive (``POSITIVE``).

    The rows of the three are dealt once, by product, over as many tasks as they take,
    so a task's share doesn't grow with the number of pairs. A task puts them in the
    order of a hash of the product, looks at some products at a time and keeps only
    the tally. A null in a key meets nothing.
    """
    about = requests.groupBy("request_id").agg(F.min("paraphrase_group").alias("g"), F.min("content_sha256").alias("content")).withColumn("known", F.lit(True))
    about = small(settled(about))
    wanted = {c: F.lit(versions.get(c)) for c in VERSIONS[:3]} | {VERSIONS[3]: F.col("content")}
    guessed = F.coalesce("is_best_guess", F.lit(False)) & (F.coalesce("conservative_label", F.lit("")) == "")
    tests = [*(~F.col(c).eqNullSafe(v) for c, v in wanted.items()), guessed]
    faults = [*(("no_version_or_hash_mismatches", c) for c in wanted), ("guessed_labels_carry_conservative_interpretation", None)]
    bits = reduce(Column.__add__, (F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)))
    side = lambda df, part, *more: df.select(*(c for c in (*PAIR, "g", "known") if c in df.columns), F.lit(part).alias("part"), *more)
    rows = side(pool.join(about, "request_id", "left"), POOLED)
    rows = rows.unionByName(side(decisions.join(about, "request_id", "left"), DECIDED, "reviewer_label", bits.alias("faults")), allowMissingColumns=True)
    rows = rows.unionByName(side(catalog.select("store_id", "product_id"), LISTED), allowMissingColumns=True)
    rows = rows.repartition(tasks_for(pool.sparkSession, pool.count() + decisions.count()), "store_id", "product_id")
    text = [F.col(c).cast("string").alias(c) for c in (*PAIR, "g", "reviewer_label")]
    rows = rows.select(F.xxhash64("store_id", "product_id").alias("h"), *text, F.coalesce("known", F.lit(False)).alias("known"), "part", F.coalesce("faults", F.lit(0)).alias("faults")).sortWithinPartitions("h")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(whole=(POSITIVE,))
        for some in _whole_keys(batches):
            _tests(some, faults, tally)
        yield from tally.batches()

    return settled(rows.mapInArrow(meet, FOUND).groupBy("check", "example").agg(F.sum("n").alias("n")))


def _say(df: DataFrame, name: str, example: Column, n: Column | None = None) -> DataFrame:
    return df.select(F.lit(name).alias("check"), example.alias("example"), (F.lit(1) if n is None else n).cast("long").alias("n"))


def _of_pairs(met: DataFrame) -> DataFrame:
    return met.where(~F.col("check").isin(POSITIVE, *OF_GROUPS))


def _of_groups(met: DataFrame, catalog: DataFrame, requests: DataFrame, pilots: DataFrame, audits: DataFrame) -> list[DataFrame]:
    text = lambda c: F.col(c).cast("string")
    ids, pilots = requests.groupBy("request_id").agg(F.count("*").alias("times"), F.min("paraphrase_group").alias("g"), F.min("answerability").alias("kind")), pilots.select("request_id").distinct()
    pilot_groups = ids.join(pilots, "request_id", "left_semi").select("g").distinct()
    positive = met.where(F.col("check") == POSITIVE).select(F.col("example").alias("positive"))
    return [
        met.where(F.col("check").isin(*OF_GROUPS)),
        _say(ids.where("times > 1"), "no_duplicate_request_ids", text("request_id")),
        _say(pilots.join(ids, "request_id", "left_anti"), "pilot_ids_present_in_requests", text("request_id")),
        _say(catalog.groupBy("store_id", "product_id").count().where("count > 1"), "no_duplicate_catalog_identities", _key("store_id", "product_id"), F.col("count")),
        _say(ids.join(pilots, "request_id", "left_anti").join(pilot_groups, "g", "left_semi"), "pilot_groups_disjoint_from_non_pilot_requests", text("request_id")),
        _say(ids.where("kind = 'no_acceptable_match'").join(audits, "request_id", "left_anti"), "every_no_match_request_has_an_audit_entry", text("request_id")),
        _say(ids.where("kind = 'answerable'").join(positive, text("request_id") == F.col("positive"), "left_anti"), "answerable_requests_with_no_known_positive_in_pool", text("request_id")),
    ]


def pair_findings(catalog: DataFrame, requests: DataFrame, pool: DataFrame, decisions: DataFrame, versions: dict[str, str]) -> DataFrame:
    """check, example and n of all that a single pair can violate.

    ``versions`` are the values that decisions must carry; the hash of a request's
    content is that of the request.
    """
    return _of_pairs(_met(catalog, requests, pool, decisions, versions))


def group_findings(catalog: DataFrame, requests: DataFrame, pool: DataFrame, decisions: DataFrame, pilots: DataFrame, audits: DataFrame) -> list[DataFrame]:
    """Findings that take several rows: repeated identities, decisions outside the pool, groups and answerability."""
    return _of_groups(_met(catalog, requests, pool, decisions, {}), catalog, requests, pilots, audits)


def findings(catalog: DataFrame, requests: DataFrame, pool: DataFrame, decisions: DataFrame, versions: dict[str, str], pilots: DataFrame, audits: DataFrame) -> list[DataFrame]:
    """``pair_findings`` and ``group_findings`` of one pass over the pool beside its decisions."""
    met = _met(catalog, requests, pool, decisions, versions)
    return [_of_pairs(met), *_of_groups(met, catalog, requests, pilots, audits)]


def manifest_findings(tables: dict[str, tuple[DataFrame, list[str]]], manifest: dict[str, str | None]) -> list[DataFrame]:
    """Tables whose ``digest`` isn't that of the manifest."""
    out = []
    for name, (rows, columns) in tables.items():
        actual = digest(rows, columns).where(~F.col("sha256").eqNullSafe(F.lit(manifest.get(name))))
        out.append(actual.select(F.lit(f"manifest_{name}_hash_matches_file").alias("check"), F.concat_ws("|", F.lit(manifest.get(name)), "sha256").alias("example"), F.lit(1).cast("long").alias("n")))
    return out


def report(findings: list[DataFrame], checks: dict[str, str] = CHECKS, examples: int = 10) -> DataFrame:
    """check, status, n and the least ``examples`` examples of every check, those without a finding included.

    Findings are condensed before they are shuffled, so a check that everything
    violates sends ``examples`` rows a task.
    """
    spark = findings[0].sparkSession
    seen = settled(condensed(reduce(DataFrame.unionByName, findings), examples).groupBy("check", "example").agg(F.sum("n").alias("n")))
    counts = seen.groupBy("check").agg(F.sum("n").alias("n"))
    first = seen.withColumn("place", F.row_number().over(Window.partitionBy("check").orderBy("example"))).where(F.col("place") <= examples)
    first = first.groupBy("check").agg(F.array_sort(F.collect_list("example")).alias("examples"))
    named = spark.createDataFrame(list(checks.items()), "check string, kind string")
    out = F.broadcast(named).join(counts, "check", "left").join(first, "check", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return out.select("check", F.when(F.col("kind") == "info", "info").when(n == 0, F.when(F.col("kind") == "warn", "info").otherwise("pass")).otherwise(F.col("kind")).alias("status"), n.alias("n"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def export_pairs(pool: DataFrame, decisions: DataFrame) -> DataFrame:
    """A row for each row of the pool with what was decided on it; the conservative label is the reviewer's where none was given. Pairs without a decision have no row."""
    conservative = F.coalesce("conservative_label", "reviewer_label").alias("conservative_label")
    return pool.select(*PAIR).join(decisions, list(PAIR)).select(*PAIR, "reviewer_label", conservative, F.coalesce("is_best_guess", F.lit(False)).alias("is_best_guess"), *VERSIONS[:3])


# --- splits ---------------------------------------------------------------------------------------


def split_invariants(requests: DataFrame, assigned: DataFrame, pins: DataFrame, shares: dict[str, float], slack: float = 0.1) -> DataFrame:
    """invariant, subject and detail of all that an assignment (request_id, split) breaks; no rows if it is sound.

    ``requests`` have request_id, paraphrase_group and matching_mode; ``pins`` a
    paraphrase_group and the split it must be in. A split's share of the requests, and of each
    mode's, may differ by ``slack`` from its target.
    """
    # a share at a half of its last digit is written by its value, which format_string would round up
    rows = settled(requests.join(assigned, "request_id", "full_outer"))
    say = lambda df, name, subject, detail: df.select(F.lit(name).alias("invariant"), subject.cast("string").alias("subject"), detail.alias("detail"))
    splits = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias("splits")
    targets = rows.sparkSession.createDataFrame(list(shares.items()), "split string, target double")
    groups = rows.where("paraphrase_group is not null").groupBy("paraphrase_group").agg(F.countDistinct("split").alias("n"), splits("split"))
    at = groups.join(pins, "paraphrase_group").where("splits not in ('', pin)")
    # a split without a request of some mode is a share of zero
    modes = rows.where("matching_mode is not null").groupBy("matching_mode").agg(F.count("*").alias("of"))
    held = rows.where("matching_mode is not null and split is not null").groupBy("matching_mode", "split").agg(F.count("*").alias("n"))
    every = modes.unionByName(modes.groupBy().agg(F.lit("all").alias("matching_mode"), F.sum("of").alias("of")).where("of is not null"))
    held = held.unionByName(held.groupBy("split").agg(F.lit("all").alias("matching_mode"), F.sum("n").alias("n")), allowMissingColumns=True)
    share = every.crossJoin(F.broadcast(targets)).join(held, ["matching_mode", "split"], "left").withColumn("share", F.round(F.coalesce("n", F.lit(0)) / F.col("of"), 6))
    return reduce(
        DataFrame.unionByName,
        [
            say(groups.where("n > 1"), "group_in_one_split", F.col("paraphrase_group"), F.col("splits")),
            say(at, "pinned_group_in_its_split", F.col("paraphrase_group"), F.concat_ws(">", "pin", "splits")),
            say(rows.where("paraphrase_group is not null and split is null"), "every_request_assigned", F.col("request_id"), F.lit("")),
            say(rows.where("paraphrase_group is null and split is not null"), "only_requests_assigned", F.col("request_id"), F.col("split")),
            say(rows.groupBy("request_id").agg(F.count("*").alias("n")).where("n > 1"), "request_assigned_once", F.col("request_id"), F.col("n").cast("string")),
            say(rows.where(~F.col("split").isin(*shares)).groupBy("split").count(), "known_splits", F.col("split"), F.col("count").cast("string")),
            say(share.where(F.abs(F.col("share") - F.col("target")) > slack), "share_of_split", F.concat_ws("|", "matching_mode", "split"), F.format_number("share", 3)),
        ],
    )


def shared_references(requests: DataFrame, references: DataFrame, pins: DataFrame) -> DataFrame:
    """Groups of paraphrases with one and the same set of reference products: groups, request_ids, products. Pinned groups count too, groups without references don't.

    ``references`` has a row a (request_id, store_id, product_id). The set of a group is as large as its
    references; groups meet by its hash and are then compared by the set.
    """
    rows = references.join(requests.select("request_id", "paraphrase_group").distinct(), "request_id")
    sets = rows.groupBy("paraphrase_group").agg(F.array_sort(F.collect_set(_key("store_id", "product_id"))).alias("products"))
    members = requests.groupBy("paraphrase_group").agg(F.collect_set("request_id").alias("ids"))
    sets = sets.join(members, "paraphrase_group").join(pins.select("paraphrase_group", F.lit(True).alias("pinned")).distinct(), "paraphrase_group", "left")
    same = sets.groupBy(F.xxhash64("products").alias("h"), "products").agg(F.array_sort(F.collect_list("paraphrase_group")).alias("groups"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("request_ids"), F.count("pinned").alias("n_pinned"))
    return same.where(F.size("groups") > 1).select("groups", "request_ids", "products", "n_pinned")
