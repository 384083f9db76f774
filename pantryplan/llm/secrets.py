"""Operator 7: secret scans by patterns and by a battery of randomness tests.

Columns and SQL functions only. Base spans are the leftmost non-overlapping
matches of three patterns. The battery looks at runs of 20 or more characters of
encoded data outside base spans, infers their alphabet, and tests whether they
look drawn uniformly from it: chi-squared over the alphabet, runs above and below
its middle, and serial correlation of neighbours; Fisher's method combines the
three p-values. A text without characters of an encoding (a null one too) has no
spans. Repeated rows are judged each by itself.

Random strings have uniform p-values and ordinary ones small ones, so in each
class of length the share of strings above one half tells how many random ones
there are, and with that the share of false discoveries above any cut. The cut of
a class is the lowest at which that share is at most ``fdr``; where no cut is low
enough the class adds no spans. Counts for the cuts cover all strings of all
texts; they are a table of length classes by bins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryplan.llm.common import table

# Fixed patterns of the base kinds, in their order of listing.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
ENCODED = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = (*BASE, "random")
UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Pattern and alphabet of the encodings, the narrowest first.
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGIT + "abcdef"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGIT + "ABCDEF"),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    (r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", UPPER + DIGIT),
    (r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", LOWER + DIGIT),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", UPPER + LOWER + DIGIT),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGIT + "+/"),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGIT + "-_"),
)
LENGTHS = (20, 24, 32, 48, 64, 128, 256)
BINS = 100


def _spans(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0) -> Column:
    """array<struct<start,kind,stop,value>> of the leftmost non-overlapping matches, in code points.

    One pattern takes each match with the gap before it, so positions are running
    sums of lengths. A match counts only if its group has ``least`` characters.
    """
    found = rf"(?s)\G(.*?)({pattern})"  # \G: a text is read once, also after its last match
    pick = lambda g: F.regexp_extract_all(text, F.lit(found), F.lit(g))
    value = pick(2 + group) if group else pick(2)
    parts = F.arrays_zip(pick(1).alias("gap"), pick(2).alias("hit"), value.alias("value"))
    empty = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,kind:int,stop:int,value:string>>))")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        stop = start + F.char_length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["value"].alias("value"))
        kept = F.when(F.char_length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(stop.alias("at"), kept.alias("out"))

    spans = F.aggregate(parts, empty, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(empty["out"])


def base_spans(text: Column) -> dict[str, Column]:
    return {k: _spans(text, p, i, 1 if k == "assign" else None, 12 if k == "assign" else 0) for i, (k, p) in enumerate(BASE.items())}


def _normal_tail(z: Column) -> Column:
    """P(Z > z); the polynomial of Abramowitz and Stegun 26.2.17."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _tests(s: Column, alphabet: Column) -> Column:
    """Combined p-value under uniform draws from the alphabet; small for ordinary strings."""
    n, size = F.char_length(s).cast("double"), F.char_length(alphabet).cast("double")
    counted = F.transform(F.split(alphabet, ""), lambda c: n - F.char_length(F.replace(s, c, F.lit(""))))
    squares = F.aggregate(counted, F.lit(0.0), lambda acc, k: acc + k * k)
    df = size - 1
    ratio = F.greatest((squares * size / n - n) / df, F.lit(1e-9))
    z_chi = (F.pow(ratio, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    low = F.floor(size / 2).cast("int")
    half = F.call_function("translate", s, alphabet, F.concat(F.repeat(F.lit("0"), low), F.repeat(F.lit("1"), F.char_length(alphabet) - low)))
    turns = _let(half, lambda h: (2 * n - F.char_length(F.replace(h, F.lit("01"), F.lit(""))) - F.char_length(F.replace(h, F.lit("10"), F.lit("")))) / 2)
    z_runs = F.abs(turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    at = F.transform(F.split(s, ""), lambda c: F.instr(alphabet, c).cast("double") - (size + 1) / 2)
    sums = _let(at, lambda x: F.aggregate(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda u, v: u * v), F.lit(0.0), lambda acc, u: acc + u))
    z_serial = F.abs(sums) / (F.sqrt(n - 1) * (size * size - 1) / 12)
    # one-sided for the alphabet, two-sided for the others
    tails = F.transform(F.array(F.struct(z_chi.alias("z"), F.lit(1.0).alias("sides")), F.struct(z_runs.alias("z"), F.lit(2.0).alias("sides")), F.struct(z_serial.alias("z"), F.lit(2.0).alias("sides"))), lambda t: -F.log(F.greatest(t["sides"] * _normal_tail(t["z"]), F.lit(1e-12))))
    return _let(F.aggregate(tails, F.lit(0.0), lambda acc, t: acc + t), lambda x: F.exp(-x) * (1 + x + x * x / 2))


def randomness(value: Column) -> Column:
    """The p-value of a string by its inferred encoding; null where none is."""

    def inferred(s: Column) -> Column:
        alphabet = F.lit(None).cast("string")
        for pattern, letters in reversed(ENCODINGS):
            alphabet = F.when(s.rlike(pattern), letters).otherwise(alphabet)
        return _let(F.struct(s.alias("s"), alphabet.alias("a")), lambda x: F.when(x["a"].isNotNull(), _tests(x["s"], x["a"])))

    return _let(F.regexp_replace(value, "=+$", ""), inferred)


def _with_spans(docs: DataFrame) -> DataFrame:
    """doc_id and f: the base spans by kind and together, and the runs of encoded data outside them."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def found(t: Column) -> Column:
        parts = F.struct(*(c.alias(k) for k, c in base_spans(t).items()), _spans(t, ENCODED, len(BASE)).alias("raw"))
        return _let(parts, lambda x: _let(F.struct(*(x[k].alias(k) for k in BASE), F.concat(*(x[k] for k in BASE)).alias("base"), x["raw"].alias("raw")), outside))

    def outside(y: Column) -> Column:
        runs = F.filter(y["raw"], lambda r: ~F.exists(y["base"], lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"])))
        return F.struct(*(F.size(y[k]).cast("long").alias(f"n_{k}") for k in BASE), y["base"].alias("base"), runs.alias("runs"))

    return docs.select("doc_id", found(text).alias("f"))


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, low in enumerate(LENGTHS):
        out = F.when(n >= low, i).otherwise(out)
    return out


def cuts(docs: DataFrame, fdr: float = 0.05, least: float = 0.01) -> list[float | None]:
    """The lowest p-value that each class of length accepts; None where it accepts nothing."""
    runs = _with_spans(docs).select(F.explode("f.runs").alias("r")).select(_length_class(F.char_length("r.value")).alias("c"), randomness(F.col("r.value")).alias("p"))
    counts = {(r.c, r.b): r["count"] for r in runs.where("p is not null").groupBy("c", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("b")).count().collect()}
    out: list[float | None] = []
    for c in range(len(LENGTHS)):
        hist = [counts.get((c, b), 0) for b in range(BINS)]
        uniform = 2 * sum(hist[BINS // 2 :])
        cut = None
        for b in range(max(1, round(least * BINS)), BINS // 2):
            above = sum(hist[b:])
            if above and above - uniform * (1 - b / BINS) <= fdr * above:
                cut = b / BINS
                break
        out.append(cut)
    return out


def scan(docs: DataFrame, accept: list[float | None]) -> DataFrame:
    """doc_id, base and all spans as arrays of (start, kind, stop, value), and counts of the base kinds."""
    def random(r: Column) -> Column:
        limits = F.array(*(F.lit(p).cast("double") for p in accept))
        return F.coalesce(randomness(r["value"]) >= F.get(limits, _length_class(F.char_length(r["value"]))), F.lit(False))

    out = _with_spans(docs).select("doc_id", "f.*")
    return out.select("doc_id", *(f"n_{k}" for k in BASE), F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.filter("runs", random))).alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, cuts(docs))
    return found.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
