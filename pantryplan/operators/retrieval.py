"""Retrieval: TF-IDF, synonyms, vectors, rank fusion and candidate pools.

Every search takes a table of queries, never one query. Ties are broken by a
declared total order: score down, then ids up. Queries are the small side: they are
broadcast only behind a check of their number, and joined by a shuffle beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pantryplan.sources.settle import settled

#: Letters, digits and underscores of any script, two or more.
TOKEN = r"[\p{L}\p{N}_]{2,}"
RRF_K = 60
#: Rows of a side up to which it is broadcast.
SMALL = 50_000
#: Rows of pairs that one task makes, sorts or writes.
TASK_ROWS = 1_000_000
#: Blocks of queries up to which they are broadcast, and of which a task keeps the best.
QUERY_BLOCKS = 128

# Synonyms of product words.
SYNONYMS = {
    "soda": ("pop", "soft drink"), "pop": ("soda", "soft drink"), "chips": ("crisps",), "cookies": ("biscuits",), "cilantro": ("coriander",), "yogurt": ("yoghurt",),
    "eggplant": ("aubergine",), "zucchini": ("courgette",), "arugula": ("rocket",), "candy": ("sweets",), "fries": ("chips",),
}


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """Broadcast a side of at most ``rows`` rows; leave any other to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for ``rows`` short rows: the session's, or more where a task would hold more than ``TASK_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, n: DataFrame) -> DataFrame:
    """term, df and ln((1 + n) / (1 + df)) + 1; ``n`` has one row, the number of documents, empty ones included."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n.agg(F.count("*").alias("n")))).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, idfs: DataFrame, key: str) -> DataFrame:
    """Unit-length TF-IDF weights: key, term, w."""
    raw = counts.join(idfs.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("w"))


def top_k(scored: DataFrame, by: list[str], k: int, ids: list[str], score: str = "score") -> DataFrame:
    """The ``k`` best of each group, with their rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ids)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tfidf_search(queries: DataFrame, docs: DataFrame, k: int, query: str, doc: str, text: str = "text") -> DataFrame:
    """Cosine of each query with all documents that share a term; query, doc, score, rank.

    Documents are dealt out once, by their key, over as many tasks as queries times documents
    take. Their terms are counted and held against the queries there, so neither counts nor
    products are kept or travel; only for the norms each term of a document meets its frequency.
    """
    texts = docs.select(doc, text)
    dealt = texts.repartition(tasks_for(docs.sparkSession, texts.count() * queries.count()), doc)
    counts = term_counts(dealt, doc, text)
    idfs = settled(idf(counts, texts).select("term", "idf"))
    q = weights(term_counts(queries, query, text), idfs, query).join(idfs, "term").select(query, "term", (F.col("w") * F.col("idf")).alias("wq"))
    hits = counts.join(small(settled(q)), "term").groupBy(query, doc).agg(F.sum(F.col("tf") * F.col("wq")).alias("dot"))
    raw = counts.join(idfs, "term").select(doc, (F.col("tf") * F.col("idf")).alias("raw"))
    norm = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    # a task's norms are few beside its products, which needn't be sorted for them
    scored = hits.join(norm.hint("shuffle_hash"), doc).select(query, doc, F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where("score > 0")
    return top_k(scored, [query], k, [doc])


def synonym_score(product: Column, title: Column, category: Column, wanted: Column, found: Column) -> Column:
    """Share of the product's words and synonyms in title and category, halved where dimensions are known to differ."""
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = F.array_distinct(F.filter(F.split(F.lower(product), r"\s+"), lambda w: w != ""))
    every = F.array_distinct(F.concat(asked, F.flatten(F.transform(asked, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))))
    held = F.array_union(F.split(F.lower(title), r"\s+"), F.split(F.lower(category), r"\s+"))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(every, held)).cast("double"), F.size(every)), F.lit(0.0))
    return share * F.when(wanted != found, 0.5).otherwise(1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def _blocks(rows: DataFrame, key: str, vec: str, size: int, order: list[str]) -> DataFrame:
    """dim, ids and data: vectors of one length packed as a matrix of doubles, up to ``size`` of them in the order of ties; vectors that are null, empty or hold a null have no dot product above 0."""
    whole = rows.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, F.isnull))
    whole = whole.select(*dict.fromkeys([key, *order]), F.size(vec).alias("__dim"), F.col(vec).cast("array<double>").alias("__vec"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}

        def block(dim: int, part: pa.Table) -> pa.RecordBatch:
            part = part.sort_by([(c, "ascending") for c in order]).combine_chunks()
            values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in part["__vec"].chunks])
            ids = pa.array([part[key].to_pylist()], pa.list_(part.schema.field(key).type))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), ids, pa.array([values.tobytes()], pa.binary())], names=["dim", "ids", "data"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for dim in rows["__dim"].unique().to_pylist():
                more = rows.filter(pc.equal(rows["__dim"], dim))
                more = pa.concat_tables([held.pop(dim), more]) if dim in held else more
                while len(more) >= size:
                    yield block(dim, more.slice(0, size))
                    more = more.slice(size)
                held[dim] = more
        for dim, rest in held.items():
            if len(rest):
                yield block(dim, rest)

    return whole.mapInArrow(pack, f"dim int, ids array<{rows.schema[key].dataType.simpleString()}>, data binary")


def tile_best(q: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q`` and ``x`` and their dot products: all pairs that can be among a row's ``k`` best once products are rounded to six digits.

    A matrix product finds what comes near the k-th best; those are added up again from
    the first entry to the last, as the column expression ``dot`` does. Of equal products of a
    row the first ``k`` stay, so copies of a vector don't add up. ``floor`` is the k-th best product of
    each row that other tiles have given, -inf where they gave fewer.
    """
    floor = np.full(len(q), -np.inf) if floor is None else floor
    with np.errstate(all="ignore"):
        scores = q @ x.T
        norm = np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max())
        # rounding moves a product by half a millionth, another order of adding by far less than the share of the norms
        slack = 2e-6 + 1e-12 * np.where(np.isfinite(norm), norm, 0.0)
        bar = np.fmax(0.0, floor) - slack
        near = ~(scores < bar[:, None])
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > k)
        if len(many):
            bar[many] = np.fmax(bar[many], np.partition(scores[many], len(x) - k, axis=1)[:, len(x) - k] - slack[many])
            near[many] = ~(scores[many] < bar[many, None])
        at, to = np.divmod(np.flatnonzero(near), len(x))
        total = np.zeros(len(at))
        for d in range(q.shape[1]):
            total += q[at, d] * x[to, d]
        order = np.lexsort((to, -total, at))
        at, to, total = at[order], to[order], total[order]
        start = np.arange(len(at))
        if len(at):
            start[1:][(at[1:] == at[:-1]) & (total[1:] == total[:-1])] = 0
        kept = np.arange(len(at)) - np.maximum.accumulate(start) < k if len(at) else start < k
    return at[kept], to[kept], total[kept]


def raised(best: np.ndarray, at: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``best``, the best products of each row, with those of a tile, whose rows ``at`` ascend."""
    rows, start, n = np.unique(at, return_index=True, return_counts=True)
    if len(rows):
        more = np.full((len(rows), n.max()), -np.inf)
        more[np.repeat(np.arange(len(rows)), n), np.arange(len(at)) - np.repeat(start, n)] = total
        best[rows] = np.partition(np.hstack([best[rows], more]), n.max(), axis=1)[:, n.max() :]
    return best


def nearest(queries: DataFrame, items: DataFrame, k: int, query: str, item: str, order: list[str] | None = None) -> DataFrame:
    """query, item and score of every pair above 0 that can be among a query's ``k`` best by score and then ``order``, and of some more.

    Exact: each block of items meets each block of queries as a matrix product, and what
    leaves such a tile is no more than its own best of each query, and nothing below the
    k-th best that the tiles before it in the task have given. Blocks of queries are
    broadcast behind a check of their number; a task keeps the best of so many of them.
    """
    asked, held = queries.schema[query].dataType.simpleString(), items.schema[item].dataType.simpleString()
    left = _blocks(queries.select(query, "qvec"), query, "qvec", 1_024, [query]).toDF("qdim", "qids", "qdata").withColumn("qn", F.monotonically_increasing_id())
    right = _blocks(items, item, "vec", 4_096, order or [item])
    width = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = right.repartition(width).join(small(left, QUERY_BLOCKS), F.col("dim") - F.col("qdim") == 0)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in range(len(batch)):
                tile = {c: batch.column(c)[row] for c in ("dim", "ids", "data", "qids", "qdata")}
                dim = tile["dim"].as_py()
                q, x = (np.frombuffer(tile[c].as_buffer(), np.float64).reshape(-1, dim) for c in ("qdata", "data"))
                block = batch.column(5)[row].as_py()
                best = seen.pop(block) if block in seen else np.full((len(q), k), -np.inf)
                at, to, total = tile_best(q, x, k, best.min(axis=1))
                if len(seen) == QUERY_BLOCKS:
                    seen.pop(next(iter(seen)))
                seen[block] = raised(best, at, total)
                yield pa.RecordBatch.from_arrays([tile["qids"].values.take(pa.array(at)), tile["ids"].values.take(pa.array(to)), pa.array(total)], names=[query, item, "score"])

    found = tiles.select("dim", "ids", "data", "qids", "qdata", "qn").mapInArrow(meet, f"`{query}` {asked}, `{item}` {held}, score double")
    return found.withColumn("score", F.round("score", 6)).where("score > 0")


def vector_search(queries: DataFrame, items: DataFrame, k: int, query: str, item: str) -> DataFrame:
    """Exact dot products of every query (``qvec``) with every item (``vec``), the ``k`` best of each."""
    return top_k(nearest(queries, items, k, query, item), [query], k, [item])


def nearest_kinds(queries: DataFrame, items: DataFrame, k: int, query: str, item: str, kind: str) -> DataFrame:
    """The ``k`` items of each query whose ``kind``, a number, is nearest to its own; query, item, score, rank.

    Items of one kind differ by their ids alone, so the first ``k`` of each kind are held
    against each kind that is asked for, and queries of a kind share one list.
    """
    first = items.select(F.col(item), F.col(kind).alias("__other"))
    first = first.withColumn("__n", F.row_number().over(Window.partitionBy("__other").orderBy(item))).where(F.col("__n") <= k)
    kinds = queries.select(F.col(kind).alias("__kind")).distinct()
    lists = first.join(small(kinds), F.lit(True)).withColumn("score", -F.abs(F.col("__kind") - F.col("__other")))
    lists = top_k(lists, ["__kind"], k, [item]).select("__kind", item, "score", "rank")
    asked = queries.select(query, kind)
    return asked.join(lists, asked[kind].eqNullSafe(lists["__kind"])).select(query, item, "score", "rank")


def fuse(lists: list[DataFrame], by: list[str], ids: list[str], k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion over the union of ranked lists."""
    cols = [*by, *ids, "rank"]
    both = lists[0].select(*cols)
    for other in lists[1:]:
        both = both.unionByName(other.select(*cols))
    fused = both.groupBy(*by, *ids).agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 9).alias("score"))
    return top_k(fused, by, k, ids)


def within_pool(pool: DataFrame, by: list[str], ids: list[str]) -> DataFrame:
    """Score every pair of the pool (``qvec`` by ``vec``) and rank all of them; a pair without a vector scores 0."""
    score = F.coalesce(F.round(dot(F.col("qvec"), F.col("vec")), 6), F.lit(0.0))
    all_ = pool.select(*by, *ids, score.alias("score"))
    return all_.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), *ids)))


def merge_candidates(rows: DataFrame, by: list[str], ids: list[str]) -> DataFrame:
    """One row a candidate: its sources in order and its best score."""
    return rows.groupBy(*by, *ids).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max("score").alias("score"), F.bool_or("protected").alias("protected"))


def cap_pool(pool: DataFrame, by: list[str], ids: list[str], size: int = 15) -> DataFrame:
    """Protected candidates, and the best others in the places that they leave."""
    group = Window.partitionBy(*by)
    place = F.row_number().over(Window.partitionBy(*by, "protected").orderBy(F.desc("score"), *ids))
    spare = F.greatest(F.lit(size) - F.sum(F.col("protected").cast("int")).over(group), F.lit(0))
    return pool.withColumn("place", place).withColumn("spare", spare).where(F.col("protected") | (F.col("place") <= F.col("spare"))).drop("place", "spare")


def unjudged(found: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    return found.select(*keys).distinct().join(judged.select(*keys), keys, "left_anti")


def best_per_store(scored: DataFrame, by: list[str]) -> DataFrame:
    return top_k(scored, [*by, "store_id"], 1, ["product_id"]).drop("rank")
