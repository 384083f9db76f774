"""Operator 1: near-duplicate documents by bottom-k sketches.

A document's set is that of its distinct word shingles (words are runs of bytes
other than 20 and 09-0D, A-Z in lower case; with fewer words than a shingle has,
the whole sequence; null, empty and blank texts have none). Documents are linked
if the sets' Jaccard similarity is at least ``percent`` / 100, in whole numbers.

1. One 64-bit hash of shingles gives each set its ``K`` smallest values. Equal
   sets are one class, which goes on as its smallest doc_id.
2. Inverted lists of retained values: a linked pair shares at least ``_least(m)``
   of its ``m`` values (for sets that fit their sketch by arithmetic, else with a
   chance of loss under 1e-7 at the limit and far less above it), so it meets on one
   of the ``m - least + 1`` rarest values of each. A list's members are compared in
   place by bitmaps of their sketches, which bound the number of common values from
   above; only each member's ``NEIGHBOURS`` best partners leave the list as pairs.
3. The sketch of a pair's union estimates its similarity; pairs below ``ESTIMATE``
   go. Exact similarity of whole sets confirms a link.
4. Pairs that the estimate lets pass make families, their links components. Members
   with more partners than left their list go back to it, where those of different
   families are held against each other by the estimate and join families. Inside
   a family, classes of different components are then compared exactly, in blocks
   whose output is one link for each two components. So no list or family is ever
   written out in pairs of its members: each member is packed into one block, and
   what is joined are pairs of blocks, a row each. A family of ``g`` unlinked classes
   makes ``g`` rows and (g / block)^2 / 2 tiles, which is the work that exact
   comparison takes.

Lists of more than ``LIST`` members are dealt into parts, and families into blocks of
up to ``BLOCK`` classes and ``BLOCK_VALUES`` shingles; the largest family of a list and the
largest component of a family aren't held against themselves. Components are of doc_ids; a row without one shows its class and
is always kept. Rows with equal doc_id are one node that has the sets of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryplan.llm.common import Scratch, bounded, release_memory, table, text_batches
from pantryplan.llm.graph import BROADCAST_IDS, components

K = 48
#: Share of a union's sketch that must be common; for similarity 0.8 six standard deviations below it.
ESTIMATE = 0.45
#: Partners that a member of a list names.
NEIGHBOURS = 2
#: Members of a list, and classes of a family and their shingles together, that a tile holds against as many others.
LIST, BLOCK, BLOCK_VALUES = 512, 128, 200_000
#: Tiles in an Arrow batch.
TILES = 4
#: 64-bit words of a sketch's bitmap.
WORDS = 8
#: Rows of two whole sets in an Arrow batch, and columns of a block's matrix.
PAIR_ROWS, COLUMNS = 32, 8192
#: Flipped, unsigned values keep their order as signed ones.
_SIGN = np.uint64(1 << 63)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n, step = min(width, len(words)), np.uint64(0x9E3779B97F4A7C15)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = _mix(out * step + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def _least(m: int, percent: int) -> int:
    """Retained values that a set with ``m`` of them shares with any linked one."""
    if m * 100 < percent * K:  # a linked set then fits its sketch too
        return -(-percent * m // 100)
    return max(1, int(ESTIMATE * percent / 80 * m))


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two sums that name a set."""
    return [pa.array(np.array([f(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)) for f in (lambda s: s, lambda s: _mix(s ^ _M2))]


def bitmap(sketch: np.ndarray) -> np.ndarray:
    """The low bits of a sketch's values as set bits of ``WORDS`` words."""
    out, at = np.zeros(WORDS, np.uint64), sketch % np.uint64(64 * WORDS)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
    return out


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, a digest of the whole set, its smallest values, their bitmap and how many of them a linked set shares."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            low = [s[:K] for s in sets]
            d1, d2 = _digests(sets)
            offsets = np.cumsum([0, *map(len, low)]).astype(np.int32)
            values = (np.concatenate([np.zeros(0, np.uint64), *low]) ^ _SIGN).view(np.int64)
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "d1": d1,
                    "d2": d2,
                    "sketch": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    "bits": pa.array([bitmap(s).tobytes() for s in low], pa.binary()),
                    "least": pa.array([_least(len(s), percent) if len(s) else 0 for s in low], pa.int32()),
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>, bits binary, least int")


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([s, t]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def estimate(s: np.ndarray, t: np.ndarray) -> float:
    """Share of the sketch of a union that both sets hold, from sorted sets or their sketches."""
    union = np.sort(np.concatenate([s[:K], t[:K]]), kind="stable")
    twice = np.concatenate([union[1:] == union[:-1], [False]])
    first = np.concatenate([[True], union[1:] != union[:-1]])
    return float(twice[first][:K].mean())


def _grade(a: str, b: str, percent: int) -> Column:
    """For two whole sets as bytes of sorted hashes: 0 below the estimate, 1 not linked, 2 linked."""

    @F.arrow_udf("int")
    def check(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y):
            s, t = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            out.append(0 if estimate(s, t) < ESTIMATE * percent / 80 else 1 + _linked(s, t, percent))
        return pa.array(out, pa.int32())

    return check(F.col(a), F.col(b))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 8192) -> Iterator[pa.Table]:
    """Tables of whole groups of about ``rows`` rows, from batches sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        part = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(max(part.num_rows - 1, 0), bool)
        for k in range(keys):
            x = part.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        cut = np.flatnonzero(change)
        if len(cut):
            yield part.slice(0, cut[-1] + 1)
            part = part.slice(cut[-1] + 1)
        held = part.to_batches()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _groups(part: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the groups of a sorted table."""
    change = np.zeros(part.num_rows - 1, bool)
    for k in range(keys):
        x = part.column(k).to_numpy()
        change |= x[1:] != x[:-1]
    starts = np.concatenate([[0], np.flatnonzero(change) + 1])
    return starts, np.diff(np.concatenate([starts, [part.num_rows]]))


def _fitting(bits: np.ndarray, n: np.ndarray, least: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Common bits of every two members of groups (group, member), and whether they may be linked.

    Values of one sketch that fall on one bit are all that bits can lose of the common ones.
    """
    common = np.zeros((*n.shape, n.shape[1]), np.int16)
    for w in range(WORDS):
        common += np.bitwise_count(bits[:, :, None, w] & bits[:, None, :, w])
    lost = np.minimum(n, K) - np.bitwise_count(bits).sum(2, dtype=np.int64)
    need = np.maximum(least[:, :, None], least[:, None, :]) - np.minimum(lost[:, :, None], lost[:, None, :])
    fits = (common >= need) & (100 * np.minimum(n[:, :, None], n[:, None, :]) >= percent * np.maximum(n[:, :, None], n[:, None, :]))
    fits[:, np.arange(n.shape[1]), np.arange(n.shape[1])] = False
    return common, fits


def _fits(bx: np.ndarray, nx: np.ndarray, lx: np.ndarray, by: np.ndarray, ny: np.ndarray, ly: np.ndarray, percent: int) -> np.ndarray:
    """``_fitting`` of two blocks."""
    common = np.zeros((len(nx), len(ny)), np.int16)
    for w in range(WORDS):
        common += np.bitwise_count(bx[:, None, w] & by[None, :, w])
    lost = [np.minimum(n, K) - np.bitwise_count(b).sum(1, dtype=np.int64) for n, b in ((nx, bx), (ny, by))]
    need = np.maximum(lx[:, None], ly[None]) - np.minimum(lost[0][:, None], lost[1][None])
    return (common >= need) & (100 * np.minimum(nx[:, None], ny[None]) >= percent * np.maximum(nx[:, None], ny[None]))


class _Union:
    """Joined numbers; the root of a set is its smallest."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[y] if y in self.parent else y
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        p, q = self.root(a), self.root(b)
        if p != q:
            self.parent[max(p, q)] = min(p, q)
        return p != q


class NearDuplicates:
    """The steps over one table; intermediate tables are in the shared folder."""

    def __init__(self, docs: DataFrame, width: int = 5, percent: int = 80):
        self.docs, self.width, self.percent = docs, width, percent
        self.scratch = Scratch(docs.sparkSession, "neardup")

    def _reps(self) -> DataFrame:
        self.sketched = self.scratch.save(sketches(self.docs, self.width, self.percent), "sketches")
        full = self.sketched.where("n_shingles > 0 and doc_id is not null")
        # one row a class, combined where rows are read, so that a class of many copies never meets as rows
        first = full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("sketch", "bits", "least"), "doc_id").alias("own"))
        # Where rows share a doc_id, a node may have several sets; each of them is held by its digest.
        return first.select("rep", F.xxhash64("d1", "d2").alias("d"), F.col("n_shingles").alias("n"), "own.*", "d1", "d2")

    def _lists(self, reps: DataFrame) -> DataFrame:
        """v, part, whole, rep, d, n, least and bits of each class at its rarest values that others have too."""
        entries = reps.select("rep", "d", F.explode("sketch").alias("v"))
        counts = entries.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
        shared = entries.join(counts, "v").groupBy("rep", "d").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("vs"))
        held = shared.join(reps.select("rep", "d", "n", "least", "bits", F.size("sketch").alias("m")), ["rep", "d"])
        # values that no other class has come first in order of rarity
        left = F.greatest(F.col("m") - F.col("least") + 1 - (F.col("m") - F.size("vs")), F.lit(0))
        out = held.select("rep", "d", "n", "least", "bits", F.explode(F.slice("vs", F.lit(1), left)).alias("x")).select("*", "x.v", "x.c")
        parts = F.ceil(F.col("c") / LIST)
        return out.select("v", F.when(parts > 1, F.pmod(F.xxhash64("rep", "d", "v"), parts)).otherwise(0).cast("int").alias("part"), (parts == 1).alias("whole"), "rep", "d", "n", "least", "bits")

    def _neighbours(self, lists: DataFrame) -> DataFrame:
        """Best partners (a, da, b, db) of members of a list; and, without b, members (v, a, da) that may have more of them."""
        percent = self.percent

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _whole_groups(batches, 2):
                v, rep, d, n, least = (part.column(c).to_numpy() for c in ("v", "rep", "d", "n", "least"))
                whole = part.column("whole").to_numpy(zero_copy_only=False)
                bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint64).reshape(-1, WORDS)
                starts, sizes = _groups(part, 2)
                x, y, open_ = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
                for size in np.unique(sizes):
                    chosen = starts[sizes == size]
                    if size == 1:
                        open_.append(chosen[~whole[chosen]])
                        continue
                    step = max(1, 2_000_000 // int(size) ** 2)
                    for i in range(0, len(chosen), step):
                        at = chosen[i : i + step, None] + np.arange(size)
                        common, fits = _fitting(bits[at], n[at], least[at], percent)
                        open_.append(at[(fits.sum(2) > NEIGHBOURS) | ~whole[at]])
                        score = np.where(fits, common, -1)
                        for _ in range(min(NEIGHBOURS, int(size) - 1)):
                            best = score.argmax(2)
                            value = np.take_along_axis(score, best[:, :, None], 2)
                            np.put_along_axis(score, best[:, :, None], -1, 2)
                            found = value[:, :, 0] >= 0
                            x.append(at[found])
                            y.append(np.take_along_axis(at, best, 1)[found])
                x, y, open_ = map(np.concatenate, (x, y, open_))
                swap = (rep[x] > rep[y]) | ((rep[x] == rep[y]) & (d[x] > d[y]))
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                none = pa.nulls(len(open_), pa.int64())
                columns = (pa.concat_arrays([pa.array(p), q]) for p, q in ((np.zeros(len(x), np.int64), pa.array(v[open_])), (rep[x], pa.array(rep[open_])), (d[x], pa.array(d[open_])), (rep[y], none), (d[y], none)))
                yield pa.record_batch(dict(zip(("v", "a", "da", "b", "db"), columns)))
            release_memory()

        return lists.repartition("v", "part").sortWithinPartitions("v", "part").select("v", "part", "whole", "rep", "d", "n", "least", "bits").mapInArrow(scan, "v long, a long, da long, b long, db long")

    def _sets(self, needed: DataFrame) -> DataFrame:
        """rep, d and whole set (bytes of sorted hashes) of the documents needed."""
        width = self.width

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
                d1, d2 = _digests(sets)
                yield pa.record_batch({"rep": batch.column(0), "d1": d1, "d2": d2, "whole": pa.array([x.tobytes() for x in sets], pa.binary())})
            release_memory()

        needed = needed.distinct()
        needed = F.broadcast(needed) if bounded(needed, BROADCAST_IDS) else needed
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed, "doc_id", "left_semi")
        return texts.mapInArrow(scan, "rep long, d1 long, d2 long, whole binary").select("rep", F.xxhash64("d1", "d2").alias("d"), "whole").dropDuplicates(["rep", "d"])

    def _graded(self, pairs: DataFrame) -> DataFrame:
        """Pairs of classes (a, da), (b, db) that the estimate lets pass, and whether they are linked."""
        s, key = self.scratch, "spark.sql.execution.arrow.maxRecordsPerBatch"
        ids = s.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed")
        sets = s.save(self._sets(ids), "sets", "none")
        whole = lambda x: sets.select(F.col("rep").alias(x), F.col("d").alias(f"d{x}"), F.col("whole").alias(f"w{x}"))
        both = pairs.join(whole("b"), ["b", "db"]).join(whole("a"), ["a", "da"]).withColumn("grade", _grade("wa", "wb", self.percent))
        before = self.docs.sparkSession.conf.get(key)
        self.docs.sparkSession.conf.set(key, PAIR_ROWS)
        out = s.save(both.where("grade > 0").select(F.col("a").alias("u"), F.col("b").alias("v"), (F.col("grade") == 2).alias("linked")), "graded")
        self.docs.sparkSession.conf.set(key, before)
        s.drop("sets", "needed")
        return out

    def run(self) -> DataFrame:
        s = self.scratch
        self.reps = s.save(self._reps(), "reps")
        listed = s.save(self._neighbours(self._lists(self.reps)), "listed")
        graded = self._graded(s.save(listed.where("b is not null").select("a", "da", "b", "db").distinct(), "pairs"))
        first = graded.where("linked").select("u", "v")
        found = s.save(components(first, s, "one"), "found")
        home = s.save(components(graded.select("u", "v"), s, "fam"), "home")
        more = self._across(listed.where("b is null").select("v", F.col("a").alias("rep"), F.col("da").alias("d")), home)
        if not more.isEmpty():
            home = s.save(components(self._as_edges(home).unionByName(more), s, "wide"), "families")
        second = self._within(home, found)
        if not second.isEmpty():
            found = s.save(components(self._as_edges(found).unionByName(second), s, "two"), "components")
        return self._result(found)

    @staticmethod
    def _as_edges(found: DataFrame) -> DataFrame:
        return found.select(F.col("node").alias("u"), F.col("component").alias("v"))

    def _dealt(self, members: DataFrame, group: str, part: str, size: Column) -> tuple[DataFrame, DataFrame]:
        """Members of groups with several parts and their block ``own``; and the tiles (i, j) of blocks to hold against each other.

        A group of up to ``size`` members is one block; in others the largest part has
        blocks of its own, behind the others, which aren't held against each other.
        """
        sizes = members.groupBy(group, part).agg(F.count("*").alias("k"), F.max("n").alias("n"))
        sizes = sizes.groupBy(group).agg(F.sum("k").alias("all"), F.max("n").alias("n"), F.max(F.struct("k", F.col(part).alias("p"))).alias("m")).where("m.k < all").withColumn("size", size)
        one, blocks = F.col("all") <= F.col("size"), lambda k: F.ceil(k / F.col("size")).cast("int")
        outer, inner = F.when(one, 1).otherwise(blocks(F.col("all") - F.col("m.k"))), F.when(one, 0).otherwise(blocks(F.col("m.k")))
        plan = self.scratch.save(sizes.select(group, F.col("m.p").alias("core"), outer.alias("outer"), inner.alias("inner")), f"plan_{group}")
        at = members.join(plan, group).withColumn("core", (F.col("inner") > 0) & (F.col(part) == F.col("core")))
        own = F.when(F.col("core"), F.col("outer") + F.pmod(F.xxhash64("rep", "d"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("rep", "d"), F.col("outer"))).cast("int")
        tiles = plan.select(group, F.explode(F.expr("sequence(0, outer - 1)")).alias("i"), (F.col("outer") + F.col("inner")).alias("end"))
        tiles = tiles.select(group, "i", F.explode(F.expr("sequence(i, end - 1)")).alias("j"))
        return at.withColumn("own", own).drop("outer", "inner", "core"), tiles

    def _compared(self, members: DataFrame, tiles: DataFrame, group: str, columns: list[str], compare, name: str) -> DataFrame:
        """Distinct links (u, v) that ``compare`` finds in tiles of packed blocks; a block is packed once."""
        s, key, conf = self.scratch, "spark.sql.execution.arrow.maxRecordsPerBatch", self.docs.sparkSession.conf
        blocks = s.save(members.groupBy(group, "own").agg(F.collect_list(F.struct(*columns)).alias("members")), f"{name}_blocks", "none")
        side = lambda at, out: blocks.select(group, F.col("own").alias(at), F.col("members").alias(out))
        # of a block with itself only one copy travels
        left = tiles.join(side("i", "left"), [group, "i"])
        both = left.where("i < j").join(side("j", "right"), [group, "j"]).select("left", "right")
        both = both.unionByName(left.where("i = j").select("left", F.lit(None).cast(blocks.schema["members"].dataType).alias("right")))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    x = batch.column(0)[k].values
                    y = batch.column(1)[k].values if batch.column(1)[k].is_valid else x
                    if links := compare(x, y):
                        yield pa.record_batch({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})
            release_memory()

        before = conf.get(key)
        conf.set(key, str(TILES))
        out = s.save(both.mapInArrow(scan, "u long, v long").distinct(), name)
        conf.set(key, before)
        s.drop(f"{name}_blocks", f"plan_{group}")
        return out

    def _across(self, members: DataFrame, home: DataFrame) -> DataFrame:
        """Pairs of families that have members in one list for whom the estimate passes."""
        percent = self.percent
        at = members.join(home.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep", "left").withColumn("family", F.coalesce("family", "rep"))
        dealt, tiles = self._dealt(at.withColumn("n", F.lit(0)), "v", "family", F.lit(LIST))
        dealt = dealt.drop("n").join(self.reps.select("rep", "d", "n", "least", "bits", "sketch"), ["rep", "d"])

        def compare(x: pa.StructArray, y: pa.StructArray) -> list[tuple[int, int]]:
            (fx, nx, lx), (fy, ny, ly) = ([t.field(c).to_numpy(zero_copy_only=False) for c in ("family", "n", "least")] for t in (x, y))
            bx, by = (np.frombuffer(b"".join(t.field("bits").to_pylist()), np.uint64).reshape(-1, WORDS) for t in (x, y))
            sx, sy = ([v.values.to_numpy().view(np.uint64) ^ _SIGN for v in t.field("sketch")] for t in (x, y))
            joined, edges = _Union(), []
            for p, q in np.argwhere(_fits(bx, nx, lx, by, ny, ly, percent) & (fx[:, None] != fy[None])):
                a, b = int(fx[p]), int(fy[q])
                if joined.root(a) != joined.root(b) and estimate(sx[p], sy[q]) >= ESTIMATE * percent / 80:
                    joined.join(a, b)
                    edges.append((a, b))
            return edges

        return self._compared(dealt, tiles, "v", ["family", "n", "least", "bits", "sketch"], compare, "across")

    def _within(self, home: DataFrame, found: DataFrame) -> DataFrame:
        """Links inside families between classes whose components still differ: the exact comparison of block with block."""
        s, percent = self.scratch, self.percent
        members = home.select(F.col("node").alias("rep"), F.col("component").alias("family")).join(found.withColumnRenamed("node", "rep"), "rep", "left")
        members = members.withColumn("component", F.coalesce("component", "rep")).join(self.reps.select("rep", "d", "n"), "rep")
        size = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(BLOCK_VALUES / F.col("n")))).cast("int")
        dealt, tiles = self._dealt(members, "family", "component", size)
        dealt = s.save(dealt, "dealt")
        sets = s.save(self._sets(dealt.select(F.col("rep").alias("doc_id"))), "wholes", "none")

        def compare(x: pa.StructArray, y: pa.StructArray) -> list[tuple[int, int]]:
            (cx, rx), (cy, ry) = ([t.field(c).to_numpy(zero_copy_only=False) for c in ("component", "rep")] for t in (x, y))
            sx, sy = ([np.frombuffer(w.as_buffer(), np.uint64) for w in t.field("whole")] for t in (x, y))
            both = common_values(sx, sy)
            n, m = np.array([len(w) for w in sx])[:, None], np.array([len(w) for w in sy])[None]
            linked = (100 * both >= percent * (n + m - both)) & (cx[:, None] != cy[None])
            joined = _Union()
            return [(int(rx[p]), int(ry[q])) for p, q in np.argwhere(linked) if joined.join(int(cx[p]), int(cy[q]))]

        out = self._compared(dealt.join(sets, ["rep", "d"]), tiles, "family", ["component", "rep", "whole"], compare, "within")
        s.drop("wholes", "dealt")
        return out

    def _result(self, found: DataFrame) -> DataFrame:
        # what is known of a class meets its rows in one join, whose larger side can be split where a class has many
        classes = self.reps.select(F.col("n").alias("n_shingles"), "d1", "d2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
        out = self.sketched.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["n_shingles", "d1", "d2"], "left")
        component = F.coalesce("component", "rep", "doc_id")
        return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def common_values(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every one on the right, by products of slices of their 0/1 matrices."""

    def table_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (a, of_a), (b, of_b) = table_of(left), table_of(right)
    values = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float64)

    def places(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(values, x)
        at[at == len(values)] = 0
        held = values[at] == x
        order = np.argsort(at[held], kind="stable")
        return at[held][order], of[held][order]

    if len(values):
        (pa_, oa), (pb, ob) = places(a, of_a), places(b, of_b)
        for start in range(0, len(values), COLUMNS):
            sides = []
            for p, o, n in ((pa_, oa, len(left)), (pb, ob, len(right))):
                cut = slice(*np.searchsorted(p, [start, start + COLUMNS]))
                m = np.zeros((n, min(COLUMNS, len(values) - start)), np.float32)
                m[o[cut], p[cut] - start] = 1
                sides.append(m)
            out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return NearDuplicates(docs, width, percent).run()


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
overlap AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM overlap JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * i >= 80 * (x.n + y.n - i)
), edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.node, edges.v FROM reach JOIN edges ON edges.u = reach.seen)
SELECT words.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id, words.doc_id = c.component_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM reach GROUP BY node) c USING (doc_id)
"""
