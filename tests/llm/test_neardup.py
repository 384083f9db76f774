import itertools
import random
import re

import numpy as np
import pytest

from pantryplan.llm import graph, neardup
from pantryplan.llm.common import Scratch


def grams(text, width):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width):
    ids = [i for i, _ in rows]
    sets = [grams(t, width) for _, t in rows]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            i = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * i >= 80 * (len(sets[x]) + len(sets[y]) - i):
                a, b = sorted((root(ids[x]), root(ids[y])))
                parent[b] = a
    return {(i, len(s), root(i), root(i) == i) for i, s in zip(ids, sets)}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["The", "of", "É"] * 60
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c", "a b c d", "A B C d e", "a b"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 8, 20, 45, 60, 90, 300]))] for _ in range(25)]
    for b in base:
        for _ in range(rng.choice([0, 1, 3, 12])):
            w = list(b)
            for _ in range(int(len(w) * rng.choice([0, 0.01, 0.04, 0.08, 0.12]))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            w = w[: rng.randrange(int(len(w) * 0.8), len(w) + 1)]
            texts.append(" ".join(w))
        texts.append("\t".join(b))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("width,seed", [(2, 1), (5, 2), (2, 3)])
def test_against_brute_force(spark, width, seed, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "LIST", 5)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, rep string, component long")
    got = {tuple(r) for r in neardup.near_duplicates(df, width).collect()}
    assert got == brute(rows, width)


def appended(pairs=150, seed=4):
    """Texts of 49 to 76 shingles of one word and longer copies of them, of similarity 0.8 and a little more."""
    rng, texts = random.Random(seed), []
    for p in range(pairs):
        n = rng.randrange(49, 77)
        w = [f"p{p}w{i}" for i in range(n * 5 // 4)]
        texts += [" ".join(w[:n]), " ".join(w)]
    return list(enumerate(texts))


def test_estimates_of_sets_little_larger_than_a_sketch(spark):
    df = spark.createDataFrame(appended(), "doc_id long, text string")
    made = {r.doc_id: np.array(r.sketch, np.int64).view(np.uint64) ^ neardup._SIGN for r in neardup.sketches(df, 1, 80).collect()}
    sets = [set(neardup.shingle_set(t, 1).tolist()) for _, t in appended()]
    for p in range(len(sets) // 2):
        want = sum(x in sets[2 * p] for x in sorted(sets[2 * p + 1])[: neardup.K]) / neardup.K
        assert neardup.estimate(made[2 * p], made[2 * p + 1]) == pytest.approx(want)


def test_appended_copies_of_different_families(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NEIGHBOURS", 0)  # none: all pairs are of different families
    rows = appended()
    got = {tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert got == brute(rows, 1)


def test_bits_bound_common_values():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    low = [np.sort(rng.choice(pool, neardup.K, replace=False)) for _ in range(40)]
    bits, n = np.array([neardup.bitmap(s) for s in low])[None], np.full((1, 40), neardup.K)
    for least in (3, 6, 9):
        _, fits = neardup._fitting(bits, n, np.full((1, 40), least), 80)
        for x, y in itertools.combinations(range(40), 2):
            assert fits[0, x, y] or len(np.intersect1d(low[x], low[y])) < least


def test_common_values(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 7)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 90, k).astype(np.uint64)) for k in (0, 1, 5, 30, 60, 80)]
    got = neardup.common_values(sets[:4], sets[2:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:4]]


def test_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(300, 301), (302, 301), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in graph.components(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {i: 1 for i in range(1, 201)} | {300: 300, 301: 300, 302: 300}


def test_edge_rows(spark):
    text = "some words that are there twice in this small table of texts"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text), (7, None), (None, None)], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in neardup.near_duplicates(df, 2).select("doc_id", "component_id", "kept").collect())))
    assert got == sorted(map(str, [(5, 5, True), (5, 5, True), (9, 5, False), (7, 7, True), (None, 5, True), (None, None, True)]))
    assert neardup.near_duplicates(df.limit(0), 2).count() == 0


@pytest.mark.parametrize("members", [512, 2048])
def test_a_family_of_unlinked_members_makes_a_row_each(spark, members, monkeypatch):
    """One member a block, whatever the number of blocks; tiles are pairs of blocks."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "BLOCK", 128)
    rows = spark.range(members).select(F.col("id").alias("rep"), F.col("id").alias("d"), F.lit(1).cast("long").alias("family"), F.col("id").alias("component"), F.lit(10).cast("long").alias("n"))
    job = neardup.NearDuplicates(rows)
    dealt, tiles = job._dealt(rows, "family", "component", F.lit(128))
    blocks = -(-members // 128)
    assert dealt.count() == members and tiles.count() <= (blocks + 1) * (blocks + 2) // 2
    held = {(r.i, r.j) for r in tiles.collect()}
    own = {r.own for r in dealt.select("own").distinct().collect()}
    assert all((i, j) in held for i in own for j in own if i < j)


def test_very_long_and_repeated_texts(spark):
    rng = random.Random(8)
    long_ = " ".join(f"t{rng.randrange(50_000)}" for _ in range(120_000))
    rows = [(1, long_), (2, long_ + " and a little more"), (3, "short text of a few words here"), (3, "short text of a few words here"), (4, long_.upper())]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 1)}


def exact_links(sets, percent=80):
    """All links of a large table: by size order and the rarest shingles of each set, which any linked set must meet."""
    from collections import Counter, defaultdict

    count = Counter(g for s in sets.values() for g in s)
    rank = {g: i for i, (g, _) in enumerate(sorted(count.items(), key=lambda x: x[1]))}
    lists, links = defaultdict(list), []
    for doc, s in sorted(sets.items(), key=lambda x: len(x[1])):
        order, seen = sorted(rank[g] for g in s), set()
        for g in order[: len(s) - -(-percent * len(s) // 100) + 1]:
            for other in lists[g]:
                if other not in seen:
                    seen.add(other)
                    if 100 * len(sets[other]) >= percent * len(s):
                        both = len(s & sets[other])
                        if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                            links.append((doc, other))
            lists[g].append(doc)
    return links


def test_recall_on_ten_thousand_documents(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    sets = {i: s for i, x in zip(t["doc_id"], t["text"]) if (s := grams(x, 2))}
    # copies of one set are linked by themselves
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    parent = {i: first[frozenset(s)] for i, s in sets.items()}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = exact_links({i: set(s) for s, i in first.items()})
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 2).collect()}
    assert len(got) >= 10_000 and len(links) > 100
    assert sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
    # and nothing that isn't linked
    assert all(root(i) == root(got[i]) for i in sets)
