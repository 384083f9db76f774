import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pantryplan.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.none() | st.lists(st.sampled_from(["a", "b", "é", " ", " ", "\n", "\t", "#", "a b c d e ", "line\n", "😀", "\x1c"]), max_size=80).map("".join))
def test_counts_against_brute_force(text):
    assert rules.measure(text)[:5] == brute(text)


def test_window_codes_of_large_vocabularies():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.arange(7000), rng.integers(0, 7000, 500), np.arange(100, 140)])
    grams = Counter(tuple(ids[i : i + 5].tolist()) for i in range(len(ids) - 4))
    want = {i + j for i in range(len(ids) - 4) if grams[tuple(ids[i : i + 5].tolist())] > 1 for j in range(5)}
    assert rules.repeated_words(ids, 7000) == len(want) > 0


def test_share_of_bad_rows_that_only_the_forest_finds():
    """Grown on rows of even doc_id, held against those of odd ones."""
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.1"
    text = dict(zip(*(pq.read_table(f"{folder}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text"))))
    label = dict(zip(*(pq.read_table(f"{folder}/labels.parquet").column(c).to_pylist() for c in ("doc_id", "quality"))))
    ids = np.array([i for i in text if label.get(i) is not None])
    counts, good = np.array([rules.measure(text[i]) for i in ids]), np.array([label[i] == 1 for i in ids])
    open_ = ~rules.base_failed(counts)
    x, good, even = rules.features(counts[open_]), good[open_], ids[open_] % 2 == 0
    box = tuple(np.quantile(x[even], [0.001, 0.999], axis=0))
    forest = rules.calibrate(rules.Forest.grow(x[even & good], box), x[even], good[even], 0.005)
    gone = forest.score(x) > forest.threshold
    assert gone[~even & ~good].mean() > 0.9 and gone[~even & good].mean() < 0.015


def test_verdicts(spark):
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(words, rng.integers(40, 90))) + "." for _ in range(300)]
    bad = [" ".join(w + "***" for w in rng.choice(words, 60)) for _ in range(20)]
    texts = [*good, *bad, None, "", "short one", "x " * 50]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(320)] + [(0, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r.rules for r in rules.verdicts(docs, rules.fit(docs, labels)).collect()}
    assert sum(not rows[i].kept for i in range(300)) <= 3
    assert sum(not rows[i].kept for i in range(300, 320)) >= 18
    assert all(rows[i].base_failed and not rows[i].kept for i in range(320, 324))
    none = rules.verdicts(docs, rules.fit(docs, labels.limit(0)))
    assert none.where("rules.kept = rules.base_failed").count() == 0
    assert rules.verdicts(docs.limit(0), rules.fit(docs.limit(0), labels)).count() == 0


def test_threshold_comes_from_all_labelled_rows(spark):
    """As few rows grow the forest as two trees take, and yet every row counts for the threshold."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(w + "*" * (i >= 400) for w in rng.choice(words, rng.integers(30, 60))) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    forest = rules.fit(docs, labels, 0.01, trees=2, sample=8)
    assert len(forest.trees) == 2
    score = forest.score(rules.features(np.array([rules.measure(t) for t in texts])))
    cuts = np.unique(np.ceil(score * rules.CUTS) / rules.CUTS)
    lost, caught = (np.array([(score[part] > c).mean() for c in cuts]) for part in (slice(0, 400), slice(400, 600)))
    assert forest.threshold == cuts[np.argmax(np.where(lost <= 0.01, caught - lost, -1.0))]
