import random
import zlib

import numpy as np

from pantryplan.llm import classifier as c


def test_features_are_a_sorted_set_of_numbers():
    f = c.features("The the THE a b a b é x")
    assert (np.diff(f) > 0).all() and f[0] == 0 and f.max() < c.SIZE
    assert c.features(None).tolist() == c.features(" \n").tolist() == [0]


def test_descent_separates_and_meets_optimality():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(1, 50, 8), [0, 60 + (i % 2)])).astype(np.int32) for i in range(200)]
    good = np.arange(200) % 2 == 0
    ratio = c._log_ratio(rows, good)
    w = c._descend(rows, good, ratio, 1.0, 100, 1)
    m = np.array([(w[r] * ratio[r]).sum() / np.sqrt((ratio[r] ** 2).sum()) for r in rows])
    assert ((m > 0) == good).all()


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1200):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        bad = rng.random() < 0.2
        if bad:
            w = [x.upper() + "!!" if rng.random() < 0.7 else x for x in w]
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(not bad), 0))
    docs += [(5000, None, "x"), (5001, "", "x"), (None, "some text", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = c.fit(d, lab)
    rows = c.classify(d, model).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in labels], lab.schema)
    assert np.array_equal(c.fit(d, flipped).weights, model.weights)
    assert c.classify(d.limit(0), c.fit(d, lab.limit(0))).count() == 0
    assert {round(r.score, 6) for r in c.classify(d, c.fit(d, lab.limit(0))).collect()} == {0.5}
