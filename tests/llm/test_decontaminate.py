import random
from collections import Counter

from pantryplan.llm import decontaminate as d


def shingles(words):
    return Counter(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    low = sum(len(s) * min(a[s], b[s]) for s in a | b)
    high = sum(len(s) * max(a[s], b[s]) for s in a | b)
    return low / high if high else 0.0


def brute(docs, items):
    out = {}
    for i, t in docs:
        w = (t or "").lower().split()
        for j, u in items:
            v = (u or "").lower().split()
            if v:
                k = min(5, len(v))
                starts = {max(0, min(p - o, len(w) - len(v))) for p in range(len(w) - k + 1) for o in range(len(v) - k + 1) if w[p : p + k] == v[o : o + k]}
                best = max((similarity(shingles(w[s : s + len(v)]), shingles(v)) for s in starts), default=0)
                if best >= 0.8:
                    out[i, j] = round(best, 9)
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocab = [f"{a}{b}" for a in ("al", "be", "cor", "dé", "ef") for b in ("ta", "no", "rix", "u")]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(0, say(30)), (1, say(15) + "\n" + say(20)), (2, None), (3, ""), (4, "short Item here"), (5, say(60)), (6, "a a a a a a a a a a"), (7, say(6))]
    items.append((8, items[0][1]))
    docs = []
    for i in range(120):
        text = say(rng.randrange(0, 80)).split()
        if i % 2:
            leak = rng.choice([t for _, t in items if t]).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                leak[rng.randrange(len(leak))] = "changed"
            if rng.random() < 0.2:
                leak = leak[: rng.randrange(3, len(leak) + 1)]
            at = rng.randrange(len(text) + 1)
            text[at:at] = leak
        docs.append((i, rng.choice([" ", "\n", "  "]).join(text).upper() if i % 3 else " ".join(text)))
    docs += [(None, docs[1][1]), (500, None), (501, ""), (502, "a a a a a a a a a a a a a"), (503, docs[1][1]), (504, docs[1][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in d.contaminated(df, it).collect()}
    assert got == brute(docs, items) and len(got) > 20
    assert d.contaminated(df.limit(0), it).count() == 0 == d.contaminated(df, it.limit(0)).count()
    for limit in ("BROADCAST_SHINGLES", "BROADCAST_DOCS", "BROADCAST_ITEMS"):
        monkeypatch.setattr(d, limit, 1)
    assert {(r.doc_id, r.item_id) for r in d.contaminated(df, it).collect()} == set(got)


def test_measured_loss_of_the_radius():
    """Windows of 140 words with three replaced ones have a similarity of just over 0.8: how many fingerprints are further apart than the radius."""
    import numpy as np
    import xxhash

    def fingerprint(counts):
        h = np.array([xxhash.xxh64_intdigest(s) for s in counts], np.uint64)
        w = np.array([len(s) * n for s, n in counts.items()])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        return (w[:, None] * (2 * bits.astype(int) - 1)).sum(0) > 0

    rng, near = random.Random(12), []
    for _ in range(6000):
        words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(140)]
        other = list(words)
        for at in rng.sample(range(8, 132, 8), 3):
            other[at] = "".join(rng.choices("qrstuvwxyz", k=len(other[at])))
        a, b = shingles(words), shingles(other)
        if 0.8 <= similarity(a, b) < 0.82:
            near.append(int((fingerprint(a) != fingerprint(b)).sum()))
    lost = sum(x > d.RADIUS for x in near) / len(near)
    print(f"lost {lost:.5f} of {len(near)}")
    assert len(near) > 2000 and lost < 0.003
