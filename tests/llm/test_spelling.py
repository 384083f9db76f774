import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pantryplan.llm import spelling


def apart_by_one(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying them."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if apart_by_one(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("tile", [1024, 8])
def test_against_brute_force(spark, tile, monkeypatch):
    """With blocks of eight words the groups of common halves need tiles across blocks."""
    monkeypatch.setattr(spelling, "TILE", tile)
    rng = np.random.default_rng(4)
    words = {"".join(rng.choice(list("abé"), rng.integers(6, 9))) for _ in range(400)} | {"common" + x for x in "abcdefghijklmnopqrstuvwxyz"} | {"x" * 3000, "x" * 3001, "x" * 3000 + "y"}
    words |= {"commo" + x for x in ("n", "nn", "nnnn")} | {"zcommon", "aaaaaa", "aaaaaaa", "aaaaaaaa", "ÿÿÿÿÿÿ", "ÿÿÿÿÿé"}
    counts = {w: int(5 ** rng.integers(1, 6)) for w in sorted(words)}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {tuple(r) for r in got} == brute(counts) and len(got) == len(counts)
    assert {r.root for r in got} != {r.word for r in got}


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_query(spark, tmp_path):
    rng = np.random.default_rng(9)
    stems = ["".join(rng.choice(list("abcdeéÉAÆ×"), rng.integers(5, 10))) for _ in range(30)]
    texts = [" 9".join(rng.choice(stems, 200)) + "." for _ in range(60)] + [None, "", "ABCDEF-abcdef", "ß" * 9 + "\U0001d400" + "ŒŒŒŒŒŒ", "abcdef " * 30_000]
    rows = [(None if i == 4 else i, t, "clash") for i, t in enumerate(texts)] + [(5, texts[5], "clash")]
    spark.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = [tuple(r) for r in spelling.op12_spelling_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert set(got) == brute(counts) and len(got) == len(counts) > 20
