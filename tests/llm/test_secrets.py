import base64
import hashlib
import random
import re

from pantryplan.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def test_against_brute_force(spark):
    rng = random.Random(5)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", "=", ":", " ", "  ", '"', "'", "\n", "é😀", "AKIA", "AKIA" + "Q7" * 9, "ab12" * 4, "0" * 15, "f" * 16, "abc", "ABCDEFGHIJKLMNOP", "token: secret: abcdefghijklmnop", "x.y_z-/+=" * 2]
    texts = [None, "", "é" * 30, "token = 'abcdefghijkl'", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(300)), "ab12" * 4000, "deadbeefdeadbeef " * 300]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(4, texts[4], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = secrets.scan(docs, secrets.cuts(docs)).withColumn("w", secrets._written(secrets.F.col("base"))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[r.doc_id])
        assert [(s.start, s.kind, s.stop) for s in r.base] == want
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in want) for k in range(3)]
        assert r.w == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
    assert secrets.scan(docs.limit(0), secrets.cuts(docs.limit(0))).count() == 0


def test_battery_tells_random_from_ordinary(spark):
    rng = random.Random(11)
    secret = [base64.b64encode(rng.randbytes(n)).decode() for n in (18, 24, 33, 48) for _ in range(120)]
    words = ["Config", "path", "User", "data", "2024", "index", "Main", "test1", "build"]
    plain = [s[: rng.randrange(24, 70)] for _ in range(480) if re.search("[0-9]", s := "/".join(rng.choice(words) for _ in range(16)))]
    texts = [f"word {s} word" for s in secret + plain]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secrets.scan(docs, secrets.cuts(docs)).collect()
    found = {r.doc_id for r in rows if any(s.kind == 3 for s in r.spans)}
    assert len([i for i in found if i < len(secret)]) >= 0.85 * len(secret)
    assert len([i for i in found if i >= len(secret)]) <= 0.1 * len(found)


def test_query(spark, tmp_path):
    key = "k7Q2mZx9Rt4WbVn8Lp3SdFg6"
    texts = ["password = '" + "x" * 12 + "'", "AKIA" + "Q7" * 8 + " and " + "0a" * 9, None, "", f"word {key} word"]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, texts[0], 5)]
    spark.createDataFrame(rows, "doc_id long, text string, n_hex int").write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op7_secret_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[r.doc_id or 0])
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in want) for k in range(3)]
        assert r.spans == text or r.doc_id == 4


def test_share_of_random_strings_found_by_length(spark):
    """The longer a random string, the surer it is found; letters-only strings have no alphabet that they must be drawn from, and are never judged."""
    rng = random.Random(21)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["x " + "".join(rng.choices(alphabet, k=n)) + " y" for n in (24, 40, 80) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id for r in secrets.scan(docs, secrets.cuts(docs)).collect() if any(s.kind == 3 for s in r.spans)}
    digits = [i for i, t in enumerate(texts) if re.search("[0-9]", t)]
    assert len(found & set(digits)) >= 0.9 * len(digits)
    letters = spark.createDataFrame([(1, "z " + "QwErTyUiOpAsDfGhJkLzXcVb" + " z")], "doc_id long, text string")
    assert secrets.scan(letters, secrets.cuts(docs)).first().spans == []
