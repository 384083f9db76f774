import random

from pantryplan.llm import linededup


def brute(rows, words):
    """Over every run of every document, its first place and its later ones."""
    docs = {}
    for i, t in rows:
        docs.setdefault((i, t or ""), (t or "").split("\n"))
    runs = {}
    for (i, t), lines in docs.items():
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) > words:
                    runs.setdefault(tuple(lines[a:b]), []).append((i, t, a))
    gone = set()
    for run, places in runs.items():
        first = min(p[0] for p in places)
        ties = {p for p in places if p[0] == first}
        keep = min(ties, key=lambda p: p[2])
        gone |= {(i, t, a + j) for i, t, a in places if (i, t, a) != keep for j in range(len(run))}
    return {(i, t): "\n".join(x for j, x in enumerate(lines) if (i, t, j) not in gone) for (i, t), lines in docs.items()}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 3, 6])))
    pool = [line() for _ in range(40)]
    passages = [[rng.choice(pool) for _ in range(rng.randrange(1, 12))] for _ in range(8)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(0, 5)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [line() + str(rng.random()), rng.choice(pool)]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "w " * 30 + "\n" + "w " * 30), (103, "a b c d e f g h i j k l\n" * 40), (104, rows[3][1]), (105, "\n" * 50), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, row string, pos int")
    want = brute(rows, 10)
    for limit in (linededup.BROADCAST_DOCS, 0):
        monkeypatch.setattr(linededup, "BROADCAST_DOCS", limit)
        got = linededup.dedup_lines(df, 10).select("doc_id", "text", "row", "pos", "n_lines", "n_deleted").collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r.doc_id, set()).add(r.text or "")
        assert by == {i: {want[i, t or ""]} for i, t in rows}
        assert sum(r.n_deleted for r in got) > 50


def test_edge_tables(spark):
    df = spark.createDataFrame([(None, "a b c\n" * 30), (1, "a b c\n" * 30), (2, "own words")], "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.dedup_lines(df, 50).collect()}
    assert got[2].text == "own words" and got[1].n_deleted == 31 and got[1].text == ""
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    assert [r.n_deleted for r in linededup.dedup_lines(df.where("doc_id = 2")).collect()] == [0]
