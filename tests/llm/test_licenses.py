import random
import time

import pytest

from pantryplan.llm import licenses as x

S = x.Scanner(x.TEMPLATES)


@pytest.mark.parametrize("name", sorted(x.TEMPLATES))
def test_each_template_finds_itself(name):
    text = f"é some text\nbefore\n{x.TEMPLATES[name]}\nand after it"
    (start, stop, got, saved, changes), *rest = S.scan(text)
    assert got == name and not changes and not rest and saved > 0
    assert x._bare(text[start:stop]) == x._bare(x.TEMPLATES[name])


def test_wording_differences():
    (row,) = S.scan("This work is licensed under the GNU General Public License, edition 3.")
    assert row[2] == "GPL-3.0" or row[2] == "GPL-2.0"
    assert S.scan("This work has a license of some kind that we wrote ourselves.") == []
    wrapped = x.TEMPLATES["MIT-text"].replace("free of charge", "free of cost").replace(", to deal", ",\nto deal")
    (row,) = S.scan("x\n" + wrapped + "\ny")
    assert row[2] == "MIT-text" and sorted(row[4]) == ["+cost", "-charge"]
    assert len(S.scan("Released under the MIT License.\n" * 3)) == 3
    assert S.scan("copyright " * 500) == [] and S.scan(None) == S.scan("") == []


def test_notices_before_the_winner_and_cues_behind_the_first_line():
    text = "All rights reserved. Licensed under the Apache License, Version 2.0."
    assert [(text[r[0] : r[1]].rstrip("."), r[2]) for r in S.scan(text)] == [("All rights reserved", "all-rights-reserved"), ("Licensed under the Apache License, Version 2.0", "Apache-2.0")]
    for at in (" Mozilla", " the terms", " Public", " subject"):
        wrapped = "some words before\n" + x.TEMPLATES["MPL-2.0"].replace(at, "\n" + at[1:]) + "\nand after"
        (row,) = S.scan(wrapped)
        assert row[2] == "MPL-2.0" and not row[4] and wrapped[row[0] :].startswith("This Source")
    assert [r[2] for r in S.scan("All rights\nreserved.\nReleased under the MIT License. All rights reserved.")] == ["all-rights-reserved", "MIT", "all-rights-reserved"]


def brute(text):
    """Blocks of every length of a template at every place of a text, without the index of parts; ranking all pairs, without a bound."""
    words = [(m.start(), m.end(), x._bare(m[0])) for m in x._WORD.finditer(text) if x._bare(m[0])]
    found = set()
    for want in S.templates.values():
        slack = len(want) // x.WORDS_PER_DIFFERENCE
        for at in range(-slack, len(words) - len(want) + slack + 1):
            a, b = max(at - slack, 0), min(at + len(want) + slack, len(words)) - 1
            block = text[words[a][0] : words[b][1]]
            for saved, name in S.savings(block):
                hit = S.wording(block, name)
                if hit and hit[3] <= len(S.templates[name]) // x.WORDS_PER_DIFFERENCE:
                    found.add((x.PENALTY * hit[3] - saved, name, words[a][0] + hit[0], words[a][0] + hit[1]))
    out = []
    for _, name, start, stop in sorted(found):
        if all(stop <= o[0] or start >= o[1] for o in out):
            out.append((start, stop, name))
    return sorted(out)


def mixed(rng, notices, odd=True):
    words = []
    for _ in range(notices):
        words += [rng.choice(["some", "license", "the", "software", "under", "text\n"]) for _ in range(rng.randrange(0, 12))]
        notice = x.TEMPLATES[rng.choice([n for n, t in sorted(x.TEMPLATES.items()) if len(t.split()) < 60])].split()
        for _ in range(rng.choice([0, 0, 1, len(notice) // 8, len(notice) // 6]) if odd else 0):
            at = rng.randrange(len(notice))
            notice[at : at + rng.randrange(0, 2)] = rng.choice([[], ["odd"], ["odd", "words"]])
        words += notice
    return " ".join(words)


def test_against_brute_force():
    rng = random.Random(6)
    for _ in range(12):
        text = mixed(rng, rng.randrange(1, 3))
        assert [(a, b, n) for a, b, n, _, _ in S.scan(text)] == brute(text)


def test_the_ranking_decides(monkeypatch):
    """The wording of a short notice stands in a longer one's: only what compression saves tells them apart."""
    text = "before " + x.TEMPLATES["Apache-2.0-header"] + " behind"
    assert [r[2] for r in S.scan(text)] == ["Apache-2.0-header"]
    flat = x.Scanner(x.TEMPLATES)
    monkeypatch.setattr(flat, "savings", lambda block: [(1, n) for n in sorted(flat.templates)])
    assert [r[2] for r in flat.scan(text)] != ["Apache-2.0-header"]
    rng = random.Random(3)
    texts = [mixed(rng, 3, odd=False) for _ in range(30)]
    assert any([r[:3] for r in S.scan(t)] != [r[:3] for r in flat.scan(t)] for t in texts)


def test_time_is_linear_in_notices():
    def seconds(n):
        scanner = x.Scanner(x.TEMPLATES)
        started = time.time()
        assert len(scanner.scan("All rights reserved. " * n)) == n
        return time.time() - started

    assert seconds(32_000) < 14 * max(seconds(4_000), 0.02)


def test_two_notices_on_one_line():
    text = "Licensed under CC BY 4.0. Released under the MIT License."
    assert [r[2] for r in S.scan(text)] == ["CC-BY-4.0", "MIT"]
    many = "All rights reserved. " * 800
    assert len(S.scan(many)) == 800


def test_table(spark):
    rows = [(1, "a\nReleased under the MIT License."), (1, "a\nReleased under the MIT License."), (2, None), (3, ""), (None, "All rights reserved."), (5, "word " * 5000 + "\nLicensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = sorted((str(r.doc_id), r.license) for r in x.scan(df).collect())
    assert got == [("1", "MIT"), ("1", "MIT"), ("5", "CC-BY-NC-4.0"), ("None", "all-rights-reserved")]
    assert x.scan(df.limit(0)).count() == 0
