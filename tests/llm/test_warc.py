import gzip
import hashlib

import pytest

from pantryplan.llm import warc
from pantryplan.llm.common import Scratch


def test_records_round_trip():
    payload = b"a\r\n\r\nWARC/1.1\r\n" * 9
    blob = b"".join(gzip.compress(warc.record(i, "http://x/\n a", payload, "d", None if i else 7, "2000-01-01T00:00:00Z")) + warc.TRAILER for i in range(3))
    got = list(warc.records(blob))
    assert [h["warc-type"] for h, _ in got] == ["revisit", "response", "response"]
    assert got[1][1].endswith(payload) and got[0][0]["warc-refers-to"] == "<urn:record:7>"
    # the same stream in other members, and cut off
    plain = gzip.decompress(blob)
    assert list(warc.records(gzip.compress(plain[:50]) + gzip.compress(plain[50:]))) == got
    with pytest.raises(ValueError):
        list(warc.records(blob[:-5]))


def brute(rows):
    out = []
    for i, p in rows:
        b = (p or "").encode()
        same = [j for j, q in rows if (q or "") == (p or "") and j is not None]
        first = min(same, default=None)
        old = len(b) >= 100 and i is not None and i > first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if old else "response", first if old else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [warc.BROADCAST_DIGESTS, 1])
def test_against_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", limit)
    rows = [(i, ["é" * 50, "x" * 99, "same " * 40, None, "", "own %d " % i * 30][i % 6]) for i in range(60)]
    rows += [(2, "same " * 40), (8, "own 5 " * 30), (None, "same " * 40), (99, "\r\n\r\n" * 60), (98, "\r\n\r\n" * 60)]
    df = spark.createDataFrame([(i, None if i == 3 else f"http://h/{i}", p, "d") for i, p in rows], "id long, url string, payload string, digest string")
    scratch = Scratch(spark, "t")
    warc.write_archives(df.repartition(3), scratch.path("a"))
    got = [(r.id, r.bytes, r.actual, r.record_type, r.refers_to) for r in warc.resolve(warc.read_archives(spark, scratch.path("a"))).collect()]
    assert sorted(got, key=str) == brute(rows)
    warc.write_archives(df.limit(0), scratch.path("none"))
    assert warc.resolve(warc.read_archives(spark, scratch.path("none"))).count() == 0
