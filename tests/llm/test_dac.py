import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from pantryplan.llm import dac  # noqa: E402
from pantryplan.llm.common import Scratch  # noqa: E402

WORD = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=80, deadline=None)
@given(ids=st.lists(st.integers(0, 255) | st.integers(0, 70_000) | st.integers(0, 2**32 - 1), max_size=1500))
def test_random_access_and_round_trip(ids):
    blob = dac.pack([7, None], [len(ids), 0], np.array(ids, np.uint32))
    seg = dac.Segment(blob)
    assert seg.decode().tolist() == ids and seg.doc_ids == [7, None] and seg.end == len(blob)
    assert [seg.access(i) for i in range(0, len(ids), 7)] == ids[::7]


def test_a_cut_file_is_noticed():
    blob = dac.pack([1], [3], np.array([1, 2, 300], np.uint32)) + dac.TRAILER
    assert len(list(dac.segments(blob * 2))) == 2
    with pytest.raises(ValueError):
        list(dac.segments(blob[:-3]))


def test_files_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT_IDS", 500)
    lib = Tokenizer.from_file(WORD)
    texts = ["b c", None, "", "Naïve  Été\n\n#1 <|endoftext|>", "x" * 5000, "b c", *[f"doc {i} " * (i % 40) for i in range(200)]]
    rows = [(1000 - 3 * i, t, "note") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    scratch = Scratch(spark, "t")
    dac.write(df.repartition(3), scratch.path("f"), WORD)
    got = {r.doc_id: r for r in dac.offsets(scratch.save(dac.read(spark, scratch.path("f")), "docs")).collect()}
    at = 0
    for doc, t, _ in sorted(rows):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[doc].start, got[doc].n_tokens) == (at, len(ids))
        assert got[doc].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    dac.write(df.limit(0), scratch.path("none"), WORD)
    assert dac.offsets(dac.read(spark, scratch.path("none"))).count() == 0
