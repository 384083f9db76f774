import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
from pantryplan.llm import bpe  # noqa: E402
from pantryplan.llm.tokens import PieceEncoder  # noqa: E402

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LIB = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
ENC = {p: PieceEncoder(p, leaf_chars=8) for p in (BYTE, WORD)}

text = st.lists(
    st.sampled_from(["a", "the", "'s", "'", "é", "é", "́", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "᠎", "​", " ", "1", "23", "!", "<|endoftext|>", "<|startoftext|>", "😀", "中文", "ß", "İ", "Σ", "\x00", "﻿"])
    | st.characters(exclude_categories=["Cs"])
    | st.text(alphabet="abc", min_size=5, max_size=60)
    | st.text(alphabet="aeiou nrstéÉß',.1½", min_size=5, max_size=80),
    max_size=40,
).map("".join)


def ids(enc, t):
    blob = enc.encode_bytes([t])[0]
    return [int.from_bytes(blob[i : i + 4], "little") for i in range(0, len(blob), 4)]


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=400, deadline=None)
@given(t=text)
def test_same_ids_as_the_library(path, t):
    want = LIB[path].encode(t, add_special_tokens=False).ids
    assert ids(ENC[path], t) == want
    if path == BYTE:
        assert ENC[path].decode(want) == LIB[path].decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(t=st.text(alphabet="aeinst", min_size=9, max_size=400) | st.text(alphabet="é中=!-", min_size=9, max_size=300))
def test_tree_concatenation_equals_one_encoding(t):
    assert ENC[BYTE].encode_long(t) == LIB[BYTE].encode(t, add_special_tokens=False).ids


spaced = st.lists(st.sampled_from(["a", "the ", " 's", "é", " ", "  ", "\n", " \n", "12", "! ", "中文 ", "x y ", " re"]) | st.text(alphabet="abe ", min_size=1, max_size=12), min_size=4, max_size=80).map("".join)


@settings(max_examples=400, deadline=None)
@given(t=spaced)
def test_tree_over_whole_texts(t):
    assert ids(ENC[BYTE], t) == LIB[BYTE].encode(t, add_special_tokens=False).ids


def test_every_long_document_goes_through_the_tree():
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    enc = PieceEncoder(BYTE)
    long_ = [t for t in texts if len(t) > enc.leaf_chars]
    assert long_
    for t in long_:
        before = enc.joins + enc.piece_joins
        assert ids(enc, t) == LIB[BYTE].encode(t, add_special_tokens=False).ids
        leaves = -(-len(t) // enc.leaf_chars)
        assert enc.joins + enc.piece_joins - before >= leaves - 1


@pytest.mark.parametrize(
    "t",
    [
        "two  spaces  between " * 1100, "a,b;c1,12.5\n" * 3500, ("some words here " * 460 + "<|endoftext|>") * 2, "short\n" * 2000 + "x" * 1600, "word " * 1500 + "y" * 9000 + " and more" * 900, "tab\tand\u3000wide" * 900, "<|endoftext|>" * 400 + "a b " * 900,
    ],
)
def test_long_texts_of_any_kind_make_joins(t):
    enc = PieceEncoder(BYTE)
    assert ids(enc, t) == LIB[BYTE].encode(t, add_special_tokens=False).ids
    stretches = sum(len(p) // enc.leaf_chars for p in enc.special_split.split(t) if p not in enc.special)
    assert enc.joins + enc.piece_joins >= max(1, stretches // 2)


def test_the_library_alone_gives_the_same_ids():
    for t in ("The quick (brown) fox's 12 jumps " * 40, "éà ß İ", "Long " + "w" * 3000):
        slow = PieceEncoder(WORD, fast=False)
        assert slow.merger is None and ids(slow, t) == LIB[WORD].encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("t", ["a" * 5000, "!=" * 3000, " " * 4000 + "x", "ab" * 4000 + "c", "é" * 3000])
def test_long_unsplit_texts(t):
    assert ids(ENC[BYTE], t) == LIB[BYTE].encode(t, add_special_tokens=False).ids


def test_long_texts_are_dealt_over_tasks(spark, monkeypatch):
    """Parts of a text are encoded apart and joined; other columns and rows stay as they are."""
    monkeypatch.setattr(bpe, "DEALT_CHARS", 300)
    monkeypatch.setattr(bpe, "PART_CHARS", 100)
    texts = ["the quick brown fox's  " * 40, "<|endoftext|>" + "a b " * 200 + "<|endoftext|>x", "z" * 900, "é中 " * 120, "same text here " * 30, "same text here " * 30, "short", None, ""]
    df = spark.createDataFrame([(None if i == 3 else i % 6, t, f"p{i}") for i, t in enumerate(texts)], "doc_id long, text string, part string").repartition(3)
    got = {r.part: r for r in bpe.round_trip(df, BYTE, "text", "coded").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[f"p{i}"]
        assert r.text == t and r.coded.decoded == (t or "") and r.coded.ids == LIB[BYTE].encode(t or "", add_special_tokens=False).ids


def test_round_trip_of_a_table(spark):
    texts = [None, "", "Hello  world\n", "x" * 9000, "dup", "dup", "<|endoftext|> é😀"]
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)], "doc_id long, text string, ids_note string")
    rows = {r.doc_id: r for r in bpe.digests(df, BYTE).collect()}
    for i, t in enumerate(texts):
        want = LIB[BYTE].encode(t or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(want)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0), BYTE).count() == 0


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(alphabet="abcéÉß',.1½ <|>\n\t\xa0", max_size=60) | text, max_size=12))
def test_same_ids_by_words(texts):
    """Texts that are looked up word by word together, beside others that are not."""
    enc = PieceEncoder(WORD, cache_pieces=20, fast=False)
    for _ in range(2):
        assert [list(memoryview(b).cast("I")) for b in enc.encode_bytes([None, *texts, ""])] == [[], *(LIB[WORD].encode(t, add_special_tokens=False).ids for t in texts), []]


def test_new_units_are_encoded_as_one_text():
    """The library's call costs more than a short unit: three hundred new units are one call on one text."""
    enc, sent = PieceEncoder(WORD, fast=False), []
    batch = enc._batch
    enc._batch = lambda texts: sent.extend(texts) or batch(texts)
    texts = [" ".join(f"wörd{chr(97 + i // 26)}{chr(97 + i % 26)}'s, {i}" for i in range(300))] * 3
    assert [list(memoryview(b).cast("I")) for b in enc.encode_bytes(texts)] == [LIB[WORD].encode(t, add_special_tokens=False).ids for t in texts]
    assert len(sent) == 1
