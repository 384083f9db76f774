import corpus_pipeline


def test_stages_on_planted_rows(spark, tmp_path):
    import random

    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    item, passage = say(40), say(70)
    clean = [say(120) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(clean)]
    docs += [(100, clean[0]), (101, clean[1].replace(" ", "  ", 3) + " tail"), (102, say(30) + "\n" + item + "\n" + say(30)), (103, "too short"), (104, say(60) + "\n" + passage), (105, say(60) + "\n" + passage), (106, None), (107, "x " * 100)]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(rows) == {*range(60), 104, 105}
    assert passage in rows[104].text and passage not in rows[105].text and rows[105].n_chars == len(rows[105].text)
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) > 0 for r in rows.values())


def test_rows_of_the_stages_keep_their_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    for name in ("documents", "labels", "benchmark"):
        (empty if name == "documents" else spark.createDataFrame([], "doc_id long, quality int, toxic int" if name == "labels" else "item_id long, text string")).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    last = corpus_pipeline.tokens(spark, empty, str(tmp_path))
    assert last.columns == [*empty.columns, "token_ids", "n_tokens", "round_trip"] and last.count() == 0


def test_repeated_rows_and_a_very_long_text(spark, tmp_path):
    import random

    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("klmnopqrst") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    long_, text = say(220_000), say(90)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, long_), (2, long_ + " tail"), (3, text), (3, text), (4, say(80))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, say(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 3, 4] and all(r.round_trip and r.n_tokens > 0 for r in got)
    assert next(r.text for r in got if r.doc_id == 1) == long_


def test_null_ids_and_clashing_columns(spark, tmp_path):
    item = " ".join(f"word{i}" for i in range(40))
    passage = " ".join(f"line{i}" for i in range(60))
    rows = [(None, f"some text\n{item}\nmore", 1, 2), (4, "other text", 1, 2), (5, f"a\n{passage}", 1, 2), (6, f"b\n{passage}", 1, 2), (7, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_deleted int")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]
    lines = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    got = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == docs.columns and len(got) == 5 and got[6].text == "b" and (got[6].n_lines, got[6].n_deleted) == (1, 2) and passage in got[5].text
