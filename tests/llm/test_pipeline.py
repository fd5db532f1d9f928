import corpus_pipeline
from basalt.llm import language, links, packing, toxicity
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        by[name] = (docs, out)
        docs = out
    rows = [(r["doc_id"], r["text"]) for r in by["near_duplicates"][0].collect()]
    want = {i for i, (_, c) in brute(rows, 5).items() if i == c}
    assert {r["doc_id"] for r in by["near_duplicates"][1].collect()} == want
    before, after = by["toxicity"]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(toxicity.fit(before, toxicity.learnable(spark.read.parquet(f"{SF}/labels.parquet")))).collect()}
    assert {r["doc_id"] for r in after.collect()} == {i for i, s in scores.items() if s < 0.5}
    before, after = by["language_id"]
    model = language.fit(language.train_rows(before))
    told = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language.predict(before, model).collect()}
    assert {r["doc_id"] for r in after.collect()} == {i for i, (lang, score) in told.items() if lang != "und" and score > language.NOISE}
    assert len(after.collect()) >= 0.99 * len(told)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_duplicates", "packing"]


def test_run(spark):
    import public_tokenizers

    out = corpus_pipeline.run(spark, SF)
    got = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert got and all(r["sum(length)"] == r["max(doc_tokens)"] for r in got)
    ids = {r["doc_id"] for r in got}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words = packing.Words(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(r["max(doc_tokens)"] == len(words.encode([texts[r["doc_id"]]])[0]) + 1 for r in got) and ids < set(texts)


def test_null_and_repeated_rows(spark):
    rows = [(None, "some words of a text here", "en", "s", 1), (None, "other words of a text", "en", "s", 1), (1, None, "en", "s", 0), (2, "a b c d e f g", None, "s", 1), (2, "a b c d e f g", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert sorted((r["doc_id"] or 0, r["text"][:5]) for r in docs.collect()) == [(0, "other"), (0, "some "), (2, "a b c")]


def test_empty_table_and_clashing_columns(spark):
    """Further columns that the operators use themselves pass through; an empty table stays empty."""
    rows = [(i, f"words number {i} of a plain text that goes on " * 3, "en", "s", 1, 0.5, "x", 7, [1]) for i in range(1, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, toxic_score double, lang_pred string, id int, ids array<int>")
    out = none = docs
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, none = stage(spark, out, SF), stage(spark, none, SF)
        assert set(out.columns) <= set(docs.columns) and {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns)
    assert out.count() == 29 and none.count() == 0
    assert corpus_pipeline.pack_windows(spark, out, SF).select("doc_id").distinct().count() == 29
    assert corpus_pipeline.pack_windows(spark, none, SF).count() == 0


def test_components(spark):
    e = [(1, 2), (2, 3), (3, 1), (10, 11), (20, 20), (None, 5)] + [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1100)]
    got = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, **{i: 100 for i in range(100, 161)}, **{i: 1000 for i in range(1000, 1100)}}
