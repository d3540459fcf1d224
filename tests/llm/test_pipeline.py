import brute
import corpus_pipeline
import test_decontaminate
import test_line_dedup
import test_quality
from simloom.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_against_models(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns and ids(kept) == ids(quality.judged(docs).where("kept"))
    for r in docs.collect():
        n, _, _, _, rep = test_quality.model(r.text)
        assert not (n < 50 or 100 * rep > 50 * n) or r.doc_id not in ids(kept) if r.doc_id % 37 == 0 else True

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    lined = corpus_pipeline.dedup_lines(spark, kept, SF)
    assert lined.columns == docs.columns
    gone = {d for d, n, removed, _, _ in test_line_dedup.model(rows) if n and n == removed}
    assert ids(lined) == sorted(d for d, _ in rows if d not in gone)

    rows = [(r.doc_id, r.text) for r in lined.collect()]
    single = corpus_pipeline.near_dedup(spark, lined, SF)
    assert ids(single) == sorted(d for d, (_, c) in brute.near_duplicates(rows, 5, 80, 100).items() if d == c)

    rows = [(r.doc_id, r.text) for r in single.collect()]
    clean = corpus_pipeline.decontaminated(spark, single, SF)
    assert clean.columns == docs.columns
    assert ids(clean) == sorted(d for d, bad, _, _ in test_decontaminate.model(rows, bench) if not bad)
    assert ids(corpus_pipeline.tokenized(spark, clean, SF)) == ids(clean)


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules"
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_odd_rows_pass_every_stage(spark, tmp_path):
    words = lambda n, k=0: " ".join(f"word{i + k}" for i in range(n))
    rows = [(1, None, 0), (2, "", 0), (3, words(80), 1), (3, words(80), 1), (4, words(80), 2), (None, words(80, 500), 3), (None, words(80, 500), 4), (5, words(60_000, 9000), 5), (6, "  \n\t ", 6)]
    schema = "doc_id long, text string, n_chars long, `a.b` int, row int, items int, kept boolean, key string, runs int"
    df = spark.createDataFrame([(d, t, 0, n, n, n, True, "k", n) for d, t, n in rows], schema)
    spark.createDataFrame([(1, words(90, 500))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = df, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        left.append(sorted(map(str, (r.doc_id for r in docs.select("doc_id").collect()))))
        if name != "bpe":
            assert docs.columns == df.columns, name
    assert left[0] == ["3", "3", "4", "5", "None", "None"] and left[1] == ["3", "3", "5", "None", "None"]  # 4 is one long line that 3 has
    assert left[2] == left[1] and left[3] == left[4] == ["3", "3", "5"]  # 80 of the 90 words of the item
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
