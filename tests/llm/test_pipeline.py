import corpus_pipeline
from latticework.llm import similar


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else stage(spark, docs, sf)
        assert docs.columns == columns, name
    after = docs.count()
    assert 0 < after < before
    groups = similar.similar_groups(docs).where("doc_id <> component_id").count()
    assert groups == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == after


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "packing"]


def odd_rows(spark):
    """Null ids and texts, repeated ids and rows, long texts, and columns with the names that the stages use themselves."""
    import random

    from .conftest import words

    rng = random.Random(31)
    line = "a line that many documents have in common"
    texts = [" ".join(rng.choice(["the cat", "and the dog", "sat on a mat", "in the sun"]) for _ in range(30)) + f"\n{line}\n" + words(rng, 30, 10**6) for _ in range(40)]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    rows += [(None, texts[0] + " more", "en"), (None, None, None), (3, None, "en"), (3, "", "en"), (3, texts[5], "en"), (7, texts[7], "en"), (7, texts[7], "en"), (50, "12 34", "en"), (51, "word " * 60_000, "en")]
    names = ["row", "rep", "digest", "keys", "found", "unnamed", "id", "v1", "twin", "done", "set", "_found", "_drop_id", "t1", "held"]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars", *[f"'{n}' AS {n}" for n in names])
    return frame


def test_stages_on_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = odd_rows(spark)
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).collect() == [], name
        docs = stage(spark, docs, sf).checkpoint()
        assert docs.columns == columns, name
        assert docs.where("row <> 'row' OR held <> 'held'").count() == 0, name
        counts.append(docs.count())
    before = odd_rows(spark).count()
    assert before >= counts[0] >= counts[1] > counts[2] >= counts[3] > 0
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(kept) == len(set(kept)) and (7 in [i for i, _ in kept])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(p.length for p in pieces if p.start == 0) > 0 and len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).collect() == []


def test_the_pipeline_is_its_stages(spark):
    """run() against the stages applied by hand, each to what the one before wrote."""
    sf = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, sf).checkpoint()
    got = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    by_doc = lambda rows: {d: sum(n for i, _, n, _ in rows if i == d) for d in {r[0] for r in rows}}
    assert by_doc(key(got)) == by_doc(key(want))
