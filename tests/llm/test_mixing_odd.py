"""Mixing of sources without words, of a table without words, and kept columns of clashing names."""

from pvlens.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target string, _order int, taken int"


def test_source_without_words(spark):
    rows = [(1, "a b c", "x", 1, "t", 1, 1), (2, "d e", "x", 2, "u", 2, 2), (3, None, "y", 3, "v", 3, 3), (4, " \n", "y", 4, "w", 4, 4), (None, "f", None, 5, None, 5, 5), (None, "f", None, 5, None, 5, 5), (None, None, None, 5, None, 5, 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.curriculum(docs, keep=("size", "target", "_order", "taken")).collect()
    assert len(got) == len(rows)
    by = {r._order: r for r in got if r._order < 5}
    assert [by[k].size_kept for k in (1, 2, 3, 4)] == [1, 2, 3, 4] and [by[k].target_kept for k in (1, 2, 3, 4)] == ["t", "u", "v", "w"] and by[3].taken_kept == 3
    for r in got:
        if r.source == "y":
            assert (r.size, r.source_size, r.target, r.taken, r.takes) == (0, 0, 0.0, 0, [])
    assert sum(r.taken for r in got if r.source == "x") == round(by[1].target)
    uses = mixing.schedule(mixing.curriculum(docs)).collect()
    assert uses and all(r.words > 0 and 0 <= r.position <= 1 for r in uses)


def test_table_without_words(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "\t", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.curriculum(docs).collect()) == [(i, 0, 0.0, 0) for i in (1, 2, 3)]
    assert mixing.schedule(mixing.curriculum(docs)).count() == 0


def test_pipeline_stage(spark):
    import corpus_pipeline

    rows = [(1, "a b c", "en", "x", 5), (2, None, "en", "y", 0), (3, "", "en", "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect()} == {1}
    assert corpus_pipeline.mix_sources(spark, docs.where("doc_id > 1"), "").count() == 0
