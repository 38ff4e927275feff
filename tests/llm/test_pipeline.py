"""Every stage of the pipeline against a plain version of it, on odd rows and on an empty table."""

import collections
import random

import pytest
from pyspark.sql import functions as F
from test_line_dedup import brute
from test_operators import brute_roots, words

import corpus_pipeline
from pvlens.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _d int, _text string, _node string, taken string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    labels = [(i, int(i >= 60)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    clean = [words(rng, 30) for _ in range(60)]
    toxic = [words(rng, 12) + " zorgul " + words(rng, 6) + " brakk " + words(rng, 6) for _ in range(60)]
    line = "a line of some length that several documents hold"
    long = words(rng, 4000)
    odd = [None, "", " \n\t", line + "\nmine alone, number one", "number two, all its own\n" + line, long, long + " and a tail", clean[0]]
    texts = [*clean, *toxic, *odd]
    out = [(i, t, "en", f"s{i % 4}" if i % 4 else None, len(t or ""), 7, "x", "y", "z") for i, t in enumerate(texts)]
    # One id with two texts, one of them a copy; rows without ids; a row repeated whole.
    out += [(5, clean[7], "en", "s1", 1, 7, "x", "y", "z"), (None, clean[8], None, None, None, None, None, None, None), (None, clean[8], None, None, None, None, None, None, None), out[3]]
    return out


@pytest.fixture(scope="module")
def stages(spark, rows, sf_dir):
    """What each stage read, and what it gave."""
    docs, out = spark.createDataFrame(rows, SCHEMA), {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs.collect()
        # As the check does: written and read again. Names that clash stay only in the first table.
        made = stage(spark, docs, sf_dir)
        got = made.collect()
        out[name] = (given, got)
        docs = spark.createDataFrame(got, made.schema)
        assert name == "sentencepiece" or made.columns == corpus_pipeline.COLUMNS
    return out


def test_toxic_documents_go(spark, stages, rows, sf_dir):
    given, got = stages["toxicity"]
    scorer = toxicity.train(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = [r[1] for r in given if scorer.score(r[1] or "") < 0.3]
    assert collections.Counter(r.text for r in got) == collections.Counter(want)
    kept = {r.doc_id for r in got}
    assert set(range(60)) <= kept and not kept & set(range(60, 120)) and {120, 121, 122, None} <= kept


def test_lines_of_earlier_documents_go(stages):
    given, got = stages["line_dedup"]
    # Rows that repeat id and text are one document to the operator; "later" is by id, nulls first, then by hash.
    once = sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in given})
    if len({x[:2] for x in once}) == len(once) - 1:  # id 5 has two texts, neither holding the other's lines
        plain = brute([x[2] for x in once], 20, 10)
        left = {(once[i][1] if once[i][0] else None, t) for i, t in plain.items()}
    gone = {(r.doc_id, r.text) for r in got}
    strip = lambda t: "\n".join(x for x in (t or "").split("\n") if x.strip())
    assert {(i, strip(t)) for i, t in gone if strip(t)} == {(i, t) for i, t in left if t}
    assert all(r.n_chars == len(r.text) for r in got if r.doc_id == 124)


def test_one_of_each_group_stays(stages):
    given, got = stages["near_dedup"]
    classes = collections.defaultdict(set)
    for r, root in zip(given, brute_roots([(r.doc_id, r.text) for r in given])):
        classes[root].add((r.doc_id, r.text))
    assert len(got) == len(classes)
    for own in classes.values():
        least = min((x for x in own), key=lambda x: (x[0] is None, x[0] or 0))
        assert sum((r.doc_id, r.text) in own for r in got) == 1
        assert any(r.doc_id == least[0] for r in got)


def test_the_mix_hands_on_what_it_takes(spark, stages):
    from pvlens.llm.mixing import curriculum

    given, got = stages["mixing"]
    mixed = curriculum(spark.createDataFrame(given, ",".join(f"{c} {t}" for c, t in zip(corpus_pipeline.COLUMNS, ("long", "string", "string", "string", "long"))))).collect()
    size = lambda t: len((t or "").encode().split())
    assert sum(size(r.text) for r in got) == sum(r.taken for r in mixed)
    by = collections.Counter()
    for r in got:
        by[r.doc_id, r.source] += size(r.text)
    for r in mixed:
        assert r.taken == 0 or by[r.doc_id, r.source] >= r.taken
    whole = {(r.doc_id, r.text) for r in given}
    cut = [r for r in got if (r.doc_id, r.text) not in whole]
    assert all(any(t and t.startswith(r.text) for i, t in whole if i == r.doc_id) and r.n_chars == len(r.text) for r in cut)


def test_every_use_is_encoded(stages):
    given, got = stages["sentencepiece"]
    assert len(got) == len(given) and all(r.round_trip for r in got)


def test_an_empty_table_passes_all_stages(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.where(F.col("n_pieces") > 0).count() == 0
