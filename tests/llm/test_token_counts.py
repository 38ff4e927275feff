"""Token counts against the tokenizers library, on odd texts and odd rows."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pvlens.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "\n", "a b", "a  b", " a", "a ", "a \n b", "a\n\n b", "a\n b\n", "it's  we'll 'tis '", " 's", "a b", "a　 b", "x  y", "\x1c a \x1cb !\x1c", "end.  Next  one.\n\n  Indented\t\tTabs \t mixed",
    "<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endof text|>", "éü \U0001f600 中文字", "1234567 12a34 ١٢", "don't DON'T 'Ll", "----- ===== ***", "\x00\x7f", "a\r\nb\r\n  c",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(*token_counts.prove(PATH))


def random_texts(n, longest, seed=3):
    rng = random.Random(seed)
    alphabet = list("abcdefgehiotn  \n\t.,'s-1239") + ["the", " and", "'re", "é", " ", "中", "\U0001f600", "  ", "<|endoftext|>", "\x85", " ", "\x1f"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_counts_equal_the_library(counter, library):
    texts = ODD + random_texts(3000, 60)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t)[0] for t in texts] == want


def test_long_words_and_windows(counter, library, monkeypatch):
    rng = random.Random(9)
    texts = ["a" * 5000, "".join(rng.choice("abcdefghij") for _ in range(20_000)), "中文" * 3000, "x.y" * 5000, "ab1" * 4000 + "\n" * 3000 + " z", " " * 4000 + "q"]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t)[0] for t in texts] == want
    monkeypatch.setattr(token_counts, "WINDOW", 512)  # many windows a text
    texts += [" ".join(random_texts(200, 40, seed)) for seed in range(5)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t)[0] for t in texts] == want


def test_proof_holds_for_the_library(counter, library):
    names = library.get_vocab()
    assert 40_000 < len(counter.whole) < len(names)
    for token in random.Random(1).sample(sorted(counter.whole), 2000):
        assert [t.id for t in library.model.tokenize(token)] == [names[token]]
    for token in sorted(set(names) - counter.whole):
        assert len(library.model.tokenize(token)) != 1


def test_only_the_rest_is_merged(counter):
    own = token_counts.TokenCounter(*token_counts.prove(PATH))
    merged, real = [], own.merge
    own.merge = own.memory.merge = lambda token: merged.append(token) or real(token)
    tokens, direct = own.count("the house of zzqxj and the house, zzqxj")
    assert direct == 7 and merged == ["\u0120zzqxj"] and tokens > 9


def test_odd_rows(spark):
    schema = "doc_id long, text string, n_tokens string, _text int"
    rows = [(1, None, "x", 1), (2, "", None, 2), (None, "a b", "y", 3), (3, "a b", "z", 4), (3, "a b", "z", 4), (4, "word " * 600, "w", 5)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs).collect())
    assert got == [(0, 3, 2, False), (1, 0, 0, False), (2, 0, 0, False), (3, 3, 2, False), (3, 3, 2, False), (4, 3000, 601, True)]
    assert {(r.doc_id, r._text) for r in token_counts.count_tokens(docs, keep=("_text",)).collect()} == {(r[0], r[3]) for r in rows}
    assert token_counts.count_tokens(spark.createDataFrame([], schema)).count() == 0
    assert [r.over_limit for r in token_counts.count_tokens(docs.where("doc_id = 3"), limit=1).collect()] == [True, True]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.prove(public_tokenizers.path("word_bpe_49k.json"))


def test_whole_table(spark, library):
    from pvlens.llm.queries import queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want = {i: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries()["op13_token_counts"](spark, d).collect()} == want
