import collections
import random

from pvlens.llm.common import join_dealt
from pvlens.llm.line_dedup import align, dedup_lines

SCHEMA = "doc_id long, text string"
X, Y, Z = ("the first long line of the block", "the second long line of the block", "a third long line, held once elsewhere")


def kept(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r.doc_id: r.kept_text for r in dedup_lines(docs, **options).collect()}


def test_copy_of_lines_first_held_in_another_order(spark):
    texts = [f"{Y}\n{Z}\n{X}", f"{X}\n{Y}", f"{X}\n{Y}", f"{Y}\n{X}\nown words of the last document"]
    got = kept(spark, texts)
    assert got[2] == ""
    assert got[3] == "own words of the last document"


def test_no_holder_is_left_out(spark):
    # Forty holders have the lines the other way round; only the one before last has them in order.
    texts = [f"{Y}\nnumber {i} of the documents between\n{X}" for i in range(40)] + [f"{X}\n{Y}", f"{X}\n{Y}"]
    assert kept(spark, texts)[41] == ""


def test_short_lines(spark):
    verse = "O sea\nO sky\nO sun"
    got = kept(spark, [verse, verse, "mine\n" + verse + "\nyours", "O sky"], rare_docs=10)
    assert (got[1], got[2], got[3]) == ("", "mine\nyours", "")
    # Held by many documents: stays alone, goes inside a block, whatever else the block is of.
    texts = ["yes\nno", *(f"yes\ndocument number {i} says something" for i in range(12)), "first\nno\nyes\nlast", "mine\nno\nyes", f"yes\n{X}", f"{X}", f"yes\n{X}"]
    got = kept(spark, texts, rare_docs=3)
    assert got[5] == texts[5]
    assert got[14] == "mine" and got[17] == ""
    assert kept(spark, ["yes"] * 5, rare_docs=3)[4] == ""


def brute(texts, min_chars, rare_docs):
    lines = [[x for x in (t or "").split("\n") if x.strip()] for t in texts]
    held = collections.Counter()
    for own in lines:
        seen = collections.Counter()
        for x in own:
            held[x, seen[x]] += 1
            seen[x] += 1
    view = lambda own: {"marks": [h for x in own for h in (hash(x), 0)], "tails": [0] * len(own), "head": 0}
    out = {}
    for i, own in enumerate(lines):
        seen, firm = collections.Counter(), set()
        for o, x in enumerate(own):
            if len(x.strip()) >= min_chars or held[x, seen[x]] <= rare_docs or (len(own) == 1 and own in lines[:i]):
                firm.add(o)
            seen[x] += 1
        gone = {c >> 3 for j in range(i) for c in align(view(own), view(lines[j]), firm, 1)}
        out[i] = "\n".join(x for o, x in enumerate(own) if o not in gone)
    return out


def test_same_as_aligning_with_every_earlier_document(spark):
    rng = random.Random(11)
    pool = [f"long line number {i} of the pool" for i in range(14)] + [f"s{i}" for i in range(10)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    assert kept(spark, texts, rare_docs=6) == brute(texts, 20, 6)


def test_hot_partner_is_dealt_over_copies(spark):
    # Key 0 holds half of the rows, key 9 has no wide row, key 8 has no row.
    rows = spark.createDataFrame([(0 if i % 2 else i % 10, i) for i in range(400)], "key long, own long")
    wide = spark.createDataFrame([(k, [k] * 3) for k in range(9)], "key long, lines array<long>")
    plain = sorted(map(tuple, rows.join(wide, "key").select("key", "own", "lines").collect()))
    for most in (1, 7, 4096):
        assert sorted(map(tuple, join_dealt(rows, wide, ["key"], most).select("key", "own", "lines").collect())) == plain
    assert join_dealt(rows.limit(0), wide, ["key"]).count() == 0


def test_footer_of_all_documents(spark):
    footer = "all rights reserved by the company that wrote this page"
    texts = [f"document {i} has a line of its own here\n{footer}" for i in range(300)]
    got = kept(spark, texts)
    assert got[0] == texts[0] and all(got[i] == texts[i].split("\n")[0] for i in range(1, 300))
