"""The filter audit against every order applied step by step, and on odd rows."""

import re
from collections import Counter
from itertools import permutations

from pvlens.llm import filter_audit
from pvlens.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, text string, lang string, mask string, part int, good int"


def step_by_step(rows, labels):
    """rows: (doc_id, text, lang)."""
    good = {r[0] for r in labels if r[0] is not None and r[1] == 1}
    toxic = {r[0] for r in labels if r[0] is not None and r[2] == 1}
    docs = []
    for i, (doc_id, text, lang) in enumerate(rows):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any((x or "") == t and j != i and o is not None and (doc_id is None or o < doc_id) for j, (o, x, _) in enumerate(rows)),
        }
        docs.append((lang or "", fails, doc_id in good, doc_id in toxic))
    out, totals = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = own = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                bad = sum(d[1][f] for d in own)
                out[part, "".join(order), step] = [len(left), len(gone), bad - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), 0]
                totals[part, f] += len(gone)
    for (part, order, step), row in out.items():
        row[-1] = totals[part, order[step - 1]]
    return {k: tuple(v) for k, v in out.items()}


def as_dict(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_every_order_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", " \n", long, long, long + " #", long.upper(), "a " * 150, "a " * 150 + "$", "É" * 30, "AB" + "x" * 18, "AB" + "x" * 17, "# x", "\x1c" + long, "w" * 100_000]
    rows = [(i, t, ("en", "fr", None, "")[i % 4], "clash", 1, 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (3, long, "fr", "", 1, 1), (None, long, "en", "", 1, 1), (None, "only here", "en", "", 1, 1), (None, "only here", "en", "", 1, 1), (7, long, "en", "", 1, 1), (7, "another text", "de", "", 1, 1), (-5, "", "es", "", 1, 1)]
    labels = [(0, 1, 0), (3, 1, 1), (4, 0, 1), (7, None, 1), (7, 1, None), (9, 1, 0), (None, 1, 1), (12345, 1, 1), (8, 1, 1)]
    docs, said = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = as_dict(filter_audit.filter_audit(docs, said))
    assert got == step_by_step([r[:3] for r in rows], labels)
    assert len(got) == 600 * 5 and len(got) == filter_audit.filter_audit(docs, said).count()
    assert filter_audit.filter_audit(docs.limit(0), said).count() == 0
    assert {v[4:6] for v in as_dict(filter_audit.filter_audit(docs, said.limit(0))).values()} == {(0, 0)}


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    assert as_dict(queries()["op11_filter_audit"](spark, d)) == step_by_step(rows, labels)


def test_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    names = queries()["op11_filter_audit"](spark, d).columns
    want = con.execute(oracle_sql()["op11_filter_audit"]).df()
    assert list(want.columns) == names
    assert as_dict(queries()["op11_filter_audit"](spark, d)) == {(r[0], r[1], r[2]): tuple(r[3:]) for r in want.itertuples(index=False)}
