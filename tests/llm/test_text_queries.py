"""The text queries over whole tables of the smallest scale, against what is found without their operators."""

import os

import pytest

queries = pytest.importorskip("fluxloom.llm.queries")
normal = pytest.importorskip("fluxloom.llm.normal")
quotes = pytest.importorskip("fluxloom.llm.quotes")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    import duckdb

    return duckdb.connect()


def table(con, name, columns):
    return con.execute(f"select {columns} from '{SF}/{name}.parquet'").fetchall()


def test_containers(spark, con):
    fill = {r.target_name: r for r in queries.p6_fill(spark, SF).collect()}
    assert set(fill) == {n for (n,) in table(con, "pack_target", "target_name")}
    assert len({r.tokens for r in fill.values()}) == 1  # the same texts everywhere
    assert all(r.fullest <= c for n, c in table(con, "pack_target", "target_name, capacity_tokens") for r in [fill[n]])
    held = queries.p6_packed(spark, SF).select("doc_id", "target_name").distinct().count()
    assert held == len(fill) * sum(t is not None for (t,) in table(con, "documents", "text"))


def test_leaks_are_those_of_brute_force(spark, con):
    docs = [(k, normal.words(t)) for k, t in table(con, "documents", "doc_id, text") if t]
    items = [(k, normal.words(t)) for k, t in table(con, "eval_item", "item_id, text") if t]
    codes = {}
    number = lambda ws: [codes.setdefault(w, len(codes)) for w in ws]
    docs, items = [(k, number(w)) for k, w in docs], [(k, number(w)) for k, w in items]
    want = {(d, i) for d, x in docs for i, q in items if len(set(x) & set(q)) >= 8 and quotes.longest_quote(q, x, 15, 0.8, 1.5) > 0}
    got = queries.p7_found(spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    per = {r.item_id: r for r in queries.p7_items(spark, SF).collect()}
    assert {i: r.documents for i, r in per.items()} == {i: sum(j == i for _, j in want) for _, i in want}
    assert all(r.verbatim <= r.documents and r.with_answer <= r.documents for r in per.values())


def test_subjects_agree_with_hand_labels(spark, con):
    folder = "/root/testdata/sf0.01"  # the smallest scale has nine labels
    rows = lambda name, columns: con.execute(f"select {columns} from '{folder}/{name}.parquet'").fetchall()
    listed = {s for (s,) in rows("subject_area", "subject")}
    known = {k for (k,) in rows("documents", "doc_id")}
    got = {(r.doc_id, r.subject) for r in queries.p8_found(spark, folder).collect()}
    assert got and all(k in known and s in listed for k, s in got)
    labels = set(rows("subject_label", "doc_id, subject"))
    assert len(got & labels) >= 0.8 * len(labels)
    mix = {r.subject: r.documents for r in queries.p8_mix(spark, folder).collect()}
    assert mix == {s: sum(t == s for _, t in got) for _, s in got}
