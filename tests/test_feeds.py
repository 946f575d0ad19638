import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxloom.functions.bitmaps import is_set, numbers, united, word_of, words
from fluxloom.functions.messages import position_digits
from fluxloom.manifest import Manifest
from fluxloom.operators import change_apply, exactly_once, table_diff
from fluxloom.storage import file_system, materialize, scratch_path


def test_bitmap_words(spark):
    xs = (-40000, -1, 0, 7, 63, 64, 32768, 9999999999)
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    bits = words(df.where("x <> 7"), [], F.col("x"))
    assert sorted(x for r in bits.select(numbers(F.col("word"), F.col("bits"))).collect() for x in r[0]) == sorted(set(xs) - {7})
    hit = df.join(bits, word_of(F.col("x")) == bits["word"], "left").select("x", is_set(F.col("bits"), F.col("x")).alias("h"))
    assert {r.x: r.h for r in hit.collect()} == {x: x != 7 for x in xs}
    assert rows(united(bits.unionByName(bits), [])) == rows(bits.select("word", "bits"))


def test_positions_compare_by_number(spark):
    got = spark.createDataFrame([(" w007",), ("W7 ",), ("w0",), ("x1",), ("w",), (None,), ("w" + "9" * 30,)], "t string").select(position_digits(F.col("t"))).collect()
    assert [r[0] for r in got] == ["7", "7", "0", None, None, None, "9" * 30]


def encoded(spark, data):
    df = spark.createDataFrame(data, "ns string, k long, a long, n0 string, bit long")  # two columns with names the operator uses
    return exactly_once.encode(df, [F.col("ns")], F.col("k"), F.col("a"))


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "-", None]), st.integers(-3, 3) | st.just(40000) | st.none()), max_size=30), st.integers(1, 3))
def test_first_of_each_identifier_is_kept_over_any_batches(spark, keys, n):
    data = [(ns, k, i, "x", i) for i, (ns, k) in enumerate(keys)]
    df, parts = exactly_once.arrival_batches(encoded(spark, data), n)
    kept = exactly_once.first_deliveries(parts, spark)
    want, seen = [], set()
    for ns, k, i, *_ in data:
        if k is not None and (ns, k) not in seen:
            seen.add((ns, k))
            want.append(i)
    assert sorted(r.arrival for r in kept.collect()) == want
    assert sorted(r.arrival for r in exactly_once.surplus(df, kept).collect()) == [i for ns, k, i, *_ in data if k is not None and i not in want]


def test_a_batch_is_committed_with_its_winners_and_done_once(spark, monkeypatch):
    seen = exactly_once.SeenBits(spark, scratch_path(spark, "seen-test"))
    first = encoded(spark, [("a", 1, 0, "", 0), ("a", 1, 1, "", 0), ("a", 2, 2, "", 0)])
    commit = Manifest.commit

    def stop(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(Manifest, "commit", stop)  # everything is written, nothing visible
    with pytest.raises(RuntimeError):
        exactly_once.take_unseen(first, seen, "one")
    monkeypatch.setattr(Manifest, "commit", commit)
    for _ in range(2):  # the second time it is a replay after the commit
        assert sorted(r.arrival for r in exactly_once.take_unseen(first, exactly_once.SeenBits(spark, seen.path), "one").collect()) == [0, 2]
    again = exactly_once.take_unseen(encoded(spark, [("a", 1, 3, "", 0), ("a", 3, 4, "", 0), ("b", 1, 5, "", 0)]), seen, "two")
    assert sorted(r.arrival for r in again.collect()) == [4, 5] and seen.version() == 2


def test_of_two_writers_one_fails_and_old_parts_go(spark):
    path = scratch_path(spark, "manifest-test")
    a, b = Manifest(spark, path), Manifest(spark, path)
    held, state = a.load()
    a.commit(held, {**state, "who": "a"})
    with pytest.raises(RuntimeError):
        b.commit(held, {**state, "who": "b"})
    spark.range(1).write.parquet(f"{path}/old")
    fs, at = file_system(spark, f"{path}/old")
    for n in range(1, 12):
        held, state = a.load()
        assert (held, state["who"], fs.exists(at)) == (n, "a", n < 11)
        a.commit(held, state, ["old"] if n == 2 else [])


def test_only_touched_shards_are_written_and_sparse_identifiers_stay_small(spark):
    seen = exactly_once.SeenBits(spark, scratch_path(spark, "seen-test"), 4)
    exactly_once.take_unseen(encoded(spark, [("a", i * 10**6, i, "", 0) for i in range(2000)]), seen)
    before = seen.manifest.load()[1]["shards"]
    fs, at = file_system(spark, seen.path)
    size = sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(at) if s.getPath().getName().startswith("bits-"))
    assert size < 40 * 2000  # far apart, each has a word of its own
    exactly_once.take_unseen(encoded(spark, [("a", 5, 5000, "", 0)]), seen)
    after = seen.manifest.load()[1]["shards"]
    assert len(before) == 4 and sum(before[s] != after[s] for s in before) == 1


def test_one_identifier_with_most_rows(spark):
    df = exactly_once.encode(spark.range(200_000).select(F.lit("s").alias("ns"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("a")), [F.col("ns")], F.col("k"), F.col("a"))
    kept = exactly_once.first_deliveries([df], spark)
    assert kept.count() == 66_668 and kept.where("arrival = 1").count() == 1


def changes(spark, data):
    return spark.createDataFrame(data, "k string, id long, pos long, alive boolean, v string, _slot int")


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", None]), st.integers(0, 3), st.booleans()), max_size=24), st.integers(1, 3), st.randoms(use_true_random=False))
def test_delete_vectors_rebuild_the_last_state_from_changes_in_any_order(spark, log, n, chance):
    data = [(k, i, p, alive, f"v{p}", 0) for p, (k, i, alive) in enumerate(log)]
    want = {}
    for k, i, p, alive, v, _ in data:
        want.pop((k, i), None)
        if alive:
            want[k, i] = (p, v)
    data = data + data[::2]  # half is delivered twice
    chance.shuffle(data)
    t = change_apply.DeltaTable(spark, ["k", "id"], "pos", ["v"])
    size = -(-len(data) // n) or 1
    for b in range(n):
        t.apply(changes(spark, data[b * size : (b + 1) * size]))
    assert {(r.k, r.id): (r.pos, r.v) for r in t.read().collect()} == want


def test_a_late_change_neither_overwrites_nor_revives(spark):
    t = change_apply.DeltaTable(spark, ["k", "id"], "pos", ["v"])
    for p, alive in ((1, True), (9, True), (5, True)):
        t.apply(changes(spark, [("a", 1, p, alive, f"v{p}", 0)]), f"first-{p}")
    for p, alive in ((1, True), (9, False), (5, True)):
        t.apply(changes(spark, [("a", 2, p, alive, f"v{p}", 0)]), f"second-{p}")
    t.apply(changes(spark, [("a", 1, 99, True, "replayed name", 0)]), "first-5")
    t.apply(changes(spark, [("a", 3, None, True, "no order", 0)]))
    assert rows(t.read()) == [("a", 1, 9, "v9"), ("a", 3, None, "no order")]


def test_a_batch_reads_and_writes_the_buckets_it_touches(spark):
    t = change_apply.DeltaTable(spark, ["k", "id"], "pos", ["v"], buckets=8)
    t.apply(changes(spark, [("a", i, 1, True, "v", 0) for i in range(500)]))
    before = t.manifest.load()[1]["buckets"]
    for p in range(2, 13):  # vectors are merged and old parts removed on the way
        t.apply(changes(spark, [("a", 7, p, True, f"v{p}", 0)]))
    after = t.manifest.load()[1]["buckets"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert t.read().count() == 500 and rows(t.read().where("id = 7")) == [("a", 7, 12, "v12")]


def test_nothing_applied_is_an_error_and_empty_batches_are_fine(spark):
    t = change_apply.DeltaTable(spark, ["k", "id"], "pos", ["v"])
    with pytest.raises(ValueError):
        t.read()
    t.apply(changes(spark, []))
    assert rows(t.read()) == []
    t.apply(changes(spark, [("a", 1, 1, True, "x", 0)])).apply(changes(spark, []))
    assert rows(t.read()) == [("a", 1, 1, "x")]


def test_the_nth_row_of_each_ring(spark):
    ring = spark.createDataFrame([("c", p) for p in (99999, 5, 40001, 40000)] + [("d", 1)], "c string, p long")
    ring = materialize(change_apply.numbered(ring, ["c", "p"]), "ring")
    place = {(r.c, r.p): r._i for r in ring.collect()}
    assert [x for _, x in sorted((i, x) for x, i in place.items())] == [("c", 5), ("c", 40000), ("c", 40001), ("c", 99999), ("d", 1)]
    wanted = spark.createDataFrame([("p", "c", 0), ("q", "c", 1), ("r", "c", 3), ("s", "c", 4), ("t", "c", 5), ("u", "d", 1), ("v", "e", 1), ("w", "c", None)], "p string, c string, n long")
    got = {r.p: r.cutoff for r in change_apply.nth_number(ring, wanted, ["c"], "n").collect()}
    top = (1 << 63) - 1
    assert got == {"p": -1, "q": place["c", 5], "r": place["c", 40001], "s": place["c", 99999], "t": top, "u": place["d", 1], "v": top, "w": -1}


def test_differences_field_by_field(spark):
    s = spark.createDataFrame([(1, "a ", "1.50", 1), (1, "old", "9", 0), (2, None, "", 1), (3, "x", "2E0", 1), (4, "ü", "1", 1), (6, "n", "abc", 1), (7, "", "-0.0", 1), (8, "z", "1", None), (8, "y", "1", 5)], "id long, name string, n string, at long")
    t = spark.createDataFrame([(" 1", "a", " +1.5", 1), ("02", "", None, 1), ("3", "X", "3", 1), ("5", "q", "1", 1), ("4", "ü", "1.0000", 1), ("6", "n", "abd", 1), ("7", None, "0", 1), ("8", "y", "10E-1", 1), (None, "lost", "1", 1), ("x", "lost", "1", 1)], "id string, name string, n string, at long")
    f = {"name": table_diff.text_value(F.col("name")), "n": table_diff.number_text(F.col("n"))}
    side = lambda d: table_diff.latest(d, table_diff.key_number(F.col("id")), F.col("at"), f)
    assert rows(table_diff.differences(side(s), side(t), ["name", "n"])) == sorted([
        (2, "differs", "name"), (3, "differs", "name"), (3, "differs", "n"), (4, "differs", "name"), (5, "missing_in_source", "row"), (6, "differs", "n"), (7, "differs", "name"),
    ], key=str)
    none = side(s.limit(0))
    assert rows(table_diff.differences(none, side(t.limit(0)), ["name", "n"])) == []
    assert {r.diff_kind for r in table_diff.differences(side(s), none, ["name", "n"]).collect()} == {"missing_in_target"}


def test_numbers_of_any_length_are_told_apart(spark):
    same = [["1.5", " +1.50", "15e-1", ".15E1", "0001.5000000000000000", "1500e-3"], ["0", "-0", "0.000", ".0", "0e5", "-0.0000000000000000"], ["100", "1e2", "1E+2", "100.", "0.0000000000001e15"], ["-0.001", "-1e-3", "-.001"], ["0.0000000000001", "1e-13"]]
    apart = ["1.0000000000001", "1.0000000000002", "9" * 60, "9" * 59 + "8", "1e500", "1e-500", "1e501", "abc", "1 2", "1,5", "--1", ".", "1e"]
    df = spark.createDataFrame([(i, x) for i, xs in enumerate(same) for x in xs] + [(100 + i, x) for i, x in enumerate(apart)] + [(-1, ""), (-1, "  "), (-1, None)], "g int, x string")
    got = df.select("g", table_diff.number_text(F.col("x")).alias("t")).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, set()).add(r.t)
    assert by.pop(-1) == {None} and all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    assert by[0] == {"1.5"} and by[2] == {"100"} and by[4] == {"0.0000000000001"}
    keys = spark.createDataFrame([("7",), ("007.0",), ("7e0",), ("7.5",), ("x",), ("x",), (None,), ("9" * 30,)], "id string")
    assert [r[0] for r in keys.select(table_diff.key_number(F.col("id"))).collect()] == [7, 7, 7, None, None, None, None, None]
    assert rows(table_diff.unkeyed(keys, F.col("id"))) == sorted([(None, 1), ("7.5", 1), ("9" * 30, 1), ("x", 2)], key=lambda t: (t[0] is not None, str(t[0])))


@pytest.mark.parametrize("most", [0, 100])
def test_hot_joins_agree_whichever_way_they_go(spark, most):
    from fluxloom.operators.skew import join_hot

    left, right = spark.range(1000).selectExpr("if(id % 3 = 0, 0L, id) k", "id v"), spark.createDataFrame([(0, "a"), (0, "b"), (7, "c")], "k bigint, w string")
    got = join_hot(left, right, ["k"], F.col("v"), 4, most)
    assert got.count() == 334 * 2 + 1 and got.columns == ["k", "v", "w"]


def test_rows_without_an_identifier_come_out(spark, tmp_path):
    from fluxloom.queries import feeds

    log = [(1, "c", "s", "u", "w1", 1), (2, "c", "S ", "u", " W01", 1), (3, "c", "s", "u", "lost", 1), (4, "c", "s", "u", "lost", 1), (5, "c", "s", "r", None, 7), (6, "c", "s", "R", None, 7), (7, "c", "s", "r", None, None)]
    spark.createDataFrame([(*x[:5], (x[5],)) for x in log], "delivery_id long, chain_id string, src string, op string, src_pos string, after_row struct<id:long>").write.parquet(f"{tmp_path}/change_log.parquet")
    spark.createDataFrame([(1, "p", None), (2, "p", None), (3, "p", "w5"), (4, "p", "w5")], "offset_id long, pipeline_id string, sink_acked_srcpos string").write.parquet(f"{tmp_path}/consumer_offset.parquet")
    kept, found = rows(feeds.p1_kept(spark, str(tmp_path))), rows(feeds.p1_found(spark, str(tmp_path)))
    assert kept == [("change_log", i) for i in (1, 3, 4, 5, 7)] + [("consumer_offset", i) for i in (1, 2, 3)]
    assert found == [("change_log", 2), ("change_log", 6), ("consumer_offset", 4)]
