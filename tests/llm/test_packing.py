import random
from bisect import bisect_left, insort

import pytest
from hypothesis import given
from hypothesis import strategies as st

packing = pytest.importorskip("fluxloom.llm.packing")
tokens = pytest.importorskip("fluxloom.llm.tokens")


def naive(histogram, capacity, separator):
    """Best fit decreasing, one text at a time: remaining capacities."""
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            w = length + separator
            i = bisect_left(bins, w)
            insort(bins, (bins.pop(i) if i < len(bins) else capacity + separator) - w)
    return bins


@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.integers(0, 2), st.dictionaries(st.integers(0, c), st.integers(1, 40), max_size=12))))
def test_bulk_placement_is_best_fit_decreasing(case):
    capacity, separator, histogram = case
    if not separator:
        histogram.pop(0, None)
    runs, opened = packing.best_fit_decreasing(histogram, capacity, separator)
    bins, ranks = {}, {n: set() for n in histogram}
    for r in runs:
        for k in range(r.count):
            bins.setdefault(r.bin + k // r.each, {})[r.filled + k % r.each] = r.length
            assert r.rank + k not in ranks[r.length]
            ranks[r.length].add(r.rank + k)
    assert len(bins) == opened and all(ranks[n] == set(range(histogram[n])) for n in histogram)
    assert all(sorted(b) == list(range(len(b))) and sum(b.values()) + separator * (len(b) - 1) <= capacity for b in bins.values())
    assert sorted(capacity + separator - sum(n + separator for n in b.values()) for b in bins.values()) == naive(histogram, capacity, separator)


def test_weightless_texts_and_wrong_lengths():
    assert packing.best_fit_decreasing({0: 5}, 4, 0) == ([packing.Run(0, 0, 5, 0, 5, 0)], 1)
    assert packing.best_fit_decreasing({}, 4, 1) == ([], 0)
    with pytest.raises(ValueError):
        packing.best_fit_decreasing({5: 1}, 4, 0)


def test_texts_into_containers(spark, monkeypatch):
    monkeypatch.setattr(packing, "_PER_TASK", 7)  # several sub-keys for one length
    rnd = random.Random(1)
    texts = [(i % 50 if i % 9 else None, " ".join(["word"] * rnd.randint(0, 30)), i) for i in range(120)] + [(1, None, 0), (2, "", 0), (777, "x y " * 500, 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, container int")
    targets = spark.createDataFrame([("a", 16, 1), ("b", 100, 2), ("zero", 0, 1)], "target_name string, capacity_tokens int, separator_tokens int")
    out = packing.pack(docs, targets).toPandas()
    counts = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(docs.where("doc_id = 777"), "doc_id", "text").collect()}
    for name, capacity, sep in (("a", 16, 1), ("b", 100, 2)):
        t = out[out.target_name == name]
        size = t.token_to - t.token_from
        used = size.groupby(t.container).sum() + sep * (t.groupby("container").size() - 1)
        assert used.max() <= capacity and (t.groupby("container").place.nunique() == t.groupby("container").size()).all()
        assert size.sum() == sum(r.n_tokens for r in tokens.with_token_counts(docs, "doc_id", "text").collect())
        long = t[t.doc_id == 777].sort_values("token_from")
        assert long.token_from.tolist() == [capacity * i for i in range(len(long))] and long.token_to.max() == counts[777]
        assert (t.token_from == 0).sum() == 122  # every text begins once; the null one has no row
    assert packing.pack(docs.limit(0), targets).count() == 0 and packing.pack(docs, targets.limit(0)).count() == 0
