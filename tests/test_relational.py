import random

from conftest import rows
from pyspark.sql import functions as F

from fluxloom.operators.asof import asof_join


def test_asof_join_agrees_with_brute_force_whatever_the_slices(spark):
    rnd = random.Random(4)
    time = lambda: rnd.choice([None, *range(40)])
    left = [(i, rnd.choice(["a", "hot", "hot", None]), time(), 1) for i in range(120)]
    right = [(i, rnd.choice(["a", "hot", "hot", None]), time(), rnd.choice([1, None])) for i in range(60)]
    want = []
    for i, k, t, _ in left:
        able = [(rt, ri) for ri, rk, rt, _ in right if k is not None and rk == k and t is not None and rt is not None and rt <= t]
        want.append((i, max(able)[1] if able else None))
    d = "id int, k string, t int, matched int"
    l_, r_ = spark.createDataFrame(left, d).drop("matched"), spark.createDataFrame(right, d)
    for width in (1, 7, 1000):
        out = asof_join(l_, r_, ["k"], F.col("t"), F.col("t"), F.col("id"), width)
        assert rows(out.select("id", "matched.id")) == rows(spark.createDataFrame(want, "a int, b int"))
    assert asof_join(l_, r_.limit(0), ["k"], F.col("t"), F.col("t"), F.col("id"), 7).where("matched is not null").count() == 0
    assert asof_join(l_.limit(0), r_, ["k"], F.col("t"), F.col("t"), F.col("id"), 7).count() == 0
