"""Places and running sums are what a window over all rows gives."""

import random
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from spandrel.operators import order


def table(spark, n=4000):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "a", None, "b"]), r.choice([None, *range(400)]), i, r.choice([None, 0, 5, 1 << 50])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, x int, i int, v long").repartition(7)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_places(spark):
    df = table(spark)
    got = order.numbered(df, ["x", "i"])
    assert "SinglePartition" not in plan(got)
    want = df.withColumn("position", F.row_number().over(Window.orderBy("x", "i")).cast("bigint"))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    got = order.numbered(df, [F.desc("x"), "i"], "p", within=["k"])
    want = df.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("x"), "i")).cast("bigint"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_key_is_spread(spark):
    held = order.by_ranges(table(spark).where("k = 'hot'"), ["k", "x", "i"])
    sizes = [r["count"] for r in held.groupBy(F.shiftright("__at", 33)).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)


def test_running_sums(spark):
    df = table(spark)
    w = Window.orderBy("x", "i").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(F.coalesce("v", F.lit(0)))
    got = order.running(df, ["x", "i"], {"running": "v"})
    assert {(r.i, int(r.running)) for r in got.collect()} == {(r.i, r.s) for r in df.select("i", own.over(w).alias("s")).collect()}
    got = order.running(df, ["x", "i"], {"running": "v"}, within=["k"])
    by_key = Window.partitionBy("k").orderBy("x", "i").rowsBetween(Window.unboundedPreceding, 0)
    assert {(r.i, int(r.running)) for r in got.collect()} == {(r.i, r.s) for r in df.select("i", own.over(by_key).alias("s")).collect()}


def test_nothing_and_equal_rows(spark):
    df = table(spark)
    assert order.numbered(df.limit(0), ["x"]).collect() == [] and order.running(df.limit(0), ["x"], {"s": "v"}).collect() == []
    same = spark.createDataFrame([(1, 2)] * 50, "a int, b int")
    assert sorted(r.position for r in order.numbered(same, ["a"]).collect()) == list(range(1, 51))


def test_no_range_is_shuffled_again(spark):
    df = table(spark)
    for within in ([], ["k"]):
        text = plan(order.running(df, ["x", "i"], {"running": "v"}, within=within))
        physical = text[text.index("== Physical Plan ==") :]
        assert "Window" not in physical and "hashpartitioning" not in physical and "SortMergeJoin" not in physical


def test_sums_beyond_a_long(spark):
    rows = [(k, Decimal(10**19 + k)) for k in range(40)]
    got = order.running(spark.createDataFrame(rows, "i long, v decimal(20,0)"), ["i"], {"s": "v"}).collect()
    assert {r.i: int(r.s) for r in got} == {k: int(sum(v for _, v in rows[: k + 1])) for k in range(40)}
