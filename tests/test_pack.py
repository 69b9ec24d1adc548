"""First fit at table size, and the envelope's bytes."""

import random

import pytest
from pyspark.sql import functions as F

from spandrel.operators import pack


def plain(items, budget):
    """[(order, form)] of one group."""
    used, out = 0, []
    for order, full, compact in sorted(items):
        for form, n in (("full", full), ("compact", compact)):
            if n is not None and used + n <= budget:
                used += n
                out.append((order, form))
                break
    return out


@pytest.mark.parametrize("budget", [40, 700, 5000])
def test_groups_of_any_size(spark, budget):
    r = random.Random(budget)
    rows = [(r.choice(["hot"] * 8 + ["a", None]), i, r.choice([None, r.randint(1, 90), r.randint(1, 900)]), r.choice([None, r.randint(1, 40)])) for i in range(6000)]
    got: dict = {}
    for x in pack.pack_groups(spark.createDataFrame(rows, "k string, o long, f long, c long").repartition(5), "k", "o", "f", "c", budget).collect():
        got.setdefault(x.k, []).append((x.order, x.form))
    for k in ("hot", "a", None):
        assert sorted(got.get(k, [])) == plain([x[1:] for x in rows if x[0] == k], budget)


def test_contenders_do_not_grow_with_the_group(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("k"), F.floor(F.col("id") / 200_000).cast("string")).alias("k"), F.col("id").alias("o"), (F.col("id") * 7919 % 50 + 1).alias("s"))
    held = pack.contenders(rows, ["k"], "o", F.col("s"), 300).count()
    assert held <= sum(300 // s for s in range(1, 51))
    assert "SinglePartition" not in pack.pack_groups(rows, "k", "o", "s", None, 300)._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="below 1"):
        pack.pack_groups(rows.withColumn("s", F.lit(0)), "k", "o", "s", None, 300).collect()


def whole(digest, summary, records, budget):
    """The envelope, measured in full each time."""
    size = lambda e: len(pack.canonical(e).encode())
    e = {"schemaVersion": "impact-context.v1", "impactDigest": digest, "summary": summary, "changes": [], "documentation": [], "omittedRecords": len(records)}
    for r in records:
        for form in ("full", "compact"):
            if r.get(form) is not None:
                tried = {**e, "changes": [*e["changes"], r[form]], "documentation": [*e["documentation"], *r.get(f"{form}_docs", [])], "omittedRecords": e["omittedRecords"] - 1}
                if size(tried) <= budget:
                    e = tried
                    break
    return e, size(e)


def test_bytes_are_those_of_the_whole_envelope():
    r = random.Random(8)
    for _ in range(60):
        n = r.choice([0, 3, 12, 101, 1005])
        records = [{"full": r.choice([None, {"t": "é" * r.randint(0, 200)}]), "full_docs": [{"d": "x" * r.randint(0, 9)}] * r.randint(0, 3), "compact": r.choice([None, {"c": 1}]), "compact_docs": []} for _ in range(n)]
        budget = r.choice([1024, 3000, 12_000])
        envelope, report = pack.build_context("0" * 64, {"x": 1}, records, budget)
        want, used = whole("0" * 64, {"x": 1}, records, budget)
        assert envelope == want and report["usedBytes"] == used == len(pack.canonical(envelope).encode())
        assert report["includedRecords"] + report["omittedRecords"] == n
