"""Canonical JSON against the driver's, and ordered lines with their commit."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.functions import canonical
from spandrel.operators import pack
from spandrel.sources import lines

INNER = T.StructType([T.StructField("z", T.StringType()), T.StructField("a", T.ArrayType(T.LongType())), T.StructField("é\"", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
KIND = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("Z", T.BooleanType()), T.StructField("d", T.DoubleType()), T.StructField("ds", T.ArrayType(T.DoubleType())),
    T.StructField("in", INNER), T.StructField("many", T.ArrayType(INNER)), T.StructField("s", T.StringType()), T.StructField("by", T.MapType(T.StringType(), T.LongType())),
])


def made(n=300):
    r = random.Random(1)
    texts = ["", "plain", 'q"uote\\', "é😀 ", "".join(map(chr, range(33))) + "\x7f", None, "a/b<>"]
    doubles = [0.0, -0.0, 1.0, 1e16, 1e-7, 0.1, 1 / 3, 2.0**-44, 1e300, -5e-324, None, 123456789.125]
    pick = r.choice
    inner = lambda: pick([None, {"z": pick(texts), "a": pick([None, [], [1, None, -2]]), 'é"': pick([None, {}, {"b": [pick(texts)], "a": None, "é": [], "Z\n": ["x"]}])}])
    return [{"n": pick([None, 0, -(2**63), 2**63 - 1]), "Z": pick([None, True, False]), "d": pick(doubles), "ds": pick([None, [], [pick(doubles), pick(doubles)]]), "in": inner(), "many": pick([None, [], [inner(), inner()]]), "s": pick(texts), "by": pick([None, {"b": 1, "a": 2, "c": None}])} for _ in range(n)]


def test_as_the_driver_writes_it(spark):
    rows = made()
    got = spark.createDataFrame(list(enumerate(rows)), T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", KIND)])).select("i", canonical.value(F.col("v"), KIND).alias("json")).collect()
    for r in got:
        assert r.json == pack.canonical(rows[r.i])
        json.loads(r.json)


def test_refusals(spark):
    df = spark.createDataFrame([(float("nan"),)], "x double")
    with pytest.raises(Exception, match="not finite"):
        df.select(canonical.value(F.col("x"), T.DoubleType())).collect()
    for kind in ("timestamp", "array<struct<a:double>>", "map<int,string>"):
        with pytest.raises(TypeError):
            canonical.value(F.lit(None), T._parse_datatype_string(kind))


def test_lines_keep_their_order_over_parts(spark, tmp_path):
    df = spark.range(5000).select("id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("line")).repartition(6)
    folder = str(tmp_path / "out")
    lines.write(df, "line", [F.desc("id")], folder)
    held = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert held["lines"] == 5000 and len(held["parts"]) > 1
    whole = b"".join((tmp_path / "out" / p["name"]).read_bytes() for p in held["parts"])
    assert whole.decode().splitlines() == [f"é{k}" for k in range(4999, -1, -1)]
    got = lines.read(spark, folder).orderBy("position").collect()
    assert [(r.position, r.line) for r in got[:2]] == [(1, "é4999"), (2, "é4998")] and len(got) == 5000


def test_commit_abort_and_overwrite(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.range(40).select("id", F.col("id").cast("string").alias("line"))
    lines.write(df, "line", ["id"], folder)
    before = sorted(os.listdir(folder))
    bad = df.withColumn("line", F.when(F.col("id") == 33, F.raise_error(F.lit("no"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no"):
        lines.write(bad, "line", ["id"], folder, overwrite=True)
    assert lines.read(spark, folder).count() == 40  # the table is as it was
    with pytest.raises(Exception, match="holds a table"):
        lines.write(df, "line", ["id"], folder)
    assert sorted(n for n in os.listdir(folder) if n in before) == before
    lines.write(df.where("id < 3"), "line", ["id"], folder, overwrite=True)
    assert [r.line for r in lines.read(spark, folder).orderBy("position").collect()] == ["0", "1", "2"]
    lines.write(df.limit(0), "line", ["id"], folder, overwrite=True)
    assert lines.read(spark, folder).count() == 0 and os.listdir(folder) == ["manifest.json"]


def test_a_changed_part_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "out")
    lines.write(spark.range(4).select("id", F.lit("x").alias("line")), "line", ["id"], folder)
    name = json.loads((tmp_path / "out" / "manifest.json").read_text())["parts"][0]["name"]
    (tmp_path / "out" / name).write_text("y\n")
    with pytest.raises(Exception, match="not what the manifest says"):
        lines.read(spark, folder).collect()
