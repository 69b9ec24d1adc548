"""Records, addresses, retries and the command line."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.__main__ import main
from spandrel.functions import records, text


def values(spark, rows, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_exact_record(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    got = values(spark, ['{"a":1,"b":"x"}', '{"a":1}', '{"a":1,"b":"x","c":2}', '{"a":"z","b":"x"}', "no"], lambda c: records.exact_record(c, schema))
    assert [None if x is None else tuple(x) for x in got] == [(1, "x"), None, None, None, None]


def test_base64url(spark):
    assert values(spark, ["a", "ab?>", ""], lambda c: records.base64url_decode(text.base64url(c.cast("binary"))).cast("string")) == ["a", "ab?>", ""]
    assert values(spark, ["a+", "YR", "YQ"], lambda c: records.base64url_decode(c).cast("string")) == [None, None, "a"]


def test_token_streams(spark):
    assert values(spark, ['{"t":"a"}\n{"t":"b","done":true}\n', '{"t":"a"}\n'], lambda c: records.ndjson(c, "t")) == ["ab", None]
    assert values(spark, ["data: a\n\ndata: b\ndata: c\n\ndata: [DONE]\n\n", "data: a\n\n"], records.server_events) == [["a", "b\nc"], None]


def test_addresses(spark):
    assert values(spark, ["8.8.8.8", "10.1.2.3", "127.0.0.1", "::1", "fe80::1", "::ffff:10.0.0.1", "x"], records.address_class) == ["public", "private", "local", "local", "private", "private", None]
    ranges = spark.createDataFrame([(167772160, 184549375, "wide"), (167772160, 167772415, "narrow")], "low long, high long, label string")
    got = {r.address: r.label for r in records.in_ranges(spark.createDataFrame([("10.0.0.7",), ("10.9.0.1",), ("9.9.9.9",)], "address string"), ranges).collect()}
    assert got == {"10.0.0.7": "narrow", "10.9.0.1": "wide", "9.9.9.9": None}


def test_retries():
    seen, waits = [], []

    def f():
        seen.append(1)
        if len(seen) < 3:
            raise RuntimeError("HTTP 503")
        return "ok"

    assert records.with_retry(f, sleep=waits.append) == "ok" and len(waits) == 2
    with pytest.raises(RuntimeError):
        records.with_retry(lambda: (_ for _ in ()).throw(RuntimeError("bad")), sleep=waits.append)
    assert records.delay(10, jitter=False) == 30


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text('def f():\n    """Does."""\n\n\ndef g():\n    pass\n')
    assert main(["--root", str(tmp_path), "score", "--min", "60"]) == 1
    assert "50/100" in capsys.readouterr().out
    assert main(["--root", str(tmp_path), "readme", "--name", "x"]) == 0
    assert "# x" in capsys.readouterr().out
    assert main(["--root", str(tmp_path), "plan", "--base", "nothing"]) == 1
