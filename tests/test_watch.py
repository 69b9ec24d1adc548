"""The folder as a stream of changes, and parsed modules as keyed state."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from spandrel.operators import parse
from spandrel.streaming import changes, parse_cache, watch


def put(root, path, text):
    full = root / path
    full.parent.mkdir(parents=True, exist_ok=True)
    full.write_text(text)


def wait_for(what, seconds=60):
    end = time.time() + seconds
    while not what():
        assert time.time() < end, "nothing came"
        time.sleep(0.1)


def test_listings_and_what_tells_them_apart(tmp_path):
    put(tmp_path, "a.py", "x")
    put(tmp_path, "deep/er/b.py", "y")
    put(tmp_path, "deep/skip.md", "y")
    before = changes.listing(str(tmp_path), ["**/*.py"], [])
    assert sorted(before) == ["a.py", "deep/er/b.py"]
    assert changes.unpacked(json.loads(json.dumps(changes.packed(before)))) == before
    os.remove(tmp_path / "a.py")
    put(tmp_path, "deep/er/b.py", "yy")
    put(tmp_path, "c.py", "")
    after = changes.listing(str(tmp_path), ["**/*.py"], [])
    assert [c[:2] for c in changes.compare(before, after)] == [("a.py", "deleted"), ("c.py", "added"), ("deep/er/b.py", "changed")]


def test_a_burst_is_given_when_it_is_over(tmp_path, monkeypatch):
    clock = [100.0]
    monkeypatch.setattr(changes.time, "monotonic", lambda: clock[0])
    put(tmp_path, "a.py", "1")
    reader = changes._Changes({"path": str(tmp_path), "pause": "0.3", "existing": "false"})
    start = reader.initialOffset()
    given = []
    for step in range(8):
        if step < 4:
            put(tmp_path, "a.py", "1" * (step + 2))  # saved again and again
        clock[0] += 0.2
        given.append(reader.latestOffset())
    assert given[:4] == [start] * 4 and given[6] == given[7] != start
    (part,) = reader.partitions(start, given[-1])
    assert [(r[0], r[1], r[4]) for r in reader.read(part)] == [("a.py", "changed", "11111")]
    assert reader.partitions(given[-1], given[-1])[0].rows == []


def test_edits_additions_and_deletions_each_give_one_refresh(spark, tmp_path):
    root, seen = tmp_path / "src", []
    put(root, "top.py", "x = 1\n")
    put(root, "deep/sub.py", "y = 1\n")
    put(root, "deep/sub.test.ts", "no\n")

    def regenerate(df, number):
        seen.append(sorted((r.path, r.event) for r in df.collect()))

    query = watch.watch(spark, str(root), regenerate, str(tmp_path / "cp"), existing=False, pause=0.2)
    try:
        wait_for(lambda: query.lastProgress is not None)
        put(root, "deep/sub.py", "y = 22\n")
        wait_for(lambda: len(seen) == 1)
        put(root, "deep/new.ts", "export const a = 1;\n")
        wait_for(lambda: len(seen) == 2)
        os.remove(root / "top.py")
        wait_for(lambda: len(seen) == 3)
    finally:
        query.stop()
    assert seen == [[("deep/sub.py", "changed")], [("deep/new.ts", "added")], [("top.py", "deleted")]]
    put(root, "deep/new.ts", "export const a = 22;\n")  # while nobody watches
    os.remove(root / "deep/sub.py")
    again = watch.watch(spark, str(root), regenerate, str(tmp_path / "cp"), once=True)
    again.awaitTermination(60)
    assert again.exception() is None and seen[3:] == [[("deep/new.ts", "changed"), ("deep/sub.py", "deleted")]]


def test_a_failed_batch_is_tried_again_and_not_lost(spark, tmp_path):
    root, seen, broken = tmp_path / "src", [], [True]
    put(root, "a.py", "x = 1\n")
    put(root, "b.py", "x = 1\n")

    def regenerate(df, number):
        seen.append(sorted((r.path, r.content) for r in df.collect()))
        if broken[0]:
            raise RuntimeError

    run = lambda: watch.watch(spark, str(root), regenerate, str(tmp_path / "cp"), once=True, attempts=2).awaitTermination(60)
    run()
    assert seen == [[("a.py", "x = 1\n"), ("b.py", "x = 1\n")]] * 2
    put(root, "b.py", "x = 22\n")
    broken[0] = False
    run()
    assert seen[2:] == [[("a.py", "x = 1\n"), ("b.py", "x = 22\n")]]  # of b.py what it is now
    put(root, "b.py", "x = 333\n")
    run()
    assert seen[3:] == [[("b.py", "x = 333\n")]]


SOURCE = "def {}():\n    pass\n"


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, event string, version string, order long, content string")


def test_hits_misses_and_evictions(spark):
    rows = [("a.py", "added", "1", 1, SOURCE.format("a")), ("a.py", "changed", "1", 2, "not read"), ("a.py", "changed", "2", 3, SOURCE.format("b")), ("b.py", "added", "1", 4, "def ("), ("b.py", "changed", "1", 5, ""),
            ("c.py", "added", "1", 6, SOURCE.format("c")), ("a.py", "changed", "2", 7, SOURCE.format("b")), ("c.py", "deleted", "1", 8, None), ("c.py", "deleted", "1", 9, None), ("c.md", "added", "1", 10, "x"),
            ("d.py", "added", "1", 11, SOURCE.format("d" * 50))]
    most = len(parse_cache.parsed("a.py", SOURCE.format("abc"))[1])
    rows_out = parse_cache.outcomes(table(spark, rows), shards=1, capacity=2, most_chars=most).collect()
    got = {(r.path, r.version): [] for r in rows_out}
    for r in rows_out:
        got[r.path, r.version].append(r.outcome)
    assert got["a.py", "1"] == ["miss", "hit"] and got["b.py", "1"] == ["miss", "hit"]
    assert got["a.py", "2"] == ["miss", "miss"]  # c.py took its place meanwhile
    assert got["c.py", "1"] == ["miss", "removed", "unknown"]
    assert got["d.py", "1"] == ["refused"]
    last = max(rows_out, key=lambda r: r.hits + r.misses)
    assert (last.hits, last.evicted) == (2, 2) and last.held <= 2
    assert next(r for r in rows_out if r.path == "b.py").error == "syntax"


def test_stream_and_table_give_the_same_modules(spark, tmp_path):
    root = tmp_path / "src"
    for k in range(6):
        put(root, f"p{k % 2}/m{k}.py", SOURCE.format(f"f{k}") + "class A:\n    def g(self, x: int) -> str: ...\n")
    put(root, "t.ts", "export interface A { b(x: number): string; c?: string }\nexport function f(a: string): void {}\n")
    held = tmp_path / "out"

    def run():
        stream = parse_cache.observed(parse_cache.outcomes(parse_cache.of_files(changes.read_changes(spark, str(root), ["**/*"], pause=0)), shards=3))
        q = stream.writeStream.format("parquet").option("path", str(held)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        told = [p["observedMetrics"]["parse_cache"] for p in q.recentProgress if p["observedMetrics"]]
        return sum(m["misses"] for m in told), sum(m["removed"] for m in told)

    assert run() == (7, 0)
    put(root, "p0/m0.py", SOURCE.format("changed"))
    os.remove(root / "p1/m1.py")
    os.utime(root / "p0/m2.py")  # another time is another version
    assert run() == (2, 1)
    rows = spark.read.schema(parse_cache.OUTCOME).parquet(str(held))
    assert parse_cache.statistics(rows).first().asDict() == {"hits": 0, "misses": 9, "expired": 0, "removed": 1}
    latest = rows.where("outcome in ('miss', 'removed')").groupBy("path").agg(F.max_by(F.struct(*rows.columns), F.col("misses") * 1000 + F.col("held")).alias("r")).select("r.*")
    latest = latest.where("path <> 'p1/m1.py'")
    from spandrel.sources import files

    batch = parse.parse_modules(files.read_sources(spark, str(root), ["**/*"]))
    key = lambda r: r.path
    assert sorted(parse_cache.modules(latest).select(batch.columns).collect(), key=key) == sorted(batch.collect(), key=key)


def test_what_is_not_used_goes(spark, tmp_path):
    root = tmp_path / "src"
    put(root, "a.py", SOURCE.format("a"))
    stream = parse_cache.outcomes(parse_cache.of_files(changes.read_changes(spark, str(root), ["**/*"], pause=0)), shards=1, idle_ms=1500)
    q = stream.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        wait_for(lambda: spark.table("idle").where("outcome = 'expired'").count() == 1)
    finally:
        q.stop()
    assert [r.outcome for r in spark.table("idle").collect()] == ["miss", "expired"]


@pytest.mark.parametrize("command", [["watch", "--once", "--name", "thing"]])
def test_command(spark, tmp_path, command, monkeypatch):
    from spandrel.__main__ import main

    put(tmp_path, "src/deep/a.py", '"""Doc."""\n' + SOURCE.format("hello"))
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    assert main(["--root", str(tmp_path), *command]) == 0
    assert "thing" in (tmp_path / "README.md").read_text()
