"""Work and memory that grow no faster than the input."""

import time

import pandas as pd
from pyspark.sql import functions as F

from spandrel.operators import parse, sections, typescript_source
from spandrel.schemas import SNAPSHOT


def _seconds(f) -> float:
    start = time.monotonic()
    f()
    return time.monotonic() - start


def test_symbols_of_a_large_file_are_checked_in_linear_time(spark):
    source = "".join(f"def f{k}(a: int) -> int:\n    return a\n" for k in range(8000))
    dependency, symbols = parse._SNAPSHOT["python"](source)
    row = {"path": "a.py", "language": "python", "dependency_fp": dependency, "symbols": symbols, "error": None}
    held = spark.createDataFrame([row], SNAPSHOT)
    assert _seconds(lambda: parse.symbols(parse.check_snapshots(held)).count()) < 20


def test_symbols_that_do_not_rise_are_still_found(spark):
    one = parse._SNAPSHOT["python"]("def a(): pass\ndef b(): pass\ndef c(): pass\n")[1]
    for order, good in (([0, 1, 2], True), ([0, 2, 1], False), ([1, 0, 2], False), ([0, 0], False), ([0], True), ([], True)):
        row = {"path": "a.py", "language": "python", "dependency_fp": "", "symbols": [one[k] for k in order], "error": None}
        held = parse.check_snapshots(spark.createDataFrame([row], SNAPSHOT))
        try:
            assert held.select(F.size("symbols").alias("n")).first().n == len(order) and good
        except Exception as error:
            assert not good and "a snapshot is malformed" in str(error)


def test_files_are_dealt_to_tasks(spark):
    files = spark.createDataFrame([(f"m{k}.py", "x = 1\n") for k in range(40)], "path string, content string").coalesce(1)
    grouped = files.groupBy("path").agg(F.max("content").alias("content"))
    for parsed in (parse.parse_modules(files), parse.parse_snapshots(files), parse.parse_modules(grouped)):
        assert parsed.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_large_files_leave_a_task_one_by_one():
    run = parse._in_batches(lambda path, language, source: {"path": path}, ["path"])
    given = pd.DataFrame({"path": list("abcd"), "language": "python", "content": ["x" * parse.BATCH_CHARS, "x" * parse.BATCH_CHARS, "x", None]})
    assert [list(b["path"]) for b in run([given])] == [["a"], ["b"], ["c", "d"]]


def test_repeated_headings_take_linear_time():
    found = []
    assert _seconds(lambda: found.extend(slug for _, slug, _ in sections.split("a.md", "# Notes-2\n" + "# Notes\n" * 20000))) < 10
    assert found[:5] == ["notes-2", "notes", "notes-1", "notes-3", "notes-4"] and len(set(found)) == 20001


def test_lines_of_a_large_script_are_counted_once():
    class Counted(str):
        passes = 0

        def count(self, *a):
            Counted.passes += 1
            return super().count(*a)

    source = Counted("".join(f"export interface I{k} {{ a: string; get(n: number): string }}\n" for k in range(50)))
    found = typescript_source.scan(source)
    assert Counted.passes == 0 and [x.lines for x in found.containers][:3] == [[1, 1], [2, 2], [3, 3]]


def test_rows_of_a_shard_are_taken_in_order_over_all_frames(spark):
    from spandrel.streaming import parse_cache

    rows = [("a.py", "changed", "xy"[k // 20], k, f"def {'fg'[k // 20]}(): pass\n") for k in range(40)]
    saves = spark.createDataFrame(rows[::2][::-1] + rows[1::2], "path string, event string, version string, order long, content string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = parse_cache.outcomes(saves, shards=1).groupBy("outcome").count().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.outcome: r["count"] for r in found} == {"miss": 2, "hit": 38}


def test_impact_says_what_the_mapping_says(spark):
    from spandrel.operators import diff, mapping

    changes = [("symbol", f"python:{p}#function:{n}", "python", p, "function", n, c) for p in ("a.py", "b.py", "c.py") for n, c in (("alpha", "added"), ("beta", "implementation-changed"))]
    held = diff.finish(spark.createDataFrame(changes, "scope string, id string, language string, path string, kind string, qualified_name string, category string").selectExpr("*", "cast(null as string) before_id", "cast(null as string) after_id", "cast(null as array<string>) changed_facets"))
    files = [("docs/api.md", "# API\n## Of `beta`\n[a](../a.py)\n## alpha\nSee [a](../a.py) and [a](../a.py)\n"), ("x.md", "# One\n[b](b.py)\n")]
    for some in (files, files[1:], []):
        found = sections.sections(spark.createDataFrame(some, "path string, content string"))
        documentation, impact = mapping.map_documentation(held, found), mapping.Impact(held, found)
        names = ("change_id", "file", "section", "slug", "reason", "tier")
        assert sorted(impact.rows().select(*names).collect()) == sorted(mapping.references(documentation).select(*names).collect())
        assert sorted(r.id for r in impact.unmapped().collect()) == sorted(r.change_id for r in documentation.where("unmapped").collect())
        existing = spark.createDataFrame([("README.md",), ("docs/api.md",), ("x.md",)], "path string")
        targets = lambda df: sorted((r.path, r.reasons, sorted(r.sections)) for r in df.collect())
        assert targets(impact.targets(existing)) == targets(mapping.resolve_targets(documentation, held, existing))


def test_occurrences_leave_a_task_in_bounded_batches():
    import pyarrow as pa

    from spandrel.functions import literals

    held = literals.automaton(literals._cut("abbéab", [2, 1, 2, 1]))  # ab, b, éa, b
    texts = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["ab éa" * 3, None] * 50)], names=["k", "text"])
    out = list(literals._found([texts], held, ["k", "literal", "start", "end"], most=50))
    assert max(b.num_rows for b in out) < 50 + 9 and sum(b.num_rows for b in out) == 50 * 9
    assert sorted(tuple(r.values()) for r in out[0].slice(0, 9).to_pylist())[:2] == [(0, "ab", 0, 2), (0, "ab", 5, 7)]
