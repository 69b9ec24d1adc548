"""Modules that are read in pieces are as if they were read at once, and no piece holds more than a part of the file."""

import ast
import tracemalloc

import pytest

from spandrel.operators import parse, python_source, typescript_source
from spandrel.sources import shared

PYTHON = '''"""A text
def not_one(): pass
"""
import os
if os.name:
    from a import b
else:
    pass
@deco(
    1)
def f(x: int = 2) -> str:
    """Doc"""
    return """
def g(): pass
class H: pass
"""
x = [
# comment
]; y = 1 + \\
2
class C(Base):
    @staticmethod
    def m(a): pass
async def later(): pass
'''
SCRIPT = """import A, { b } from './b';
/** First */
export function f(a: number): number { return a / 2 }
/** Kept till the end */
class Late { m(): void {} }
// between
@dec({ a: 1 })
export class C<T extends Map<string, number>> { x = `}
export function no() {}
`; }
export interface I { a: string }
function hidden() { return <a>export x</a> }
export type T = { a: 1 }
export { Late };
"""


def _joined(pieces):
    return {k: v[0].as_py() for k, v in parse._module_row(pieces, parse.to_arrow_schema(parse.MODULE)).items()}


@pytest.mark.parametrize("size", [1, 20, 60, 150])
@pytest.mark.parametrize(("of", "source", "least"), [(python_source, PYTHON, 3), (typescript_source, SCRIPT, 4)])
def test_pieces_come_to_the_whole(of, source, least, size):
    pieces = list(of.module_pieces(source, size))
    whole = _joined(of.module_pieces(source, len(source)))
    assert _joined(pieces) == whole and whole["functions"] and whole["classes"]
    assert size > 1 or len(pieces) >= least
    if of is python_source:
        assert [f["line_range"] for f in whole["functions"]] == [[n.lineno, n.end_lineno] for n in ast.parse(source).body if isinstance(n, python_source.FUNCTIONS)]
    else:
        assert {c["name"] for c in whole["classes"]} == {"Late", "C"} and [f["name"] for f in whole["functions"]] == ["f"]


def test_an_error_in_a_late_piece_is_one_of_the_file(spark):
    files = [("a.py", "def f(): pass\n" * 30000 + "def (:\n"), ("b.ts", "export function f() {}\n" * 20000 + "export function g( {\n"), ("c.py", "def f(): pass\n" * 30000), ("d.py", None)]
    parsed = shared.written(parse.parse_modules(spark.createDataFrame(files, "path string, content string")))
    got = {r.path: (r.error, r.n) for r in parsed.selectExpr("path", "error", "size(functions) AS n").collect()}
    assert got == {"a.py": ("syntax", 0), "b.ts": ("syntax", 0), "c.py": (None, 30000), "d.py": ("unreadable", 0)}


@pytest.mark.parametrize(("of", "one"), [(python_source, "def f{}(a: int, b: float = 1.5) -> int:\n    return a * b + (a - b)\n"), (typescript_source, "export function f{}(a: number, b: number = 1): number {{ return a * b + (a - b) }}\n")])
def test_memory_of_a_large_file_stays_near_that_of_its_rows(of, one):
    source, schema = "".join(one.format(k) for k in range(5000)), parse.to_arrow_schema(parse.MODULE)
    tracemalloc.start()
    row = parse._module_row(of.module_pieces(source), schema)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(row["functions"][0]) == 5000 and most < 40 << 20


def test_a_file_of_any_size_is_parsed(spark):
    long = "x" * (11 << 20)
    rows = [("a.py", f'X = "{long}"\ndef f(): pass\n'), ("b.ts", f"/* {long} */\nexport function f(): void {{}}\n")]
    files = spark.createDataFrame(rows, "path string, content string")
    parsed = shared.written(parse.parse_modules(files))
    assert sorted((r.path, r.error, r.functions[0].name) for r in parsed.collect()) == [("a.py", None, "f"), ("b.ts", None, "f")]
    assert sorted(r.path for r in parse.analyze(files).select("path").collect()) == ["a.py", "b.ts"]
    assert sorted(r.qualified_name for r in parse.symbols(parse.require_parsed(parse.parse_snapshots(files))).collect()) == ["f", "f"]


def test_modules_of_the_queries_fail_where_a_file_does(spark, monkeypatch):
    from spandrel.plans import sourced

    bad = spark.createDataFrame([("a.py", "def f(:"), ("b.py", "def g(): pass")], "path string, content string")
    monkeypatch.setattr(sourced, "_files", lambda spark, sf_dir: bad)
    for query in ("parsed_modules", "generated_comments", "coverage_report"):
        with pytest.raises(Exception, match="cannot parse a.py"):
            getattr(sourced, query)(spark, "").collect()


AGAIN = '''from a import b
@overload
def f(a: int) -> int: ...
class C:
    def m(self): return 1
def g(): pass
@overload
def f(a: str) -> str: ...
class C(Base):
    """Doc"""
    def n(self): return 2
def f(a): return a
if b:
    import c
'''
MERGED = """import { a } from './a';
export interface I { a: string }
class Late { m(): void {} }
export function f(a: number): number;
export interface I { b?: number; get(n: number): string }
export function g() { return f(1) }
export function f(a: any) { return a }
function hidden() {}
export class C { ["run" + 1](n: number): void {} }
export { Late };
"""


@pytest.mark.parametrize("size", [1, 30, 90])
@pytest.mark.parametrize(("of", "source", "names"), [(python_source, AGAIN, ["C", "f", "g", "C.n"]), (typescript_source, MERGED, ["C", "Late", "f", "g", "I", "C.[computed", "I.get", "Late.m"])])
def test_snapshots_in_pieces_come_to_the_whole(of, source, names, size):
    whole = [s for some, _ in of.snapshot_pieces(source, len(source)) for s in some]
    pieces = list(of.snapshot_pieces(source, size))
    key = lambda s: (s["kind"], s["qualified_name"])
    assert sorted((s for some, _ in pieces for s in some), key=key) == sorted(whole, key=key) == of.snapshot(source)[1]
    assert [s["qualified_name"].split(":")[0] for s in of.snapshot(source)[1]] == names
    assert sorted(n for _, own in pieces for n in own) == sorted(n for _, own in of.snapshot_pieces(source) for n in own) != []


@pytest.mark.parametrize(("of", "one"), [(python_source, "@overload\ndef f{0}(a: int) -> int: ...\ndef f{0}(a, b: float = 1.5):\n    return a * b + (a - b)\n"), (typescript_source, "export function f{0}(a: number, b: number = 1): number {{ return a * b + (a - b) }}\n")])
def test_memory_of_a_snapshot_stays_near_that_of_its_symbols(of, one):
    source, schema = "".join(one.format(k) for k in range(10000)), parse.to_arrow_schema(parse.SNAPSHOT)
    tracemalloc.start()
    row = parse._snapshot_row(of.snapshot_pieces(source), schema)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(row["symbols"][0]) == 10000 and most < 60 << 20


def test_symbols_in_several_rows_are_those_of_the_snapshots(spark, monkeypatch):
    rows = [("a.py", "".join(f"def f{k}(): return {k}\n" for k in range(9000))), ("b.ts", MERGED), ("c.py", "def f(): pass\n" * 9000 + "def (:\n"), ("d.py", ""), ("e.py", None)]
    files = spark.createDataFrame(rows, "path string, content string")
    parts = shared.written(parse.parse_symbols(files))
    found = lambda df: sorted(map(str, parse.symbols(df).drop("ordinal").where("path <> 'c.py'").collect()))
    assert found(parts) == found(parse.parse_snapshots(files)) and len(found(parts)) == 9008
    sizes = [r.n for r in parts.where("path = 'a.py'").selectExpr("size(symbols) AS n").collect()]
    assert len(sizes) > 2 and max(sizes) < 5000
    whole = lambda df: sorted((r.path, r.dependency_fp, r.error) for r in df.where("dependency_fp is not null or error is not null").collect())
    assert whole(parts) == whole(parse.parse_snapshots(files))
    with pytest.raises(Exception, match="cannot parse"):
        parse.symbols(parse.require_parsed(parts)).collect()
