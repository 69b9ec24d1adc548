"""The gate, the write flow, scans without bounds, contents at revisions, and what mappings are shown as."""

import subprocess

import pytest
from pyspark.sql import functions as F

from spandrel.functions import paths, text
from spandrel.operators import freshness, gateway, mapping, sections
from spandrel.plans import api
from spandrel.sources import files, git

TOKEN = "ghp_" + "A1b2" * 9  # put together here, no real one


def envelopes(spark, *rows):
    return spark.createDataFrame(rows, "key string, system string, prompt string")


def test_gate_redacts_what_goes_in_and_comes_out(spark):
    seen = []
    gate = gateway.Gate(on_event=lambda df: seen.extend(df.collect()))
    asked = envelopes(spark, ("a", "be brief", f"the key is {TOKEN}"), ("b", "", "nothing"))
    secret = TOKEN
    got = {r.key: r for r in gate.generate(asked, lambda p: f"echo {p}" + (f" and {secret}" if p == "nothing" else "")).collect()}
    assert got["a"].content == "echo be brief\n\nthe key is <REDACTED:GITHUB_TOKEN:1>" and got["a"].action == "allowed"
    assert got["b"].content == "echo nothing and <REDACTED:GITHUB_TOKEN:1>" and got["b"].action == "redacted"
    assert sorted((r.stage, r.key, r.kind, r["count"]) for r in seen if r.kind) == [("input", "a", "github_token", 1), ("output", "b", "github_token", 1)]
    assert all(TOKEN not in str(r) for r in seen)


def test_gate_strict_and_failing_observer(spark):
    called = spark.sparkContext.accumulator(0)

    def model(prompt):
        called.add(1)
        return prompt

    with pytest.raises(Exception, match="secret was found"):
        gateway.Gate("strict").generate(envelopes(spark, ("a", "x", f"{TOKEN}")), model).collect()
    assert called.value == 0

    def broken(df):
        raise RuntimeError("observer")

    assert gateway.Gate("redact", broken).generate(envelopes(spark, ("a", "", "x")), model).first().content == "x"


def test_stream_is_delivered_once():
    out = []
    gate = gateway.Gate()
    got = gate.stream("", f"p {TOKEN}", lambda p: iter([p, " ", TOKEN[:20], TOKEN[20:]]), out.append)
    assert out == [got] and TOKEN not in got
    with pytest.raises(ValueError):
        gateway.Gate("strict").stream("", "p", lambda p: [TOKEN], out.append)
    assert len(out) == 1


@pytest.fixture
def repository(tmp_path):
    root = tmp_path / "clone"
    (root / "src").mkdir(parents=True)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (root / "src" / "a.py").write_text('def total(x: int) -> int:\n    """Doc."""\n    return x\n')
    (root / "src" / "b c.py").write_text("def other() -> int:\n    return 1\n")
    (root / "README.md").write_text("# Shop\n\nCall `total`.\n")
    run("add", ".")
    run("commit", "-qm", "one")
    (root / "src" / "a.py").write_text('def total(x: int, y: int) -> int:\n    """Doc."""\n    return x\n')
    run("mv", "src/b c.py", "src/d.py")
    run("commit", "-qam", "two")
    return root


def test_contents_and_scoped_changes(spark, repository):
    root = str(repository)
    asked = spark.createDataFrame([("src/a.py",), ("src/b c.py",), ("none.py",), (None,), ("src",)], "path string")
    old = {r.path: r.text for r in git.contents(asked, root, "HEAD~1", "path", "text").collect()}
    assert old["src/a.py"].startswith("def total(x: int) ->") and old["src/b c.py"].startswith("def other") and old["none.py"] is None and old[None] is None and old["src"] is None
    now = {r.path: r.text for r in git.contents(asked, root, None, "path", "text").collect()}
    assert "y: int" in now["src/a.py"] and now["src/b c.py"] is None
    assert ("renamed", "src/b c.py", "src/d.py") in [tuple(r) for r in git.changed_files(spark, root, "HEAD~1").collect()]
    assert sorted(tuple(r) for r in git.changed_files(spark, root, "HEAD~1", directory="src").collect() if r.status != "modified") == [("added", None, "src/d.py"), ("deleted", "src/b c.py", None)]
    assert git.repository_root(str(repository / "src")).endswith("clone") and not git.is_shallow(root)


def test_shallow_clone_needs_its_base(repository, tmp_path):
    shallow = tmp_path / "shallow"
    subprocess.run(["git", "clone", "-q", "--depth", "1", f"file://{repository}", str(shallow)], check=True, capture_output=True)
    run = lambda *a: subprocess.run(["git", "-C", str(shallow), *a], check=True, capture_output=True)
    run("checkout", "-q", "--detach")
    run("remote", "remove", "origin")
    run("branch", "-D", "main")
    with pytest.raises(git.ShallowHistory):
        git.discover_base(str(shallow))


def test_update_names_the_sections_and_passes_the_gate(spark, repository):
    prompts, root = [], str(repository)
    made = api.update(spark, root, "HEAD~1", "HEAD", model=lambda p: "# Shop\n\n" + ("ok" if '"category":"contract-changed"' in p and '"direct_targets":[{"file":"README.md","section":"Shop"}]' in p and "Call `total`." in p else p), write=True)
    assert made == {"README.md": "# Shop\n\nok"} and (repository / "README.md").read_text() == "# Shop\n\nok"
    with pytest.raises(ValueError):
        api.update(spark, root, "HEAD~1", "HEAD", model=lambda p: "```\nno heading", write=True, strict=True, target="README.md")
    assert (repository / "README.md").read_text() == "# Shop\n\nok"
    (repository / "README.md").write_text(f"# Shop\n\n`total` {TOKEN}\n")
    echoed = api.update(spark, root, "HEAD~1", "HEAD", model=lambda p: "# X\n" + p, config=api.Config(policy="warn"), target="README.md")
    assert TOKEN not in echoed["README.md"] and "GITHUB_TOKEN" in echoed["README.md"]
    assert prompts == []


def test_write_flow(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n")
    got = api.write_document(spark, str(tmp_path), "a.md", "no heading\n", "# A\n", dry_run=True)
    assert got["warnings"] and not got["written"] and "-# A" in got["diff"] and (tmp_path / "a.md").read_text() == "# A\n"
    with pytest.raises(ValueError):
        api.write_document(spark, str(tmp_path), "a.md", "  \n", "# A\n", strict=True)
    assert api.write_document(spark, str(tmp_path), "a.md", "# B\n", "# A\n")["written"] and (tmp_path / "a.md").read_text() == "# B\n"


def test_scans_have_bounds_only_where_scoped(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"m{i}.py").write_text("x = 1\n")
    monkeypatch.setattr(files, "MOST_FILES", 10)
    reader = lambda scoped: files._Reader({"path": str(tmp_path), "include": "*.py", "scoped": scoped})
    assert sum(len(p.names) for p in reader("false").partitions()) == 30
    with pytest.raises(ValueError):
        reader("true").partitions()
    monkeypatch.setattr(files, "PART_FILES", 2)
    assert len(reader("false").partitions()) == 15
    assert files.read_sources(spark, str(tmp_path), ["*.py"]).count() == 30


def test_watch_command_writes_the_readme(spark, repository):
    made = api.regenerate_readme(spark, str(repository), name="shop")
    assert (repository / "README.md").read_text() == made and "`total()` — Doc." in made


def test_parsed_sources(spark):
    changed = spark.createDataFrame([("./src/a.py",), ("src/tests/b.py",), ("README.md",), ("z.ts",)], "path string")
    held = [("src/a.py", "x = 1\n"), ("z.ts", "export const a = 1")]
    known = lambda rows: spark.createDataFrame(rows, "path string, content string")
    assert [r.path for r in freshness.parsed_sources(changed, known(held)).collect()] == ["src/a.py", "z.ts"]
    for bad in (held[:1], [held[0], ("z.ts", "export function (")]):
        with pytest.raises(Exception, match="not there|cannot parse"):
            freshness.parsed_sources(changed, known(bad)).collect()


REFS = "change_id string, direct_references array<struct<file:string,section:string,slug:string,reason:string>>, recommendations array<struct<file:string,section:string,slug:string,reason:string>>, unmapped boolean"


def test_presentation_and_projection(spark):
    docs = spark.createDataFrame([("a", [("./x.md", "B", "b", "heading"), ("x.md", "A", "a", "heading")], [("x.md", "C", "c", "changelog")], False), ("b", [], [], True)], REFS)
    assert sorted((r.path, r.reasons, r.sections) for r in mapping.presentation(docs).collect()) == [("./x.md", ["direct-reference"], ["B"]), ("x.md", ["direct-reference", "recommendation"], ["A", "C"])]
    refs = spark.createDataFrame([([("z.md", "Z", "z", "heading"), ("/home/u/x.md", "A", "a", "heading"), ("a.md", "A\x01", "a", "heading"), ("a.md", "B", "b", "heading")],)], "r " + REFS.split("direct_references ")[1].split(", rec")[0])
    assert [x.file for x in refs.select(mapping.projected_references(F.col("r")).alias("r")).first().r] == ["a.md", "z.md"]
    changes = spark.createDataFrame([("a", "added", "informational", None), ("q", "removed", "potentially-breaking", ["x"])], "id string, category string, risk string, changed_facets array<string>")
    got = {r.id: r for r in mapping.template_changes(docs, changes).collect()}
    assert [t.file for t in got["a"].direct_targets] == ["./x.md", "x.md"] and got["a"].changed_facets == [] and got["q"].direct_targets == [] and got["q"].changed_facets == ["x"]


def test_names_of_several_parts_are_found(spark):
    docs = [("README.md", "# About [computed:ab12] now\n\nCall `x['a-b'].run!` or `Shop.sell()`.\n\n## Shop.sell\n\n## resell\n")]
    changes = spark.createDataFrame([("1", "[computed:ab12]", "p"), ("2", "'a-b'", "p"), ("3", "Shop.sell", "p"), ("4", "sell", "p"), ("5", "computed", "p")], "id string, qualified_name string, path string")
    got = sorted((r.id, r.slug, r.reason) for r in mapping.direct_references(changes, sections.sections(files.captured(spark, docs))).distinct().collect())
    assert got == [("1", "about-computedab12-now", "heading"), ("2", "about-computedab12-now", "code-span"), ("3", "about-computedab12-now", "code-span"), ("3", "shopsell", "heading"), ("5", "about-computedab12-now", "heading")]


def test_failure_paths_and_canonical_order(spark):
    assert [paths.failure_path(p) for p in ("a/../b.ts", "a\\b.py", "/a", "C:\\a", "..", "a\x01", "", None, "x:y")] == ["b.ts", "a/b.py", None, None, None, None, None, None, "x:y"]
    row = spark.createDataFrame([([("b", 1), ("a", 10), ("a", 9)],)], "x array<struct<n:string,v:int>>")
    assert [(r.n, r.v) for r in row.select(text.canonical_sorted(F.col("x")).alias("x")).first().x] == [("a", 10), ("a", 9), ("b", 1)]


def test_headings_are_evidence(spark):
    (row,) = sections.sections(files.captured(spark, [("docs/a.md", "# Use `f` and [g](../src/g.ts)\n\n`h`\n")])).collect()
    assert row.code_spans == ["f", "h"] and row.link_targets == ["src/g.ts"]
