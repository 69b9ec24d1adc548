"""Commands, generated documents and the contained write."""

import os
import subprocess

import pytest

from spandrel.__main__ import main
from spandrel.operators import generate
from spandrel.plans import api
from spandrel.sources import documents
from tests.test_gate_and_sources import TOKEN, repository  # noqa: F401 - a fixture

PROMPTS = []


def echo(prompt):
    PROMPTS.append(prompt)
    return "# Answer\n\n" + prompt


def diagram(prompt):
    return "```\nnot a graph\n```"


@pytest.fixture(autouse=True)
def one_session(spark, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    PROMPTS.clear()


def test_fields_of_prompts():
    assert "# [1.0]" in generate.prompt("changelog", version="1.0", commits="- x")
    for fields in ({"version": "1"}, {"version": "1", "commits": "", "more": ""}):
        with pytest.raises(ValueError, match="takes commits, version"):
            generate.prompt("changelog", **fields)


def test_documents_from_a_model(spark, repository, capsys):  # noqa: F811
    root = str(repository)
    (repository / "package.json").write_text('{"name": "shop", "description": "Sells", "dependencies": {"left": "1"}}')
    assert main(["--root", root, "readme", "--name", "shop", "--model", "tests.test_commands:echo"]) == 0
    assert "src/a.py: def total(x, y)" in PROMPTS[-1] and "Description: Sells" in PROMPTS[-1] and "left" in PROMPTS[-1]
    assert main(["--root", root, "changelog", "1.2.0", "--since", "HEAD~1", "--model", "tests.test_commands:echo", "--strict"]) == 1
    assert "- two" in PROMPTS[-1] and "must start with ## [1.2.0]" in capsys.readouterr().err
    assert main(["--root", root, "diagram", "--model", "tests.test_commands:diagram", "--strict"]) == 1
    assert "graph or flowchart" in capsys.readouterr().err
    pieces = []
    got = api.generate_document(spark, root, "api", lambda p: iter(["# API ", TOKEN[:9], TOKEN[9:]]), deliver=pieces.append)
    assert pieces == [got] and TOKEN not in got
    assert main(["--root", root, "api"]) == 0
    assert "# API Documentation\n\n## a.py" in capsys.readouterr().out
    assert main(["--root", root, "score", "--style", "markdown", "--min", "90"]) == 1
    assert capsys.readouterr().out.splitlines()[0].startswith("# Documentation score: 50/100")
    rows = api.generate_comments(spark, root, lambda p: "/** " + p.rsplit("\n", 1)[-1] + " */").collect()
    assert [(r.name, r.jsdoc) for r in rows] == [("other", "/** def other() */")]


def test_facts_keep_to_the_budget(spark, repository):  # noqa: F811
    modules = api.analyze_folder(spark, str(repository))
    assert api.module_facts(modules, 10_000).count("\n") == 1
    assert api.module_facts(modules, 40) == "- src/a.py: def total(x, y)\n(1 more modules)"


def test_codes_and_switches(spark, repository, tmp_path, capsys):  # noqa: F811
    shallow = tmp_path / "shallow"
    subprocess.run(["git", "clone", "-q", "--depth", "1", f"file://{repository}", str(shallow)], check=True, capture_output=True)
    for args in (["checkout", "-q", "--detach"], ["remote", "remove", "origin"], ["branch", "-D", "main"]):
        subprocess.run(["git", "-C", str(shallow), *args], check=True, capture_output=True)
    assert main(["--root", str(shallow), "plan"]) == 1
    assert capsys.readouterr().err.startswith("PLAN_SHALLOW_HISTORY: ")
    root = str(repository)
    stale = main(["--root", root, "check", "README.md", "--since", "HEAD~1"])
    assert stale != 0 and main(["--root", root, "check", "README.md", "--since", "HEAD~1", "--directory", "docs"]) == 0
    (repository / "src" / "a.py").write_text("def (:\n")
    assert main(["--root", root, "check", "README.md", "--since", "HEAD~1", "--prove"]) not in (0, stale)


def test_choice_of_targets():
    rows = [type("Row", (), {"path": p, "reasons": ["recommendation"]}) for p in ("b.md", "a.md")]
    paths = lambda **more: [r.path for r in api.chosen(rows, **{"explicit": False, "every": False, "choose": None, **more})]
    assert paths(every=True) == paths(explicit=True) == ["a.md", "b.md"]
    assert paths(choose=lambda c: [c[1][0], "other.md"]) == ["b.md"]
    for more in ({}, {"explicit": True, "every": True}):
        with pytest.raises(ValueError):
            paths(**more)


def test_contained_write(tmp_path):
    root = tmp_path / "root"
    (root / "docs").mkdir(parents=True)
    (root / "docs" / "a.md").write_text("one")
    text, seen = documents.read(str(root), "docs/a.md")
    assert text == "one"
    after = documents.replace(str(root), "docs/a.md", "two", seen)
    assert (root / "docs" / "a.md").read_text() == "two" and documents.read(str(root), "docs/a.md") == ("two", after)
    with pytest.raises(ValueError, match="changed meanwhile"):
        documents.replace(str(root), "docs/a.md", "three", seen)
    os.utime(root / "docs" / "a.md", ns=(1, 1))  # the same text, another state
    with pytest.raises(ValueError, match="changed meanwhile"):
        documents.replace(str(root), "docs/a.md", "three", after)
    (tmp_path / "out").mkdir()
    (root / "link").symlink_to(tmp_path / "out")
    (root / "docs" / "l.md").symlink_to(root / "docs" / "a.md")
    for path in ("link/x.md", "../out/x.md", "docs/l.md", "docs/a.md/x"):
        with pytest.raises(ValueError):
            documents.replace(str(root), path, "x", None)
    assert documents.read(str(root), "docs/none.md") == (None, None)
    documents.replace(str(root), "docs/none.md", "new", None)
    assert sorted(os.listdir(root / "docs")) == ["a.md", "l.md", "none.md"] and os.listdir(tmp_path / "out") == []
