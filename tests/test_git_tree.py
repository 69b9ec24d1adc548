"""A revision as a partitioned table."""

import os
import subprocess

import pytest

from spandrel.sources import git, git_tree


@pytest.fixture
def clone(tmp_path):
    root = tmp_path / "clone"
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    for k in range(12):
        (root / f"p{k % 3}" / f"q{k % 2}").mkdir(parents=True, exist_ok=True)
        (root / f"p{k % 3}" / f"q{k % 2}" / f"m {k}.py").write_text(f"x = {k}\n" * (k + 1))
    (root / "README.md").write_text("é\n")
    os.symlink("README.md", root / "link")
    run("init", "-q", "-b", "main")
    run("add", ".")
    run("commit", "-qm", "one")
    run("mv", "p0/q0/m 0.py", "p1/moved.py")
    (root / "README.md").write_text("other\n")
    (root / "new.ts").write_text("let a = 1\n")
    run("rm", "-q", "p2/q0/m 2.py")
    run("add", ".")
    run("commit", "-qm", "two")
    return root


def test_all_files_of_a_revision(spark, clone):
    for parts in (1, 4, 64):
        rows = {r.path: r for r in git_tree.read_tree(spark, str(clone), "HEAD~1", parts=parts).collect()}
        assert len(rows) == 14 and rows["p1/q1/m 7.py"].content == "x = 7\n" * 8 and rows["README.md"].content == "é\n"
        assert rows["link"].mode == "120000" and rows["README.md"].size == 3
    assert {r.content for r in git_tree.read_tree(spark, str(clone), contents=False).collect()} == {None}
    with pytest.raises(Exception, match="cannot be resolved"):
        git_tree.read_tree(spark, str(clone), "no-such").collect()


def test_filters_are_pushed(spark, clone):
    tree = git_tree.read_tree(spark, str(clone), "HEAD~1", parts=4)
    for where, want in (("path like 'p1/%'", {f"p1/q{k % 2}/m {k}.py" for k in (1, 4, 7, 10)}), ("path in ('README.md', 'p0/q0/m 0.py', 'none')", {"README.md", "p0/q0/m 0.py"}), ("path like '%.md' and size < 10", {"README.md"}), ("size >= 60 and path like 'p%'", {"p0/q1/m 9.py", "p1/q0/m 10.py", "p2/q1/m 11.py"})):
        df = tree.where(where)
        assert {r.path for r in df.collect()} == want
    reader = git_tree._Reader({"path": str(clone), "revision": "HEAD~1", "parts": "4"})
    from pyspark.sql.datasource import EqualTo, IsNotNull, StringStartsWith

    assert list(reader.pushFilters([StringStartsWith(("path",), "p1/"), IsNotNull(("path",)), EqualTo(("oid",), "x")])) == [IsNotNull(("path",)), EqualTo(("oid",), "x")]
    listed = [f for p in reader.partitions() for f in p.folders] + [f[0] for p in reader.partitions() for f in p.files]
    assert listed and all(x.startswith("p1/") for x in listed)  # no other subtree is listed


def test_two_trees(spark, clone):
    side = lambda r: git_tree.read_tree(spark, str(clone), r, contents=False)
    got = sorted(map(tuple, git_tree.compare_trees(side("HEAD~1"), side("HEAD")).collect()), key=str)
    want = sorted(map(tuple, git.changed_files(spark, str(clone), "HEAD~1").collect()), key=str)
    assert got == want and ("renamed", "p0/q0/m 0.py", "p1/moved.py") in got


def test_counters_come_with_the_count(spark, clone):
    pairs, counts = git.snapshot_pairs(spark, str(clone), "HEAD~1", "HEAD", ["**/*.py"])
    assert counts == {"unsupported": 1, "excluded": 1}
    assert sorted((r.status, r.before_path, r.after_path) for r in pairs.collect()) == [("deleted", "p2/q0/m 2.py", None), ("renamed", "p0/q0/m 0.py", "p1/moved.py")]
