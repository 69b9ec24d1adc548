"""Networks, literals and settings against plain versions."""

import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from spandrel.functions import literals, secrets
from spandrel.operators import networks, settings


def test_narrowest_network(spark):
    r = random.Random(2)
    ranges = [("10.0.0.0", "10.255.255.255", "ten"), ("10.1.2.3", "10.1.2.9", "odd"), ("10.1.2.3", "10.1.2.9", "also"), ("0.0.0.0", "255.255.255.255", "all"), ("fc00::", "fdff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "local"), ("fd00::5", "fd00::5", "one"), ("::ffff:10.1.2.4", "::ffff:10.1.2.4", "mapped")]
    texts = ["10.1.2.3", "10.1.2.4", "10.1.2.9", "10.1.2.10", "::ffff:10.1.2.5", "fd00::5", "fd00::6", "2001:db8::1", "no", "", None, "1.2.3", "10.1.2.3"] + [str(ipaddress.ip_address(r.getrandbits(32))) for _ in range(50)]

    def plain(text):
        try:
            a = networks._number(text)
        except TypeError:
            return None
        held = [(networks._number(h) - networks._number(lo), label) for lo, h, label in ranges if a is not None and networks._number(lo) <= a <= networks._number(h)]
        return min(held)[1] if held else None

    df = spark.createDataFrame([(t,) for t in texts], "address string")
    rows = networks.locate(df, spark.createDataFrame(ranges, "low string, high string, label string")).collect()
    assert sorted((r.address or "", r.label or "") for r in rows) == sorted((t or "", plain(t) or "") for t in texts)
    assert {r.label for r in networks.locate(df, spark.createDataFrame([], "low string, high string, label string")).collect()} == {None}
    with pytest.raises(Exception, match="last IP address|same version"):
        networks.locate(df, spark.createDataFrame([("10.0.0.9", "10.0.0.1", "x")], "low string, high string, label string")).collect()


def test_literals_are_found_as_one_by_one(spark):
    r = random.Random(4)
    held = ["aa", "a", "aab", "é", "ba", "", "b a"] + ["".join(r.choice("ab é") for _ in range(r.randint(1, 5))) for _ in range(60)]
    texts = ["".join(r.choice("aab é") for _ in range(r.randint(0, 80))) for _ in range(40)] + [None, ""]

    def plain(t):
        out = []
        for x in {x for x in held if x}:
            at = t.find(x)
            while at >= 0:
                out.append((x, at, at + len(x)))
                at = t.find(x, at + len(x))
        return sorted(out)

    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    words = spark.createDataFrame([(x,) for x in held], "literal string")
    for most in (1 << 20, 40):  # one automaton, many
        got = {}
        for x in literals.occurrences(df, words, "k", "t", most).collect():
            got.setdefault(x.k, []).append((x.literal, x.start, x.end))
        assert all(sorted(got.get(k, [])) == plain(t or "") for k, t in enumerate(texts))
    assert literals.occurrences(df, words.limit(0), "k", "t").collect() == []
    found = secrets.find("see /srv/x and /srv/x/y", literals=("/srv/x", "/srv/x/y", ""))
    assert sorted((m[1], m[3]) for m in found) == [(4, "/srv/x"), (15, "/srv/x"), (15, "/srv/x/y")]


def test_settings_of_the_nearest_folder(spark):
    rows = [
        ("package.json", json.dumps({"name": "x"})), ("spandrel.json", json.dumps({"budget": 1})), ("a/package.json", json.dumps({"spandrel": {"budget": 2}})), ("a/spandrel.json", json.dumps({"budget": 3})),
        ("a/b/.config/spandrel.json", json.dumps({"budget": 4})), ("c/spandrel.json", "{broken"), ("d/spandrel.config.js", "x"), ("e/spandrel.json", json.dumps({"model": {"apiKey": "k"}})), ("f/spandrel.json", "[1]"),
        ("g/package.json", json.dumps({"spandrel": 5})), ("h/myspandrel.json", "{}"), ("i/spandrel.json", None), ("j/package.json", "not read"),
    ]
    own = settings.folder_settings(spark.createDataFrame(rows, "path string, content string"))
    files = ["x.py", "a/x.py", "a/b/x.py", "a/b/c/d/x.py", "c/x.py", "d/x.py", "d/deep/x.py", "e/x.py", "f/x.py", "g/x.py", "h/x.py", "i/x.py", "j/x.py"]
    got = {r.path: (r.settings, r.unsafe) for r in settings.nearest(spark.createDataFrame([(f,) for f in files], "path string"), own).collect()}
    budget = lambda n: (f'{{"budget":{n}}}', False)
    assert {p: got[p] for p in files[:4] + ["h/x.py"]} == {"x.py": budget(1), "a/x.py": budget(2), "a/b/x.py": budget(4), "a/b/c/d/x.py": budget(4), "h/x.py": budget(1)}
    assert all(got[p] == (None, True) for p in ("c/x.py", "d/x.py", "d/deep/x.py", "e/x.py", "f/x.py", "g/x.py", "i/x.py", "j/x.py"))
    df = spark.createDataFrame([("c/x.py",)], "path string")
    with pytest.raises(Exception, match="unsafe"):
        settings.required(settings.nearest(df, own)).collect()
    with pytest.raises(Exception, match="too deep"):
        settings.nearest(df.select(F.lit("../x").alias("path")), own).collect()
    assert settings.nearest(df, own.limit(0)).first().settings is None


def test_repeated_ranges_come_to_one_row_of_a_prefix(spark):
    ranges = [("10.0.0.0", "10.0.0.76", f"n{i:02}") for i in range(50)] + [("10.0.0.0", "10.0.0.255", "wide"), ("10.0.0.64", "10.0.0.64", "z"), ("10.0.0.64", "10.0.0.64", None)]
    held = networks._narrowest(spark.createDataFrame(ranges, "low string, high string, label string")).collect()
    assert len(held) == len({(r.length, r.hi, r.lo) for r in held}) == 6  # 77 addresses are four prefixes
    asked = spark.createDataFrame([("10.0.0.1",), ("10.0.0.200",), ("10.0.0.64",)], "address string")
    found = networks.locate(asked, spark.createDataFrame(ranges, "low string, high string, label string")).collect()
    assert {r.address: r.label for r in found} == {"10.0.0.1": "n00", "10.0.0.200": "wide", "10.0.0.64": None}


def test_literals_are_counted_as_they_occur(spark):
    texts = ["aaaaaaa", "abababa ab", "", None, "nothing", "Ünïcode ab \U0001f600ab", "abc" * 50, "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    for words in (["aa", "ab", "bab", "abc", "\U0001f600a", "Ünï", "", "none", "ab"], ["aaa"], ["x" * n for n in range(1, 30)] + ["ab", "a"], []):
        found = spark.createDataFrame([(w,) for w in words], "literal string")
        want = {k: (len(own), sum(t.count(w) for w in own)) for k, t in enumerate(texts) if t and (own := {w for w in words if w and w in t})}
        for most in (3, 1 << 20):
            rows = literals.counts(df, found, "k", "t", most).groupBy("k").agg(F.sum("n_literals").alias("a"), F.sum("n").alias("b")).collect()
            assert {r.k: (r.a, r.b) for r in rows} == want
    again = spark.createDataFrame([(1, "ab ab"), (1, "ab")], "k int, t string")  # each row of a key counts
    rows = literals.counts(again, spark.createDataFrame([("ab",)], "literal string"), "k", "t").collect()
    assert sorted((r.k, r.n_literals, r.n) for r in rows) == [(1, 1, 1), (1, 1, 2)]


def test_a_table_of_literals_finds_them_all():
    import numpy as np

    text = "".join(chr(97 + (k * k // 7 + k) % 5) for k in range(5000))
    own = sorted({text[k : k + 4] for k in range(0, 4997, 3)})
    held = literals._OfOneLength(literals._codes("".join(own)).reshape(-1, 4))
    start, which = held.find(literals._codes(text))
    assert [(s, own[w]) for s, w in zip(start.tolist(), which.tolist(), strict=True)] == [(k, text[k : k + 4]) for k in range(4997) if text[k : k + 4] in set(own)]
    same = literals._window_hashes(literals._codes("abcabc"), 3, 0)
    assert same[0] == same[3] and len(np.unique(same)) == 3
