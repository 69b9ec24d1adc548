"""Operator 12 against a dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from spandrel.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth string, hi long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "other", 3) for r in rows], SCHEMA)


def brute(rows):
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", (text or "")[:64], hashlib.sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(r, t) for _, r, _, _, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + v[h:]
    nodes: dict = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = set()
    kids: dict = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(made[c]) == len(p))
        out.add((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(below), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def sample(n=90, seed=4):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), -3, -7, -10]:
        if c % 11 == 7:
            continue
        length = r.choice([1, 2, 3, 9, 14])
        rows += [(c, t, r.choice(["user", "assistant"]) if t % 3 else "user", "é" * (t % 4) + r.choice("ab")) for t in range(length)]
    rows += [(200 + k, t, "user", f"same {t}") for k in range(0, 40, 5) for t in range(12)]  # copies
    rows += [(300, t, "user", f"long {t}") for t in range(150)] + [(305, t, "user", f"long {t}") for t in range(140)]
    rows += [(None, 1, "user", "x"), (400, None, None, None), (400, None, "", ""), (400, 3, "user", "z"), (400, 3, "user", "a"), (400, 3, "system", None), (400, 3, "user", "a")]
    return rows


@pytest.mark.parametrize("bin_turns", [50_000, 20])
def test_by_definition(spark, bin_turns):
    rows = sample()
    assert found(prefixes.tries(frame(spark, rows), bin_turns=bin_turns)) == brute(rows)


def test_one_conversation_over_all_ranges(spark):
    rows = [(5, t, "user", str(t % 7)) for t in range(700)] + [(10, t, "user", str(t % 7)) for t in range(500)] + [(11, 0, "user", "x")]
    want = brute(rows)
    assert found(prefixes.tries(frame(spark, rows))) == want
    assert found(prefixes.tries(frame(spark, rows), bin_turns=100)) == want


def test_nothing_and_turnless(spark):
    assert prefixes.tries(frame(spark, []).limit(0)).collect() == []
    assert prefixes.tries(frame(spark, [(None, 1, "a", "b")])).collect() == []
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4)]  # no conversation 0, so those that take a turn have none
    assert any(zlib.crc32(str(c).encode()) % 9 for c in (1, 2, 3, 4))
    assert found(prefixes.tries(frame(spark, rows))) == brute(rows)


def test_bits():
    trie = prefixes.Louds(__import__("numpy").array([2, 0, 3, 0, 1, 0, 0]))
    assert "".join(map(str, trie.bits.astype(int))) == "1100111001000"
    assert trie.parent.tolist() == [0, 0, 2, 2, 2, 4] and trie.children.tolist() == [2, 0, 3, 0, 1, 0, 0]


def test_a_long_text_is_one_turn(spark):
    rows = [(0, 0, "user", "y" * 3_000_000), (5, 0, "user", "y" * 3_000_000), (5, 1, "user", "z")]
    assert found(prefixes.tries(frame(spark, rows))) == brute(rows)
