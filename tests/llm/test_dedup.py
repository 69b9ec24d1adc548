"""Operators 4, 8 and 10 against plain versions, with the cases that break such things."""

import glob
import random

import numpy as np
import pytest

from spandrel.llm import common, fingerprints, fragments, jaccard, suffixes
from tests.llm import brute


def corpus(seed: int) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé漢", k=r.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choices(words, k=n))
    shared = text(60)
    base = text(120)
    rows: list[tuple[int | None, str | None]] = [(i, text(r.randint(0, 90))) for i in range(40)]
    rows += [(40 + i, f"{text(r.randint(0, 30))} {shared} {text(r.randint(0, 30))}") for i in range(15)]
    rows += [(60 + i, base) for i in range(6)]
    for i in range(25):
        w = base.split()
        for _ in range(r.choice([1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((70 + i, " ".join(w)))
    rows += [(100, "word " * 300), (101, "word " * 300), (102, "x" * 400), (103, "x" * 400), (104, "xy" * 100)]
    rows += [(110, None), (111, ""), (112, "  \n\t "), (113, "one"), (114, "one"), (115, "One two"), (116, "one  TWO")]
    rows += [(3, rows[3][1]), (5, shared), (None, shared), (None, base)]
    rows += [(120, f"{shared}\n{shared}"), (121, shared.upper()), (122, text(3000) + shared)]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, n_words int, chunk string").repartition(3)


@pytest.mark.parametrize(("hot", "chunk"), [(500, 4 << 20), (0, 4 << 20), (500, 3000), (1, 3000)])
def test_bytes_of_smaller_documents(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(fragments.to_chunks, "__defaults__", ("text", chunk, 0))
    rows = corpus(1)
    got = suffixes.remove_repeats(frame(spark, rows), hot=hot).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=repr) == sorted(brute.removed_bytes(rows, 50), key=repr)


def test_bytes_of_smaller_documents_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(fragments.to_chunks, "__defaults__", ("text", 3000, 0))
    rows, names, made = corpus(4), [], suffixes.durable
    monkeypatch.setattr(suffixes, "durable", lambda df, name: names.append(name) or made(df, name))
    left = lambda: set(glob.glob(common.shared_dir(spark).removeprefix("file://") + "/entries-*"))
    before = left()
    got = suffixes.remove_repeats(frame(spark, rows), least_buckets=1).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=repr) == sorted(brute.removed_bytes(rows, 50), key=repr)
    assert names == ["found", *["judged"] * suffixes.ROUNDS, "kept"] and left() == before


@pytest.mark.parametrize(("hot", "chunk", "batches"), [(500, 4 << 20, 1), (500, 3000, 3), (0, 3000, 2), (500, 3000, 5)])
def test_passages_that_repeat(spark, monkeypatch, hot, chunk, batches):
    monkeypatch.setattr(fragments.to_chunks, "__defaults__", ("text", chunk, 0))
    rows = corpus(2)
    got = fingerprints.remove_passages(frame(spark, rows), hot=hot, batches=batches, keep=("chunk", "n_words")).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=repr) == sorted(brute.removed_words(rows, 35), key=repr)
    assert {r.carried.chunk for r in got} == {"z"}


@pytest.mark.parametrize("long", [64, 2])
def test_links_and_components(spark, long):
    rows = corpus(3)
    got = jaccard.link_documents(frame(spark, rows), long=long).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == sorted(brute.linked(rows), key=repr)


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("doc_id < 0")
    assert suffixes.remove_repeats(none).collect() == []
    assert fingerprints.remove_passages(none).collect() == []
    assert jaccard.link_documents(none).collect() == []
    blank = frame(spark, [(1, None), (2, ""), (3, " ")])
    assert sorted((r.doc_id, r.n_removed) for r in suffixes.remove_repeats(blank).collect()) == [(1, 0), (2, 0), (3, 0)]
    assert sorted((r.doc_id, r.n_words) for r in fingerprints.remove_passages(blank).collect()) == [(1, 0), (2, 0), (3, 0)]
    assert sorted((r.doc_id, r.component_id) for r in jaccard.link_documents(blank).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_deep_shallow_orders_like_sorting():
    r = random.Random(4)
    text = bytes(r.choice(b"ab") for _ in range(600)) + b"ab" * 100
    starts = list(range(len(text) - 50))
    order, begins = suffixes.deep_shallow(text, __import__("numpy").array(starts), 50)
    strings = [text[i : i + 50] for i in order.tolist()]
    assert strings == sorted(text[i : i + 50] for i in starts)
    assert [bool(b) for b in begins] == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


def test_index_is_compacted(spark):
    chunks = fragments.to_chunks(frame(spark, corpus(5)), chunk_bytes=2000)
    index = fingerprints.FingerprintIndex(spark, None, fragments.Units(35, 8, True), 4)
    for i in range(4):
        index.append(chunks.where(f"pmod(chunk, 4) = {i}"))
    assert [level for level, _ in index.runs] == [2]
    run = index.runs[0][1].collect()
    assert len({r.bucket for r in run}) == len(run)
    for r in run:
        h = fragments.read48(r.hashes).tolist()
        assert h == sorted(set(h))
    index.delete()


def test_index_is_opened_again(spark, tmp_path, monkeypatch):
    """Three batches, each by an index of its own over the same folder, against all rows at once."""
    monkeypatch.setattr(fragments.to_chunks, "__defaults__", ("text", 3000, 0))
    rows = corpus(8)
    path, seen = f"file://{tmp_path}/index", []
    for i in range(3):
        batch = rows[i::3]
        seen += batch
        index = fingerprints.FingerprintIndex(spark.newSession(), path, buckets=8, fanin=3 if i == 0 else 2)
        assert len(index.state["chunks"]) == i
        got = fingerprints.remove_passages(frame(spark, batch), index=index, keep=("chunk",)).collect()
        want = brute.removed_words(seen, 35)[-len(batch) :]
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=repr) == sorted(want, key=repr)
    assert [level for level, _ in index.state["runs"]] == [1]  # the manifest's fan-in holds
    none = fingerprints.remove_passages(frame(spark, rows[:1]).limit(0), index=fingerprints.FingerprintIndex(spark, path))
    assert none.collect() == []


def test_manifests_outlive_a_crash(spark, tmp_path):
    path, folder = f"file://{tmp_path}/index", tmp_path / "index"
    index = fingerprints.FingerprintIndex(spark, path, buckets=4, fanin=9)
    index.append(fragments.to_chunks(frame(spark, corpus(1)), salt=1))
    (before,) = [p for p in folder.iterdir() if p.name.startswith("manifest-")]
    held = before.read_bytes()
    index.append(fragments.to_chunks(frame(spark, corpus(2)), salt=2))
    after = [p.name for p in folder.iterdir() if p.name.startswith("manifest-")]
    assert after == ["manifest-2.json"] and not list(folder.glob("draft-*"))
    before.write_bytes(held)  # as if the writer had gone before it deleted the older one
    (folder / "draft-x").write_text("{")
    again = fingerprints.FingerprintIndex(spark, path)
    assert len(again.state["runs"]) == 2 and again.state["version"] == 2
    names = list(again.held.values()) + [again._run(again.state["runs"][0][1]) and again.held[again.state["runs"][0][1]]]
    assert spark.catalog.tableExists(names[-1])
    again.close()
    assert not spark.catalog.tableExists(names[-1]) and folder.exists()
    for p in folder.glob("manifest-*"):
        p.unlink()
    with pytest.raises(OSError, match="no manifest"):
        fingerprints.FingerprintIndex(spark, path)
    index.delete()
    assert not folder.exists()


def test_runs_meet_a_batch_without_a_shuffle(spark):
    index = fingerprints.FingerprintIndex(spark, None, buckets=4, fanin=9)
    for seed in (1, 2):
        index.append(fragments.to_chunks(frame(spark, corpus(seed)), salt=seed))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = fingerprints.beside(spark.range(4).withColumnRenamed("id", "bucket"), [run for _, run in index.runs])
        plan = rows._jdf.queryExecution().executedPlan().toString()
        plan = plan[plan.index("== Initial Plan") :] if "== Initial Plan" in plan else plan
        assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 2
        assert rows.count() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_anchors_of_many_chunks(spark, monkeypatch):
    """More chunks than HOT_CHUNKS, so that what most of them hold is compared window by window."""
    monkeypatch.setattr(fragments.to_chunks, "__defaults__", ("text", 1, 0))
    r = random.Random(9)
    shared = " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(45))
    rows = [(i, f"{r.random()} {shared} {r.random()}" if i % 20 else f"only {r.random()}") for i in range(560)]
    df = frame(spark, rows).coalesce(2)
    assert fragments.to_chunks(df).count() > fragments.HOT_CHUNKS
    got = suffixes.remove_repeats(df).collect()
    assert sorted([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got]) == sorted(brute.removed_bytes(rows, 50))
    got = fingerprints.remove_passages(df).collect()
    assert sorted([(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got]) == sorted(brute.removed_words(rows, 35))


def test_slices_of_windows(monkeypatch):
    weights, keys = np.array([3, 1, 1, 9, 1, 2, 2, 2, 1]), np.array([1, 1, 2, 3, 3, 4, 4, 4, 5])
    for most in range(1, 30):
        for joint in (None, keys):
            got = list(fragments.slices(weights, most, joint))
            assert [a for a, _ in got] + [9] == [0] + [z for _, z in got]
            for a, z in got:
                assert joint is None or z == 9 or joint[z - 1] != joint[z]
                assert weights[a:z].sum() <= most or z == a + 1 or len(set(keys[a:z])) == 1
    r = random.Random(3)
    texts = sorted({"".join(r.choices("ab", k=r.randint(50, 90))).encode() for _ in range(40)} | {b"a" * 60 + b"b" * 30})
    sizes, ranks = np.array([len(t) - 49 for t in texts]), np.arange(len(texts))[::-1].copy()
    whole = suffixes._LeastRank(50)(texts, sizes, ranks)
    assert (suffixes._LeastRank(50, most=37)(texts, sizes, ranks) == whole).all()
