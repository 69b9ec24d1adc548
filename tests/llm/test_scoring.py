"""Operators 1 and 9: segments, the network's gradients, held-out accuracy, and odd texts."""

import contextlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.llm import language, toxicity


def maximal(scores):
    """Maximal scoring segments by their recursive definition: the best one, then what is left and right of it."""
    best, at = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for z in range(a, len(scores)):
            total += scores[z]
            if total > best + 1e-9:
                best, at = total, (a, z + 1)
    if at is None:
        return []
    a, z = at
    return maximal(scores[:a]) + [(a, z)] + [(x + z, y + z) for x, y in maximal(scores[z:])]


def test_segments_are_the_maximal_ones():
    r = random.Random(1)
    for _ in range(300):
        scores = [r.choice([-3, -2, -1, -1, 1, 2, 4]) + r.random() / 100 for _ in range(r.randrange(0, 14))]
        got = [(a, z) for a, z, _ in toxicity.segments(np.array(scores))]
        assert got == maximal(scores)


def texts(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(400)]
    bad = ["nasty", "vileness", "vilest", "grubby"]
    rows = []
    for i in range(n):
        w = r.choices(words, k=r.randint(20, 120))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(3, 6)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxic_documents_are_found(spark):
    rows = texts(900, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(toxicity.labelled_rows(docs, labels))
    odd = [(10_000, None), (10_001, ""), (10_002, "123 !!"), (10_003, "nasty " * 5000), (10_004, "ab " * 20000), (None, "x"), (10_003, "nasty")]
    every = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("score", F.lit(9))
    got = [(r.doc_id, r.score) for r in toxicity.score_documents(every, model).collect()]
    assert len(got) == 907 and all(0 <= s <= 1 for _, s in got)
    score = {i: s for i, s in got if i is not None and i < 900}
    held = [i for i, _, _ in rows if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(score[i] >= 0.7) == bool(rows[i][2]) for i in held]) > 0.97
    kept = toxicity.screen(docs, model)
    assert kept.columns == docs.columns and abs(kept.count() - 720) < 15


def test_scores_by_definition(spark):
    """Lambda, K and the surprise of a passage against their definitions, without bins or batches."""
    rows = texts(500, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs.join(labels, "doc_id"))
    n1 = n0 = 0
    tally = {}
    for _, t, y in rows:
        for f in {f for w in set(toxicity.WORD.findall(t)) for f in toxicity.features(w)}:
            own = tally.setdefault(f, [0, 0])
            own[0 if y else 1] += 1
            n1, n0 = n1 + bool(y), n0 + (not y)
    mass = toxicity.EQUAL * len(tally) + toxicity.PRIOR
    want = {}
    for f, (a, b) in tally.items():
        prior = toxicity.EQUAL + toxicity.PRIOR * (a + b) / (n1 + n0)
        y1, y0 = a + prior, b + prior
        odds = np.log(y1 / (n1 + mass - y1)) - np.log(y0 / (n0 + mass - y0))
        if a >= toxicity.LEAST_DOCS and odds >= 1 and odds / np.sqrt(1 / y1 + 1 / y0) >= toxicity.LEAST_Z:
            want[f] = min(toxicity.MOST_SCORE, odds)
    assert model.scores == pytest.approx(want)
    clean = [np.array([model.score(w) for w in toxicity.WORD.findall(t)]) for _, t, y in rows if not y]
    every = np.concatenate(clean)
    assert model.decay == 5.0 or np.exp(model.decay * every).mean() == pytest.approx(1, abs=0.02)
    high = sum(any(sum(s[a:z]) >= 1 for a, z in maximal(s.tolist())) for s in clean if (s > 0).any())
    assert model.rate == pytest.approx(max((high + 0.5) / (len(every) * np.exp(-model.decay)), 1e-6), rel=1e-3)
    for n, s in ((30, 2.0), (200, 9.0)):
        assert model.surprise(n, s) == pytest.approx(-np.log(-np.expm1(-model.rate * n * np.exp(-model.decay * s))), rel=1e-6)
    text = rows[0][1]
    n = len(toxicity.WORD.findall(text))
    each = [model.surprise(n, s) for _, _, s in model.passages(text)[1]]
    good = [e for e in each if e >= -np.log(toxicity.SIGNIFICANT)]
    x = [1.0, np.log1p(max(each)), np.log1p(sum(good)), np.log1p(len(good))]
    want = 1 / (1 + np.exp(-np.dot(model.weights, x)))
    assert toxicity.score_documents(docs.where("doc_id = 0"), model).first().score == pytest.approx(want)


def test_only_chosen_texts_are_shuffled(spark, tmp_path, monkeypatch):
    """Labels too many for a broadcast: what is shuffled to join them are ids and hashes, and the model is the same."""
    rows = texts(300, 8)
    odd = [(None, "nasty"), (5, None), (5, rows[5][1]), (5, "another nasty text"), (7_000, "no label")]
    spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(i, t, "s") for i, t in odd], "doc_id long, text string, h string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (6, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, labels = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    plans, durable = [], toxicity.durable

    def kept(df, name="t"):
        if name == "labelled":
            out = io.StringIO()
            with contextlib.redirect_stdout(out):
                df.explain("formatted")
            plans.append(out.getvalue())
        return durable(df, name)

    monkeypatch.setattr(toxicity, "durable", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        toxicity.op1_scoring_segments(spark, str(tmp_path))
        models = [toxicity.learn(docs, most, labels) for most in (60, 20_000)]
        assert len(plans) == 3 and "SortMergeJoin" in plans[0]
        for plan in plans:
            moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: (\w+\(\w*)", plan)
            assert len(moved) >= 3
            assert all(by == "hashpartitioning(text" for columns, by in moved if "text#" in columns)
        for most, model in zip((60, 20_000), models, strict=True):
            want = toxicity.learn(toxicity.labelled_rows(docs, labels), most)
            assert model.scores == want.scores and model.weights == pytest.approx(want.weights)
        assert models[1].scores
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_rows_teach_once(spark):
    rows = texts(300, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    often = docs.union(docs.limit(40)).union(spark.createDataFrame([(7, rows[7][1], rows[7][2])] * 500, docs.schema))
    a, b = toxicity.learn(docs), toxicity.learn(often)
    assert a.scores == b.scores and a.weights == pytest.approx(b.weights)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(toxicity.labelled_rows(docs, labels))
    assert toxicity.score_documents(docs, model).first().score < 0.7
    assert toxicity.score_documents(docs.limit(0), model).collect() == []


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    tagger = language.ByteTagger(["a", "b", "c"], hidden=4, seed=1)
    tagger.p = {k: v.astype("f8") for k, v in tagger.p.items()}
    words, labels = [b"hello", b"ab", b"zebra!"], np.array([0, 2, 1])

    def loss():
        codes, lengths = language.pad(words)
        live = np.arange(codes.shape[1]) < lengths[:, None]
        x = tagger.logits(codes, live)
        x = x - np.log(np.exp(x).sum(2, keepdims=True))
        return -(x[:, np.arange(3), labels] * live.T).sum() / live.sum()

    grads = tagger._gradients(words, labels)
    for name, value in tagger.p.items():
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in value.shape)
            if name == "x":
                at = (at[0], int(words[0][int(r.integers(0, 5))]), at[2])
            kept = value[at]
            value[at] = kept + 1e-5
            up = loss()
            value[at] = kept - 1e-5
            down = loss()
            value[at] = kept
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6), name


def test_windows_label_every_byte_once():
    texts = ["a", "é" * 300, "x y " * 500, "Ab" * 104, ""]
    held, own, first, last = language.windows(texts)
    for i, t in enumerate(texts):
        parts = [w[a:z] for w, o, a, z in zip(held, own, first, last, strict=True) if o == i]
        assert b"".join(parts) == t.lower().encode()
    assert max(map(len, held)) == language.CORE + 2 * language.CONTEXT


def plain_pass(p, d, data):
    """States of one direction, one byte at a time."""
    hid = p["u"].shape[1]
    state, out = np.zeros(hid), []
    for byte in data:
        given = p["x"][d, byte] + p["c"][d]
        gate = np.clip((given[: 2 * hid] + state @ p["u"][d][:, : 2 * hid]) / 4 + 0.5, 0, 1)
        z, r = gate[:hid], gate[hid:]
        new = np.clip(given[2 * hid :] + (r * state) @ p["u"][d][:, 2 * hid :], -1, 1)
        state = (1 - z) * state + z * new
        out.append(state)
    return out


def test_pooled_scores_by_a_plain_pass():
    r = random.Random(2)
    tagger = language.ByteTagger(["a", "b", "c"], hidden=5, seed=3)
    texts = ["Go", "".join(r.choices("abc éx1", k=700)), None, "12", "".join(r.choices("xyz ", k=208)), "ß" * 130]
    lang, score = language.predict(tagger, texts)
    assert lang[2] == lang[3] == "und" and score[2] == score[3] == 0.0
    p = {k: v.astype("f8") for k, v in tagger.p.items()}
    for i in (0, 1, 4, 5):
        sums = np.zeros(3)
        data = texts[i].lower().encode()
        for a in range(0, len(data), language.CORE):
            start = max(0, a - language.CONTEXT)
            part = data[start : a + language.CORE + language.CONTEXT]
            ahead, back = plain_pass(p, 0, part), plain_pass(p, 1, part[::-1])[::-1]
            for k in range(a - start, min(a + language.CORE, len(data)) - start):
                x = ahead[k] @ p["w"][0] + back[k] @ p["w"][1] + p["o"]
                sums += x - np.log(np.exp(x).sum())
        share = np.exp((sums - sums.max()) / language.TEMPERATURE)
        assert lang[i] == "abc"[int(sums.argmax())] and score[i] == pytest.approx(share.max() / share.sum(), abs=1e-4)


def test_the_sample_is_bounded(spark):
    rows = [(1, "aa " * 50, "aa")] * 40 + [(i, "bb " * 50, "bb") for i in range(2, 30)] + [(99, "cc " * 5000, "cc"), (None, "dd dd", "dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tagger = language.train_tagger(docs, most_bytes=6000)
    assert tagger.languages == ["aa", "bb", "dd"]
    pred, _ = language.predict(tagger, ["aa aa aa", "bb bb bb"])
    assert pred == ["aa", "bb"]


def test_languages_of_held_out_documents(spark):
    r = random.Random(5)
    syllables = {"aa": ["th", "er", "on", "ing"], "bb": ["sch", "ung", "ei", "tz"], "cc": ["ción", "os", "que", "rr"]}
    rows = []
    for i in range(600):
        lang = r.choice(list(syllables))
        rows.append((i, " ".join("".join(r.choices(syllables[lang], k=r.randint(1, 3))) for _ in range(r.randint(3, 40))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tagger = language.train_tagger(docs.where(~language.held_out()))
    odd = [(1000, None, None), (1001, "", "aa"), (1002, "123 --", "aa"), (1003, "schungei" * 4000, "bb"), (None, "therон", None), (1003, "ción", "cc")]
    got = language.identify(docs.union(spark.createDataFrame(odd, docs.schema)), tagger).collect()
    pred = {x.doc_id: x.lang_pred for x in got if x.doc_id is not None and x.doc_id < 600}
    held = [i for i, _, _ in rows if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert np.mean([pred[i] == rows[i][2] for i in held]) > 0.97
    und = {x.doc_id: (x.lang_pred, x.score) for x in got if x.doc_id in (1000, 1001, 1002)}
    assert set(und.values()) == {("und", 0.0)}
    assert sorted(x.lang_pred for x in got if x.doc_id == 1003) == ["bb", "cc"]
    kept = language.screen(docs.union(spark.createDataFrame(odd, docs.schema)), tagger)
    assert kept.columns == docs.columns and kept.where("doc_id in (1000, 1001, 1002)").count() == 0
    assert kept.where("lang is null").count() == 0


def test_no_language_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    tagger = language.train_tagger(docs)
    assert tagger is None
    row = language.identify(docs, tagger).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)
