"""Operator 11: patterns against plain regular expressions, disclosure against counts by definition."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spandrel.llm import sanitise

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(PHONE, text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab_%+.@-é 0125() \n", max_size=60))
def test_patterns_are_those_of_the_expressions(text):
    assert sanitise.base_spans(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4381893557741609", "4381 8935 5774 1609", "4381-8935", "1.2.3.4", "256.1.1.1", "001.2.3.0255", "a@b.c", "a@b.c_d@e.f", "@", "+1 (743) 555-3824", "+", " ", ".", "é", "x", "-", "a..b%@x-.y.", "1.2.3.4.5.6.7.8"]), max_size=12))
def test_patterns_on_pieces(parts):
    text = "".join(parts)
    assert sanitise.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    n = 400_000
    for text in ("a" * n, "1" * n, "1." * n, "+1" + " " * n, "a@" * n, "." * n + "@", "1-" * n + "x", "a" * n + "@b" + ".c" * n):
        sanitise.base_spans(text)
    assert sanitise.base_spans("a" * n + "@b.c") == [("email", 0, n + 4)]


def documents(seed=2):
    r = random.Random(seed)
    common = [f"common{k}ly" for k in range(300)]
    filler = lambda k: " ".join(r.choice(common) for _ in range(k))
    rows = []
    for k in range(12):  # Zorvathian stands by one address wherever it stands, and in different surroundings
        rows.append(f"{filler(20)} Zorvathian, {filler(2)} zed.ann@example.org {filler(25)}")
    for k in range(18):  # each ward is seen once, but all are that man's
        rows.append(f"{filler(15)} ward{k + 10} {filler(1)} +1 743 555-3824 {filler(20)}")
    for k in range(30):  # copies of a passage, some with a word changed
        words = ["once", "printed", "quibbleton", "wrote", "to", "old@example.net", "and", "waited", "for", "snarkling", "answers", "daily"]
        if k % 3:
            words[r.randrange(12) if k % 3 == 1 else 11] = f"changed{k}"
        rows.append(" ".join(words))
    rows += [filler(40) for _ in range(60)]
    rows += ["Zorvathian alone, and a word", "", None, "10.0.0.1 10.0.0.1"]
    return list(enumerate(rows))


def told(rows):
    """{form: the greatest share} by definition."""
    windows, near, total, n = defaultdict(Counter), Counter(), 0, Counter()
    content = {}
    for _, text in rows:
        words = re.findall(r"[^\x20\t-\r]+", text or "")
        total += len(words)
        for w in words:
            n.update(sanitise.ladder(w))
        for e, win, k, terms in sanitise.mentions(text or ""):
            windows[e][win] += 1
            near[e] += k
            content[win] = terms
    out: dict = {}
    for e, wins in windows.items():
        if len(wins) < 3:
            continue
        by, both = defaultdict(Counter), Counter()
        for win, times in wins.items():
            for form, m, context in content[win]:
                by[form][context] += 1
                both[form] += m * times
        for form, contexts in by.items():
            c = sum(contexts.values())
            if c / max(contexts.values()) < 3:
                continue
            share = math.log2(min(both[form], n[form]) * total / (n[form] * near[e])) / math.log2(total / near[e])
            if share >= sanitise.DISCLOSURE:
                out[form] = max(share, out.get(form, -9))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, source string, entity int")


def test_disclosure_by_definition(spark):
    rows = documents()
    got = {r.form: r.disclosure for r in sanitise.disclosing(frame(spark, rows)).collect()}
    want = told(rows)
    assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], rel=1e-9) for f in got)
    assert "0:zorvathian" in got and "1:ward##" in got and "0:ward12" not in got
    assert not any("quibbleton" in f or "snarkling" in f or "common" in f for f in got)


def test_spans_and_texts(spark):
    rows = documents()
    df = frame(spark, rows)
    revealing = sanitise.disclosing(df)
    forms = {r.form for r in revealing.collect()}
    clean = {r.doc_id: r for r in sanitise.sanitise(df, revealing).collect()}
    assert len(clean) == len(rows)
    for i, text in rows:
        text = text or ""
        assert [tuple(s) for s in clean[i].base] == plain(text)
        want = []
        for m in re.finditer(r"[^\x20\t-\r]+", text):
            ladder = sanitise.ladder(m[0])
            hit = [k for k, f in enumerate(ladder) if f in forms]
            core = m[0].strip(sanitise._EDGES)
            if hit and not any(a < m.end() and m.start() < z for _, a, z in plain(text)):
                at = m.start() + m[0].index(core)
                rest = ladder[hit[-1] + 1] if hit[-1] + 1 < len(ladder) else ""
                want.append((at, at + len(core), rest[2:] + ("*" if rest[:1] == "2" else "")))
        assert [tuple(s) for s in clean[i].terms] == want
        assert "@" not in clean[i].text and "Zorvathian" not in clean[i].text
    assert clean[0].text.count("<EMAIL>") == 1 and clean[30].text == rows[30][1].replace("old@example.net", "<EMAIL>")
    assert clean[len(rows) - 4].terms[0]["start"] == 0  # a text that does not name the entity


def test_only_words_that_may_tell_are_taken_apart(spark, monkeypatch):
    """The filter is asked for all words of a batch at once: no word goes missing, and few others come along."""
    monkeypatch.setattr(sanitise, "SLICE", 64)  # many slices, and words that are longer than one
    r = random.Random(3)
    odd = ["ΑΒΣ'", "ΣΑΣ.", "İİİİİİİ,", "«Eine»", "Ward12", "ward13", "WARD124", "x\x1cy\x85z", "...", "ab", "é" * 7, "zorvathian", "Z" * 70, "zz" * 70]
    words = odd + ["".join(r.choices("abcdefgh", k=r.randint(1, 12))) for _ in range(5000)]
    texts = [None, "", " \t\n", *(f" {' '.join(words[k : k + 40])}\r\v\f\n" for k in range(0, len(words), 40))]
    forms = ["0:αβς", "0:" + "İİİİİİİ".lower(), "0:eine", "1:ward##", "2:zorv", "2:éééé", "0:" + "zz" * 70, "2:abca"]
    known = sanitise.Filter.of(spark.createDataFrame([(f,) for f in forms], "form string"))
    got, of = sanitise._words(pa.array(texts, pa.string()))
    assert list(zip(of.tolist(), got.to_pylist(), strict=True)) == [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[^\x20\t-\r]+", t or "")]
    passed = {w for w, x in zip(got.to_pylist(), known.among(got), strict=True) if x}
    need = {w for w in words if not set(forms).isdisjoint(sanitise.ladder(w))}
    assert {"ΑΒΣ'", "İİİİİİİ,", "«Eine»", "Ward12", "ward13", "é" * 7, "zorvathian", "zz" * 70} <= need <= passed
    assert len(passed - need) <= 3
    assert sanitise.Filter.of(spark.createDataFrame([], "form string")) is None


def test_odd_tables(spark):
    rows = [(None, "a@b.cd x"), (1, None), (1, None), (2, ""), (2, "plain words only"), (None, "a@b.cd x")]
    got = sanitise.spans(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, len(r.base), len(r.terms)) for r in got) == [(False, 0, 0)] * 4 + [(True, 1, 0)] * 2
    assert sanitise.spans(frame(spark, rows).limit(0)).collect() == []
    assert sanitise.disclosing(frame(spark, rows)).collect() == []


def test_overlaps_are_replaced_once():
    base = [{"kind": "card", "start": 1, "end": 17}, {"kind": "phone", "start": 0, "end": 12}]
    assert sanitise.replaced("+4381893557741609 x y", base, [{"start": 18, "end": 19, "instead": "z*"}]) == "<PHONE> z* y"


def test_query(spark, tmp_path):
    rows = documents()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sanitise.op11_disclosure_sanitiser(spark, str(tmp_path)).collect()}
    for i, text in rows:
        own = plain(text or "")
        named = ",".join(f"{k}:{s}:{e}" for k, s, e in own)
        n = Counter(k for k, _, _ in own)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert got[i].base_sha256 == hashlib.sha256(named.encode()).hexdigest() and got[i].spans.startswith(named)
        assert got[i].spans.count("term:") == got[i].n_term and ",," not in got[i].spans and got[i].spans.strip(",") == got[i].spans
    assert got[0].n_term == 1
