"""The pipeline's stages, each by itself, and all of them."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from spandrel.llm import language, toxicity  # noqa: E402
from spandrel.llm.common import components, table  # noqa: E402
from tests.llm import brute  # noqa: E402

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_stages_keep_the_columns(spark):
    docs = table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score string, passages int, lang_pred string, component_id string, carried string, n_removed string, rest string, kept_text string, n_words string"


def odd(spark, docs):
    """documents with null ids, null, empty and very long texts, repeated rows, and columns named like the stages' own."""
    more = [(None, "a null id with words of its own", "en", "s", 1), (None, None, None, None, None), (70_001, None, "en", "s", 0), (70_002, "", None, "s", 0), (70_003, "1234 !!", "en", "s", 7)]
    more += [(70_004, "word and another one " * 30_000, "en", "s", 5)] + [(70_005, "said twice in two rows of one id", "en", s, 1) for s in "bab"]
    rows = docs.limit(60).union(spark.createDataFrame(more, docs.schema))
    for c in CLASHING.split(", ")[5:]:
        name, kind = c.split()
        rows = rows.withColumn(name, F.lit(7).cast(kind))
    return rows


def test_odd_rows(spark):
    docs = odd(spark, table(spark, DATA, "documents"))
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.schema.fieldNames() == docs.schema.fieldNames()
        got = out.collect()
        assert {(r.score, r.passages, r.component_id, r.carried, r.rest) for r in got} == {("7", 7, "7", "7", "7")}
        ids = sorted((r.doc_id for r in got if r.doc_id is not None and r.doc_id > 70_000))
        nulls = sum(r.doc_id is None for r in got)
        if name == "toxicity":
            assert ids == [70_001, 70_002, 70_003, 70_004, 70_005, 70_005, 70_005] and nulls == 2
        if name == "language_id":
            assert not {70_001, 70_002, 70_003} & set(ids) and nulls == 1
            assert all(r.lang for r in got)
        if name == "ngram_jaccard":
            assert ids == [70_001, 70_002, 70_003, 70_004, 70_005] and nulls == 2
            assert [r.source for r in got if r.doc_id == 70_005] == ["a"]
        if name == "substring_dedup":
            assert len(got) == len(rows) and {r.text for r in got if r.doc_id == 70_001} == {None}
            long = next(r for r in got if r.doc_id == 70_004)
            assert long.text == "" and long.n_chars == 0
    pieces = corpus_pipeline.packing_stage(spark, docs, DATA).collect()
    assert sum(r.length for r in pieces if r.doc_id in (70_001, 70_002)) == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).collect() == []


def test_learned_stages_by_plain_versions(spark):
    """Toxicity, language and packing keep what the operators' own functions say, text by text."""
    docs = table(spark, DATA, "documents")
    rows = docs.collect()
    model = toxicity.learn(toxicity.labelled_rows(docs, table(spark, DATA, "labels")))
    stays = [r.doc_id for r in rows if model.probability(*model.summary(r.text)[:3]) < toxicity.REJECT]
    assert sorted(r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, DATA).collect()) == sorted(stays)
    tagger = language.train_tagger(docs.where(~language.held_out()))
    lang, score = language.predict(tagger, [r.text for r in rows])
    stays = [r.doc_id for r, k, s in zip(rows, lang, score, strict=True) if k != "und" and s >= language.LEAST]
    assert sorted(r.doc_id for r in corpus_pipeline.language_stage(spark, docs, DATA).collect()) == sorted(stays)
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {r.doc_id: len(encode.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows}
    whole, sequences = {}, {}
    for r in corpus_pipeline.packing_stage(spark, docs, DATA).collect():
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert whole == size
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_near_copies_leave_one(spark):
    docs = table(spark, DATA, "documents")
    want = brute.linked([(r.doc_id, r.text) for r in docs.collect()])
    out = corpus_pipeline.near_copy_stage(spark, docs, DATA)
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _, c in want if i == c)
    twice = docs.limit(20).union(docs.limit(20))
    assert corpus_pipeline.near_copy_stage(spark, twice, DATA).count() == corpus_pipeline.near_copy_stage(spark, docs.limit(20), DATA).count()


def test_passages_go(spark):
    docs = table(spark, DATA, "documents")
    want = {i: gone for i, _, gone, _ in brute.removed_words([(r.doc_id, r.text) for r in docs.collect()], 35)}
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in corpus_pipeline.passage_stage(spark, docs, DATA).collect():
        assert r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) == (want[r.doc_id] == 0)


def test_whole_pipeline(spark):
    got = corpus_pipeline.run(spark, DATA)
    rows = got.collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in table(spark, DATA, "documents").select("doc_id").collect()}
    assert corpus_pipeline.ORACLE_SQL is None


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (2000, 2000), (5000, 1000)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and got[5000] == got[1001] == 1000 and 2000 not in got
