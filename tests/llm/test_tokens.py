"""Operators 2, 3 and 6: laws of placement, exact tokens, no padding."""

import base64
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spandrel.llm import bpe, packing, sharding

tokenizers = pytest.importorskip("public_tokenizers")

PIECES = [" ", "  ", "\n", "\t", "a", "b", "é", "'s", "'re", "12", "漢字", "🙂", "\xa0", "　", "\x85", "\x1c", "_", "!!", "<|endoftext|>", "aaaaaaa", "ß", "Ⅷ", "²", "word", "don't", "x.com/a", "\x00"]


def strange(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices(PIECES, k=r.randint(0, 14))) for _ in range(n)] + ["a" * 20000, " " * 3000, "漢" * 5000, "\n" * 2000, "ab" * 9000]


def test_merges_are_exact():
    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    real = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.codec(path, tokenizers.PATTERN)
    for text in strange(3000, 1):
        ids = own.encode(text)
        assert ids.tolist() == real.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_any_bytes_of_a_piece_come_back():
    own = bpe.codec(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    r = random.Random(2)
    for _ in range(500):
        data = bytes(r.randrange(256) for _ in range(r.randrange(1, 30)))
        assert own.decode(np.array(own.piece(data))) == data


def test_encoding_rows(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "a b", "c"), (3, "a b", "c"), (None, "x" * 100000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in got) == sorted((t or "") for _, t, _ in rows)
    assert bpe.encode_documents(docs.limit(0), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).collect() == []


def test_ids_are_the_tokenizers(spark):
    own = packing.encoder(tokenizers.path("byte_bpe_50k.json"))
    for text in strange(3000, 3):
        assert own.encode(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(pieces, seq_len, documents):
    """documents: {doc_id: [ids, ...]}; every id is in one piece, sequences are gapless and need no padding."""
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p[5]].append((p[6], p[2]))
        by_doc[p[0]].append(p)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at == seq_len or (at < seq_len and at & (at - 1) == 0)
    for doc, texts in documents.items():
        got = Counter()
        for p in by_doc[doc]:
            got[np.frombuffer(p[7], "<u4").tobytes()] += 0
            assert zlib.crc32(p[7]) == p[3] and len(p[7]) == 4 * p[2]
        assert sum(p[2] for p in by_doc[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            parts = sorted(by_doc[doc], key=lambda p: p[1])
            assert b"".join(p[7] for p in parts) == np.array(texts[0], "<u4").tobytes()
            assert all(p[4] == len(texts[0]) for p in parts)


@pytest.mark.parametrize("most", [4096, 5])
def test_sum_of_squares_packing(monkeypatch, most):
    monkeypatch.setattr(packing, "MOST_OPEN", most)
    r = random.Random(4)
    packer, documents = packing.Packer(64, 0), {}
    for i in range(800):
        ids = [r.randrange(9) for _ in range(r.choice([1, 3, 31, 33, 40, 64, 65, 200, r.randint(1, 70)]))]
        documents[i] = [ids]
        packer.add(i, np.array(ids, "<u4"))
    packer.finish()
    rows = packer.rows()
    check_packing(rows, 64, documents)
    assert len(rows) < 800 * 3


def test_level_is_the_best():
    packer = packing.Packer(10, 0)
    r = random.Random(5)
    for _ in range(2000):
        s = r.randint(1, 9)
        n = packer.count.copy()
        options = []
        for level in range(0, 10):
            if level + s <= 10 and (level == 0 or n[level]):
                m = n.copy()
                m[level] -= level > 0
                if level + s < 10:
                    m[level + s] += 1
                options.append(int((m[1:10] ** 2).sum()))
        packer._place((0, 0, np.zeros(s, "<u4"), s))
        assert int((packer.count[1:10] ** 2).sum()) == min(options)


def test_packing_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "a b c " * 3000, 5), (3, "again", 5), (None, "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(2)
    got = packing.pack_documents(docs, tokenizers.path("byte_bpe_50k.json"), with_ids=True).collect()
    own = packing.encoder(tokenizers.path("byte_bpe_50k.json"))
    documents = defaultdict(list)
    for i, t, _ in rows:
        documents[i].append([*own.encode(t or "").tolist(), 1])
    check_packing([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset, bytes(r.ids)) for r in got], 2048, documents)
    assert packing.pack_documents(docs.limit(0), tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_shards(spark):
    rows = [(i, f"t{i}" * (i % 7), 1) for i in range(4000)] + [(None, None, 1), (7, "again", 1), (7, "again", 1), (14, "é", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 1.3 * 4004 / 16
    moved = sum(r.grown_shard == 16 for r in got) / len(got)
    assert abs(moved - 1 / 17) < 0.02
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(1, 0)}
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 14 and r.size == 3} == {(3, zlib.crc32("é".encode()))}
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert sharding.shard_documents(docs.limit(0)).collect() == []


def test_weights_confine_movement(spark):
    from pyspark.sql import functions as F

    tree = tuple((s // 4, s // 2, s, 1.0) for s in range(8))
    heavier = tuple((a, b, s, 3.0 if s == 5 else w) for a, b, s, w in tree)
    rows = spark.range(4000).select(sharding.place(F.col("id").cast("string"), tree).alias("x"), sharding.place(F.col("id").cast("string"), heavier).alias("y")).collect()
    moved = [(r.x, r.y) for r in rows if r.x != r.y]
    assert moved and all(y in (4, 5, 6, 7) for _, y in moved)
    counts = Counter(r.y for r in rows)
    assert counts[5] > 2 * counts[4]
