"""Byte strings that repeat from smaller documents, by deep-shallow suffix sorting (operator 4)."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm import fragments
from spandrel.llm.common import durable, forget, table

LENGTH, GRAM = 50, 20
#: Suffixes are sorted by multikey quicksort to this depth, in keys of eight bytes; ties go to blind tries.
SHALLOW = 24
UNRANKED = np.iinfo(np.int64).max
#: A table of some size is worked through in so many rounds.
ROUNDS = 4
#: Windows that are sorted at a time, at about 100 bytes of memory each.
WINDOWS = 1 << 19


class BlindTrie:
    """A Patricia trie over strings of one length that keeps only the places where they part.

    A string is inserted by a blind descent, which looks at the branching places alone, one comparison with the
    leaf that it ends at, and a second descent to the place where the two differ. Equal strings share a leaf.
    """

    def __init__(self, text: bytes, depth: int, length: int):
        self.text, self.depth, self.length, self.root = text, depth, length, None

    def insert(self, at: int) -> None:
        text, length = self.text, self.length
        if self.root is None:
            self.root = [at]
            return
        node = self.root
        while isinstance(node, tuple):
            place, arms = node
            node = arms.get(text[at + place])
            if node is None:
                node = next(iter(arms.values()))
                while isinstance(node, tuple):
                    node = next(iter(node[1].values()))
        other = node[0]
        if text[at + self.depth : at + length] == text[other + self.depth : other + length]:
            differ = length
        else:
            differ = self.depth
            while text[at + differ] == text[other + differ]:
                differ += 1
        if differ == length:
            node.append(at)
            return
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < differ:
            above, node = node, node[1][text[at + node[0]]]
        if isinstance(node, tuple) and node[0] == differ:
            node[1][text[at + differ]] = [at]
            return
        new = (differ, {text[other + differ]: node, text[at + differ]: [at]})
        if above is None:
            self.root = new
        else:
            above[1][text[at + above[0]]] = new

    def leaves(self) -> list[list[int]]:
        """The groups of equal strings, in order."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.append(node)
        return out


def deep_shallow(text: bytes, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The starts sorted by their first `length` bytes, and for each whether it begins a new group of equals.

    Multikey quicksort, its keys eight bytes at a time, parts all groups together until the shallow depth;
    each group that is still tied there, whose members share a long prefix, is ordered by a blind trie.
    """
    n = len(starts)
    raw = np.frombuffer(text + bytes(8), np.uint8)
    order, group = np.asarray(starts), np.zeros(n, np.int64)
    for depth in range(0, min(shallow, length) // 8 * 8, 8):
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | raw[order + depth + i]
        by = np.lexsort((key, group))
        order, group, key = order[by], group[by], key[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        group = np.cumsum(new) - 1
    begins = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
    edges = np.concatenate([np.flatnonzero(begins), [n]])
    tied = np.flatnonzero(np.diff(edges) > 1)
    order = order.copy()
    for k in tied.tolist():
        a, z = int(edges[k]), int(edges[k + 1])
        trie = BlindTrie(text, min(shallow, length) // 8 * 8, length)
        for at in order[a:z].tolist():
            trie.insert(at)
        for leaf in trie.leaves():
            order[a : a + len(leaf)] = leaf
            begins[a] = True
            begins[a + 1 : a + len(leaf)] = False
            a += len(leaf)
    return order, begins


class _LeastRank:
    """Of each window the least rank of all documents that hold it.

    More windows than `most`, which one anchor's very many contexts can be, are sorted class by class of their
    hashed contents: equal windows are of one class.
    """

    combine, within = "least", False

    def __init__(self, length: int, most: int = WINDOWS):
        self.length, self.most = length, most

    def __call__(self, texts: list[bytes], sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = fragments.expand(np.cumsum(lengths) - lengths, sizes)
        values, text = np.repeat(ranks, sizes), b"".join(texts)
        if len(starts) <= self.most:
            return self._least(text, starts, values)
        classes = -(-len(starts) // self.most)
        kind = self._classes(text, classes)[starts]
        out = np.empty_like(values)
        for c in range(classes):
            own = np.flatnonzero(kind == c)
            out[own] = self._least(text, starts[own], values[own])
        return out

    def _classes(self, text: bytes, classes: int) -> np.ndarray:
        """Of the string that starts at each place its class."""
        h = fragments.Units(self.length, self.length, words=False).grams(np.frombuffer(text, np.uint8))
        return ((h >> np.uint64(32)) % np.uint64(classes)).astype(np.int32)

    def _least(self, text: bytes, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(starts):
            return values
        order, begins = deep_shallow(text, starts, self.length)
        at = np.searchsorted(starts, order)  # starts rise
        least = np.minimum.reduceat(values[at], np.flatnonzero(begins))
        out = np.empty_like(values)
        out[at] = least[np.cumsum(begins) - 1]
        return out


def _rank(t: pa.Table) -> np.ndarray:
    """doc_ids; a null one is larger than all others."""
    return np.array([UNRANKED if x is None else x for x in t.column("doc_id").to_pylist()], np.int64)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = fragments.HOT_CHUNKS, least_buckets: int = fragments.LEAST_BUCKETS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256 of every row of docs (doc_id, text).

    A byte goes if a string of `length` bytes over it also starts in a document with a smaller doc_id; all is
    judged on the input. Texts are UTF-8, a null text is empty, matches never cross documents. A null doc_id is
    larger than any other; rows of the same doc_id are not smaller than each other. An empty table gives an
    empty result; other columns are not looked at.

    Chunks send their entries, and buckets judge them, in rounds once there are more than least_buckets of them: what is shuffled is
    on disk beside what is written, and of it only a round's part at a time.
    """
    units = fragments.Units(length, gram, words=False)
    chunks = fragments.to_chunks(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"))
    buckets = fragments.n_buckets(chunks)
    rounds = ROUNDS if buckets > least_buckets else 1
    turn = lambda column, r: F.pmod(F.xxhash64(column), F.lit(rounds)) == r
    found = durable(fragments.find_repeated(chunks, units, buckets, "text", twice_within=False, hot=hot), "found")
    parts = [fragments.entries(chunks.where(turn("chunk", r)), found.where(turn("chunk", r)), units, buckets, "text", _rank) for r in range(rounds)]
    forget(found)
    entries = reduce(DataFrame.union, parts)
    judged = reduce(DataFrame.union, [durable(fragments.judge(entries.where(turn("bucket", r)), _LeastRank(length)), "judged") for r in range(rounds)])
    sent = durable(entries.where("bucket = -1"), "kept")
    for part in parts:
        forget(part)

    def finish(t: pa.Table, own: list[bytes], masks: list[np.ndarray]):
        n, gone, spans, kept, sha = [], [], [], [], []
        for text, mask in zip(own, masks, strict=True):
            left = np.frombuffer(text, np.uint8)[~mask].tobytes()
            n.append(len(text))
            gone.append(int(mask.sum()))
            spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
            kept.append(left)
            sha.append(hashlib.sha256(left).hexdigest())
        for a in range(0, len(own), 200):
            z = a + 200
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.column("doc_id").to_pylist()[a:z], pa.int64()), pa.array(n[a:z], pa.int64()), pa.array(gone[a:z], pa.int64()), pa.array(spans[a:z], pa.int64()), pa.array(kept[a:z], pa.binary()), pa.array(sha[a:z], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return fragments.conclude(
        chunks, sent, judged, units, "text", _rank, lambda least, rank: least < rank, finish,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string",
    )


def op4_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
