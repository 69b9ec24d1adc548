"""Many literals looked for at once: an automaton over all of them, built once a task, one pass over each text."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.sources import shared

#: Characters of the literals of one automaton; more of them take another pass over the texts.
BLOCK_CHARS = 8 << 20
#: The same where they are only counted, which takes far less memory for each.
COUNT_CHARS = 32 << 20
#: Characters of texts that are searched at a time, and of literals that come to the driver in one row.
_TEXT_CHARS, _PACK_CHARS = 1 << 20, 1 << 18
#: A block of literals of more lengths than this is looked for by an automaton.
_MOST_LENGTHS = 16
#: Occurrences that a task holds before they leave it; those of one text stay together.
MOST_FOUND = 20_000


def automaton(literals: Iterable[str]) -> ahocorasick.Automaton | None:
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)  # the text has the literal
    for x in literals:
        if x:
            out.add_word(x)
    if not len(out):
        return None
    out.make_automaton()
    return out


def spans(text: str, held: ahocorasick.Automaton | None) -> list[tuple[int, int, str]]:
    """(start, end, literal), by end; of one literal only those that do not overlap, from the left."""
    out, upto = [], {}
    for last, length in held.iter(text) if held is not None else ():
        start = last + 1 - length
        x = text[start : last + 1]
        if start >= upto.get(x, 0):
            upto[x] = last + 1
            out.append((start, last + 1, x))
    return out


def blocks(literals: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """The distinct literals (column literal) in blocks of so many characters, of which the driver holds one."""
    held, size = [], 0
    for row in literals.where("literal <> ''").distinct().orderBy("literal").toLocalIterator():
        held.append(row.literal)
        size += len(row.literal)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _cut(joined: str, lengths: Iterable[int]) -> Iterator[str]:
    at = 0
    for n in lengths:
        yield joined[at : at + n]
        at += n


def _found(batches: Iterable[pa.RecordBatch], held: ahocorasick.Automaton | None, names: list[str], most: int = MOST_FOUND) -> Iterator[pa.RecordBatch]:
    """The occurrences in the texts (second column) of batches, with the first column."""
    for b in batches:
        at, found = [], []

        def out(keys: pa.Array, at: list[int], found: list[tuple[int, int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array([x for _, _, x in found], pa.string()), *(pa.array([f[i] for f in found], pa.int32()) for i in (0, 1))], names=names)

        for k in range(b.num_rows):
            t = b.column(1)[k].as_py()
            own = spans(t, held) if t else []
            at += [k] * len(own)
            found += own
            if len(found) >= most:
                yield out(b.column(0), at, found)
                at, found = [], []
        if found:
            yield out(b.column(0), at, found)


def occurrences(texts: DataFrame, literals: DataFrame, key: str, text: str, most: int = BLOCK_CHARS) -> DataFrame:
    """(key, literal, start, end) of every literal in every text, offsets in code points.

    The literals travel in blocks of a fixed size; each block is a pass over the texts, so any number of them is found.
    """
    spark = texts.sparkSession
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, literal string, start int, end int"
    out = None
    for block in blocks(literals, most):
        shared = spark.sparkContext.broadcast(("".join(block), array("I", map(len, block))))  # far less than so many strings

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from _found(batches, automaton(_cut(*shared.value)), [key, "literal", "start", "end"])

        one = texts.select(key, text).mapInArrow(run, schema)
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], schema)


def counted(found: DataFrame, key: str) -> DataFrame:
    """(key, literal, n)."""
    return found.groupBy(key, "literal").agg(F.count(F.lit(1)).alias("n"))


# --- counted without a row for each occurrence ----------------------------------------------------------------------


def _packed(literals: DataFrame, most: int) -> Iterator[tuple[str, array]]:
    """The distinct literals in blocks of about so many characters, each as one string and its lengths; they come to the
    driver many in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda held: pa.RecordBatch.from_arrays([pa.array(["".join(held)], pa.string()), pa.array([array("I", map(len, held)).tobytes()], pa.binary())], names=["joined", "lengths"])
        held, size = [], 0
        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(x)
                size += len(x)
                if size >= min(most, _PACK_CHARS):
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    texts, lengths = [], array("I")
    rows = shared.written(literals.where("literal <> ''").select("literal").distinct().mapInArrow(run, "joined string, lengths binary"), "literals")
    for r in rows.toLocalIterator():
        texts.append(r.joined)
        lengths.frombytes(bytes(r.lengths))
        if sum(map(len, texts)) >= most:
            yield "".join(texts), lengths
            texts, lengths = [], array("I")
    if texts:
        yield "".join(texts), lengths
    shared.drop(rows)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _window_hashes(codes: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of each string of `length` characters, a polynomial modulo 2**64 from sums over all before."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = (0x9E3779B97F4A7C15 + 0x632BE59BD9B4E018 * seed) & (1 << 64) - 1 | 1
    power = lambda x, n: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power(base, len(codes)), dtype=np.uint64)])
    out = (upto[length:] - upto[:n]) * power(pow(base, -1, 1 << 64), n)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


class _Collision(Exception):
    pass


class _OfOneLength:
    """Different literals of one length in a table by their hashes, of which no two are equal; what is found is compared
    in full."""

    def __init__(self, codes: np.ndarray):
        self.codes, (m, self.length) = codes, codes.shape
        for self.seed in range(4):
            step = max(1, _TEXT_CHARS // self.length)
            self.hashes = np.concatenate([_window_hashes(codes[k : k + step].reshape(-1), self.length, self.seed)[:: self.length] for k in range(0, m, step)])
            if len(np.unique(self.hashes)) == m:
                break
        else:
            raise _Collision
        self.mask = (1 << (2 * m).bit_length()) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        left, at = np.arange(m, dtype=np.int32), self._place(self.hashes)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several the last
            lost = self.slots[at] != left
            left, at = left[lost], at[lost] + 1 & self.mask

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(self.mask)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, literal) of every occurrence, by start."""
        h = _window_hashes(codes, self.length, self.seed)
        starts, at = np.arange(len(h)), self._place(h)
        found, which = [], []
        while len(starts):
            held = self.slots[at]
            there = held >= 0
            starts, at, held = starts[there], at[there], held[there]
            same = self.hashes[held] == h[starts]
            found.append(starts[same])
            which.append(held[same])
            starts, at = starts[~same], at[~same] + 1 & self.mask
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, literal = np.concatenate(found), np.concatenate(which)
        order = np.argsort(start)
        start, literal = start[order], literal[order].astype(np.int64)
        equal = np.ones(len(start), bool)
        for j in range(self.length):
            equal &= codes[start + j] == self.codes[literal, j]
        return start[equal], literal[equal]


class _Counter:
    """Of each text how many different literals it has, and how many occurrences that do not overlap with one of the same
    literal, from the left."""

    def __init__(self, joined: str, lengths: array):
        self.tables, self.held = [], None
        n = np.frombuffer(lengths, np.uint32).astype(np.int64)
        kinds = np.unique(n)
        if len(kinds) <= _MOST_LENGTHS:
            codes, at = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else _codes(joined), np.cumsum(n) - n
            try:
                self.tables = [_OfOneLength(codes.reshape(-1, int(k)) if len(kinds) == 1 else codes[at[n == k][:, None] + np.arange(k)]) for k in kinds.tolist()]
            except _Collision:
                self.tables = []
        if not self.tables:
            self.held = automaton(_cut(joined, lengths))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        literals, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        if self.held is not None:
            for k, t in enumerate(texts):
                own = [x for _, _, x in spans(t, self.held)]
                literals[k], total[k] = len(set(own)), len(own)
            return literals, total
        sizes = np.array([len(t) for t in texts], np.int64)
        codes, ends = _codes("".join(texts)), np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)
        for table in self.tables:
            start, literal = table.find(codes)
            inside = start + table.length <= ends[owner[start]]
            start, literal = start[inside], literal[inside]
            text = owner[start]
            key = text * len(table.codes) + literal
            order = np.argsort(key, kind="stable")  # of one text and literal by start
            key, start, text = key[order], start[order], text[order]
            new = np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]])
            begins = np.flatnonzero(new)
            near = np.flatnonzero(~new[1:] & (start[1:] - start[:-1] < table.length)) + 1
            counts = np.ones(len(key), bool)
            for g in np.unique(np.searchsorted(begins, near, "right") - 1).tolist():
                upto = -1
                for k in range(int(begins[g]), int(begins[g + 1]) if g + 1 < len(begins) else len(key)):
                    counts[k] = start[k] >= upto
                    if counts[k]:
                        upto = start[k] + table.length
            literals += np.bincount(text[new], minlength=len(texts))
            total += np.bincount(text[counts], minlength=len(texts))
        return literals, total


def _counts(batches: Iterable[pa.RecordBatch], counter: _Counter, names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        a = 0
        while a < len(texts):
            z, size = a, 0
            while z < len(texts) and (z == a or size + len(texts[z]) <= _TEXT_CHARS):
                size += len(texts[z])
                z += 1
            literals, total = counter(texts[a:z])
            has = np.flatnonzero(literals)
            if len(has):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(has + a)), pa.array(literals[has]), pa.array(total[has])], names=names)
            a = z


def counts(texts: DataFrame, literals: DataFrame, key: str, text: str, most: int = COUNT_CHARS) -> DataFrame:
    """(key, n_literals, n): how many of the distinct literals a text has, and how often in all; several rows of a text,
    to be added up, where the literals are more than a block, and none where it has none.

    It is what occurrences() come to, counted where the text is.
    """
    spark = texts.sparkSession
    names = [key, "n_literals", "n"]
    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, n_literals long, n long"
    out = None
    for block in _packed(literals, most):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield from _counts(batches, _Counter(*sent.value), names)

        one = texts.select(key, text).mapInArrow(run, schema)
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], schema)
