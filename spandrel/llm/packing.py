"""Sum-of-squares online packing of documents into token windows (operator 3)."""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spandrel.llm.common import Bounded, prepare, table

SEQ_LEN = 2048
END_ID = 1
#: Windows that a task holds open, of less than SEQ_LEN tokens each. Beyond, the emptier half is dealt out to the
#: fuller one; nothing is dropped.
MOST_OPEN = 4096

#: White space as the pre-tokenizer's pattern means it (the Unicode property White_Space). Fixed values.
WHITE = "\t-\r \x85\xa0  -     　"
#: Letters below U+0250: all of ASCII's, Latin-1's and the two Latin extensions'.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: Cuts a text only where the pre-tokenizer's pattern also cuts, whatever stands on either side: at white
#: space, and after a run of plain letters, which is then one match of the pattern.
COARSE = re.compile(f" ?[{LETTER}]+(?![^\\x00-@\\[-`{{-\\x7f{WHITE}])| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
PLAIN = re.compile(f" ?[{LETTER}]+")

SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [T.StructField("ids", T.BinaryType())]
)


class Encoder:
    """Token ids of whole texts, as packed little-endian bytes; memoised by chunk."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = Bounded(self._chunk, most=500_000)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(visible)]
        self.shown = {b: 256 + i for i, b in enumerate(hidden)}

    def _chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk):  # one match of the pattern, so the merges alone are left to do
            shown = chunk.encode().decode("latin-1").translate(self.shown)
            return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return self._whole(chunk)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):  # these are cut out before the pattern applies
            return np.frombuffer(self._whole(text), "<u4")
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, COARSE.findall(text))), "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Places token runs into windows of seq_len; rows() gives the pieces whose place is final.

    A run of seq_len or more fills whole windows first. What is left, s tokens, goes to the fill level h at
    which the sum over levels of the squared number of partially filled windows gets least: from level h to
    h + s, or a new window (h = 0); full windows count nothing, ties go to the fuller window. The numbers of
    windows are kept in an array by level.
    """

    def __init__(self, seq_len: int, first_sequence: int):
        self.size, self.next = seq_len, first_sequence
        self.count = np.zeros(seq_len + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(seq_len + 1)]  # by level: windows, each a list of pieces
        self.n_open = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total = len(ids)
        at = 0
        while total - at >= self.size:
            self._close([(doc_id, at, ids[at : at + self.size], total)])
            at += self.size
        if at < total:
            self._place((doc_id, at, ids[at:], total))
            if self.n_open > MOST_OPEN:
                self._drain(MOST_OPEN // 2)

    def _level(self, s: int, opens: bool) -> int | None:
        """The level at which s more tokens make the sum of squares least; 0 is a new window, if one may be opened."""
        n, size = self.count, self.size
        level, best = (0, 2 * int(n[s]) + 1) if opens else (None, 1 << 39)
        here = n[1 : size - s + 1]
        if len(here):
            rise = n[1 + s : size + 1]
            change = 2 * (rise - here) + 2
            change[-1] = 1 - 2 * here[-1]  # it gets full and leaves the array
            change[here == 0] = 1 << 40
            k = len(change) - 1 - int(change[::-1].argmin())
            if change[k] <= best:
                level = k + 1
        return level

    def _take(self, level: int) -> list[tuple]:
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, window: list[tuple], level: int, piece: tuple) -> None:
        window.append(piece)
        level += len(piece[2])
        if level == self.size:
            self._close(window)
        else:
            self.open[level].append(window)
            self.count[level] += 1
            self.n_open += 1

    def _place(self, piece: tuple) -> None:
        level = self._level(len(piece[2]), True)
        self._put(self._take(level) if level else [], level, piece)

    def _drain(self, target: int) -> None:
        """Deal the emptiest windows out to the others until `target` are open.

        Their pieces go where the sum of squares says, whole; a piece that fits nowhere is cut to fill the fullest
        window.
        """
        while self.n_open > target:
            levels = np.flatnonzero(self.count)
            waiting = sorted(self._take(int(levels[0])), key=lambda p: len(p[2]))
            while waiting:
                doc_id, start, ids, total = waiting.pop()  # the longest first
                level = self._level(len(ids), False)
                if level is not None:
                    self._put(self._take(level), level, (doc_id, start, ids, total))
                    continue
                levels = np.flatnonzero(self.count)
                if not len(levels):  # nothing else is open
                    self._put([], 0, (doc_id, start, ids, total))
                    continue
                level = int(levels[-1])
                room = self.size - level
                self._put(self._take(level), level, (doc_id, start, ids[:room], total))
                waiting.append((doc_id, start + room, ids[room:], total))
                waiting.sort(key=lambda p: len(p[2]))

    def _close(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in window:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset, ids.tobytes()))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Close what is open without padding: all but one window are filled, the last one becomes powers of two."""
        self._drain(1)
        for level in np.flatnonzero(self.count).tolist():
            self._powers(self._take(level))

    def _powers(self, pieces: list[tuple]) -> None:
        """Less than a window is left: sequences of a power of two each, which need no padding."""
        left = sum(len(p[2]) for p in pieces)
        pieces = pieces[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc_id, start, ids, total = pieces.pop()
                if len(ids) > room:
                    pieces.append((doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                window.append((doc_id, start, ids, total))
                room -= len(ids)
            self._close(window)

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _pack(path: str, seq_len: int, end_id: int, with_ids: bool):
    names = SCHEMA.names if with_ids else SCHEMA.names[:-1]
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)

    def run(batches):
        context = TaskContext.get()
        packer = Packer(seq_len, (context.partitionId() if context else 0) << 33)
        own, end = encoder(path), np.array([end_id], "<u4")
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packer.add(doc_id, np.concatenate([own.encode(text or ""), end]))
            if rows := packer.rows():
                yield batch(rows)
        packer.finish()
        if rows := packer.rows():
            yield batch(rows)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text), each a run of token ids with its place in a sequence.

    Every id of a document (null text: only end_id) lies in exactly one piece. Each input partition is packed
    by itself as its rows come, so nothing is shuffled; sequence ids start at partition << 33. What is open at
    the end is closed without padding: the emptiest windows are dealt out to the others, piece by piece and whole
    where one fits, and the last, partial one becomes sequences whose lengths are powers of two. A task holds at
    most MOST_OPEN windows.
    Repeated rows and doc_ids are packed each by itself, a null doc_id stays null, an empty table gives no
    pieces, other columns of docs are not looked at. with_ids adds the ids as little-endian 32-bit integers.
    """
    prepare(docs.sparkSession)
    schema = SCHEMA if with_ids else T.StructType(SCHEMA.fields[:-1])
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_pack(tokenizer, seq_len, end_id, with_ids), schema)


def op3_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
