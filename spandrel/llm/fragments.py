"""Passages of a fixed length that repeat across a corpus: what operators 4 and 8 share.

Every window of `length` units (bytes or words) is owned by one anchor, the k-gram of least hash in it; equal
windows have equal anchors at equal offsets. So windows are compared only where their anchors' hashes repeat:

1. documents are stored as chunks of some MB each, compressed, in the shared folder;
2. every chunk sends the distinct hashes of its anchors, as packed sorted arrays, to hash buckets; a bucket
   tells each chunk which of its hashes are also elsewhere (Finder);
3. for anchors whose hash repeats, the chunk sends the text that their windows cover, each distinct text once;
   a bucket compares the windows in full and answers for every window (Judge);
4. the chunk marks the units covered by windows that count as repeated.

Messages are grouped by chunk and bucket before they are shuffled, so a passage that is in a third of all
documents is one entry for a chunk. The anchors of a passage with very many different neighbours are sent
window by window, spread by the windows' own hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.common import durable, mix64, prepare, release, relax

#: Text of a chunk, and of all chunks for each bucket, in bytes; and the least number of buckets.
CHUNK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 8 << 20, 64
#: A hash that more chunks than this hold is compared window by window.
HOT_CHUNKS = 500
#: Units that are hashed at a time.
BLOCK = 1 << 15
#: Windows whose verdicts a chunk applies at a time; a bucket compares decide.most at a time.
SLICE = 1 << 19


def to_chunks(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES, salt: int = 0) -> DataFrame:
    """Rows (chunk, n_bytes, payload): the rows of docs as compressed Arrow batches, written to the shared folder.

    Chunks are numbered by partition; a salt scrambles the numbers, so that those of several tables differ.
    """
    prepare(docs.sparkSession)

    def pack(batches: list[pa.RecordBatch]) -> bytes:
        table = pa.Table.from_batches(batches).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def run(batches):
        context = TaskContext.get()
        base, n, held, size = (context.partitionId() if context else 0) << 32, 0, [], 0

        def row():
            number = base + n if not salt else int(mix64(np.array([(base + n) ^ salt], np.uint64))[0] >> np.uint64(1))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([pack(held)], pa.binary())], names=["chunk", "n_bytes", "payload"])

        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
            start = 0
            for i, own in enumerate(lengths.tolist()):
                size += own
                if size >= chunk_bytes:
                    held.append(b.slice(start, i + 1 - start))
                    start = i + 1
                    yield row()
                    n, held, size = n + 1, [], 0
            if start < b.num_rows:
                held.append(b.slice(start))
        if held:
            yield row()

    return durable(docs.mapInArrow(run, "chunk long, n_bytes long, payload binary"), "chunks")


def open_chunk(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


@dataclass(frozen=True)
class Units:
    """What a window is made of: `length` units, with anchors of `gram` units."""

    length: int
    gram: int
    words: bool

    def cut(self, texts: list[str | None]) -> tuple[list, np.ndarray, np.ndarray]:
        """The units of each text (a bytes object, or a list of words), all codes in one array, and the bounds."""
        if self.words:
            own = [(t or "").encode().split() for t in texts]
            flat = [w for o in own for w in o]
            codes = mix64(np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat)))
        else:
            own = [(t or "").encode() for t in texts]
            codes = np.frombuffer(b"".join(own), np.uint8)
        return own, codes, np.concatenate([[0], np.cumsum([len(o) for o in own], dtype=np.int64)])

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """A hash of the k-gram that starts at each place, as far as there is one."""
        k = self.gram
        n = len(codes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if self.words:
            out = np.full(n, 1, np.uint64)
            for i in range(k):
                out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : n + i]
            return mix64(out)
        # powers of two are joined from halves: 1, 2, 4, 8 bytes, then whole words of eight
        part, width, parts, at, left = codes.astype(np.uint64), 1, {}, 0, k
        parts[1] = part
        while width < 8:
            part = part[:-width] | (part[width:] << np.uint64(8 * width))
            width *= 2
            parts[width] = part
        out = np.zeros(n, np.uint64)
        for width in (8, 4, 2, 1):
            while left >= width:
                out = (out ^ parts[width][at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
                at, left = at + width, left - width
        return mix64(out)

    def anchors(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor in order: its hash, its place, and the first and last start of the windows it owns.

        The codes are worked through in blocks that fit a processor's cache.
        """
        n = len(codes) - self.length + 1
        whole = np.ones(max(n, 0), bool)  # windows inside one document
        for end in bounds[1:-1].tolist():
            whole[max(0, end - self.length + 1) : max(0, min(n, end))] = False
        parts = [self._block(codes, a, min(a + BLOCK, n), whole) for a in range(0, n, BLOCK)]
        parts = [p for p in parts if len(p[0])]
        if not parts:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, none, none
        h, place, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        again = np.concatenate([[False], (place[1:] == place[:-1]) & (first[1:] == last[:-1] + 1)])  # across blocks
        keep = np.flatnonzero(~again)
        return h[keep], place[keep], first[keep], last[np.concatenate([keep[1:] - 1, [len(h) - 1]])]

    def _block(self, codes: np.ndarray, a: int, z: int, whole: np.ndarray) -> tuple[np.ndarray, ...]:
        """anchors() of the windows that start from a to z."""
        h = self.grams(codes[a : z + self.length - 1])
        low = np.uint64((1 << 32) - 1)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # by hash, then by place: the leftmost of equals
        done, width = 1, self.length - self.gram + 1
        while done < width:
            step = min(done, width - done)
            least = np.minimum(least[: len(least) - step], least[step:])
            done += step
        starts = np.flatnonzero(whole[a:z])
        owner = (least[starts] & low).astype(np.int64)
        if not len(starts):
            return h[:0], owner, starts, starts
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
        return h[owner[new]], owner[new] + a, starts[new] + a, starts[last] + a

    def content(self, own: list, bounds: np.ndarray, document: int, first: int, last: int) -> bytes:
        """The text that the windows starting from first to last cover."""
        a, b = first - bounds[document], last + self.length - bounds[document]
        return b" ".join(own[document][a:b]) if self.words else own[document][a:b]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def packed(h: np.ndarray) -> np.ndarray:
    """The 48 bits of a hash that are sent: what is wrongly taken for repeated fails the comparison later."""
    return h >> np.uint64(16)


def write48(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def read48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def split_by(buckets: np.ndarray) -> Iterable[tuple[int, np.ndarray]]:
    """(bucket, places) for each bucket, places in their order."""
    if not len(buckets):
        return ()
    order = np.argsort(buckets, kind="stable")
    values, first = np.unique(buckets[order], return_index=True)
    return zip(values.tolist(), np.split(order, first[1:]), strict=True)


def hashes_by_bucket(chunks: DataFrame, units: Units, buckets: int, text: str, twice_within: bool) -> DataFrame:
    """Rows (bucket, chunk, hashes, twice): the distinct anchor hashes of a chunk, sorted, 48 bits each.

    twice has a byte for each: whether the chunk itself repeats it (in one document, if twice_within).
    """

    def run(batches):
        for b in batches:
            for chunk, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, codes, bounds = units.cut(open_chunk(payload).column(text).to_pylist())
                h, place, _, _ = units.anchors(codes, bounds)
                each, twice = own_hashes(h, np.searchsorted(bounds, place, "right"), twice_within)
                rows = [(k, chunk, write48(packed(each[at])), twice[at].tobytes()) for k, at in split_by(bucket_of(each, buckets))]
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], names=["bucket", "chunk", "hashes", "twice"])

    return chunks.select("chunk", "payload").mapInArrow(run, "bucket long, chunk long, hashes binary, twice binary")


def own_hashes(h: np.ndarray, document: np.ndarray, twice_within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and of each whether it is in two documents (or twice in one, if that counts)."""
    if not len(h):
        return h, np.zeros(0, np.uint8)
    order = np.argsort(h, kind="stable")  # documents come in order, so they stay so
    h, document = h[order], document[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    other = np.concatenate([[False], ~new[1:] & ((document[1:] != document[:-1]) | twice_within)])
    return h[new], np.logical_or.reduceat(other, np.flatnonzero(new)).astype(np.uint8)


def repeated_in_bucket(hot: int) -> Callable[[pa.Table], pa.Table]:
    """For each chunk of a bucket, its hashes that are repeated, with a byte that is 2 where they are hot."""

    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        each = [read48(x) for x in table.column("hashes").to_pylist()]
        twice = np.frombuffer(b"".join(table.column("twice").to_pylist()), np.uint8)
        return answers(chunks, each, twice, hot)

    return run


def answers(chunks: list[int], each: list[np.ndarray], twice: np.ndarray, hot: int) -> pa.Table:
    flat = np.concatenate(each) if each else np.zeros(0, np.uint64)
    _, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
    again = np.zeros(len(n), bool)
    np.logical_or.at(again, inverse, twice.astype(bool))
    state = np.where(n > hot, 2, np.where((n > 1) | again, 1, 0)).astype(np.uint8)[inverse]
    out, at = [], 0
    for chunk, own in zip(chunks, each, strict=True):
        mine = state[at : at + len(own)]
        at += len(own)
        if mine.any():
            out.append((chunk, write48(own[mine > 0]), mine[mine > 0].tobytes()))
    c = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.binary())], names=["chunk", "hashes", "state"])


def find_repeated(chunks: DataFrame, units: Units, buckets: int, text: str, twice_within: bool, hot: int = HOT_CHUNKS) -> DataFrame:
    """Rows (chunk, hashes, state) from every bucket."""
    sent = hashes_by_bucket(chunks, units, buckets, text, twice_within)
    return sent.groupBy("bucket").applyInArrow(repeated_in_bucket(hot), "chunk long, hashes binary, state binary")


def entries(chunks: DataFrame, found: DataFrame, units: Units, buckets: int, text: str, rank: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """What chunks send of anchors whose hash repeats, and what they keep.

    Rows with bucket >= 0: entry, number, value, anchor (packed arrays: entry numbers, numbers of windows, the
    least rank or the count of the entry's occurrences in this chunk, its anchor's hash) and texts, compressed. A row with bucket -1 is kept
    for the chunk itself: the entry number and first window of every occurrence.
    """
    per = found.groupBy("chunk").agg(F.collect_list("hashes").alias("hashes"), F.collect_list("state").alias("state"))
    joined = chunks.select("chunk", "payload").join(per, "chunk")

    def run(batches):
        for b in batches:
            for chunk, payload, hashes, state in zip(*(b.column(k).to_pylist() for k in ("chunk", "payload", "hashes", "state")), strict=True):
                table = open_chunk(payload)
                own, codes, bounds = units.cut(table.column(text).to_pylist())
                h, place, first, last = units.anchors(codes, bounds)
                known = np.concatenate([read48(x) for x in hashes])
                states = np.frombuffer(b"".join(state), np.uint8)
                order = np.argsort(known)
                known, states = known[order], states[order]
                mine = packed(h)
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                pick = np.flatnonzero(known[at] == mine)
                document = np.searchsorted(bounds, place[pick], "right") - 1
                ranks = rank(table)
                seen: dict[tuple, int] = {}
                target, number, value, anchor, texts, kept_entry, kept_start = [], [], [], [], [], [], []
                bucket = bucket_of(h[pick], buckets).tolist()
                for j, d, b_ in zip(pick.tolist(), document.tolist(), bucket, strict=True):
                    a, z = int(first[j]), int(last[j])
                    spans = [(a, z, b_)] if states[at[j]] < 2 else [(s, s, -1) for s in range(a, z + 1)]
                    for s, e, to in spans:
                        body = units.content(own, bounds, d, s, e)
                        if to < 0:
                            to = int.from_bytes(hashlib.blake2b(body, digest_size=6).digest(), "little") % buckets
                        key = (int(mine[j]), body)
                        k = seen.get(key)
                        if k is None:
                            k = seen[key] = len(target)
                            target.append(to)
                            number.append(e - s + 1)
                            value.append(int(ranks[d]) if ranks is not None else 1)
                            anchor.append(key[0])
                            texts.append(body)
                        elif ranks is not None:
                            value[k] = min(value[k], int(ranks[d]))
                        else:
                            value[k] += 1
                        kept_entry.append(k)
                        kept_start.append(s)
                rows = [(-1, chunk, np.array(kept_entry, "<i4").tobytes(), np.array(kept_start, "<i4").tobytes(), b"", b"", b"")]
                number_, value_, anchor_ = np.array(number, "<i4"), np.array(value, "<i8"), np.array(anchor, "<u8")
                for k, places in split_by(np.array(target, np.int64)):
                    rows.append((k, chunk, places.astype("<i4").tobytes(), number_[places].tobytes(), value_[places].tobytes(), write48(anchor_[places]), press([texts[i] for i in places.tolist()])))
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.binary()), pa.array(c[5], pa.binary()), pa.array(c[6], pa.binary())],
                    names=["bucket", "chunk", "entry", "number", "value", "anchor", "texts"],
                )

    return durable(joined.mapInArrow(run, "bucket long, chunk long, entry binary, number binary, value binary, anchor binary, texts binary"), "entries")


def press(texts: list[bytes]) -> bytes:
    """Byte strings as one compressed value."""
    import zstandard

    lengths = np.array([len(texts), *map(len, texts)], "<i4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(lengths + b"".join(texts))


def unpress(pressed: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All byte strings of several press() values in one buffer, with their starts and ends in it."""
    import zstandard

    bodies, starts, ends, base = [], [], [], 0
    for data in pressed:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n = int(np.frombuffer(raw[:4], "<i4")[0])
        upto = np.cumsum(np.frombuffer(raw[4 : 4 + 4 * n], "<i4"), dtype=np.int64)
        starts.append(base + np.concatenate([[0], upto[:-1]])[:n])
        ends.append(base + upto)
        bodies.append(raw[4 + 4 * n :])
        base += len(bodies[-1])
    return b"".join(bodies), np.concatenate(starts).astype(np.int64), np.concatenate(ends)


def slices(weights: np.ndarray, most: int, joint: np.ndarray | None = None) -> Iterable[tuple[int, int]]:
    """Ranges of places with weights of about `most` each; places of the same joint value stay together."""
    upto = np.cumsum(weights)
    a = 0
    while a < len(weights):
        z = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right"))
        z = max(z, a + 1)
        if joint is not None and z < len(weights):
            back = int(np.searchsorted(joint[a:z], joint[z], "left")) + a  # where the value that is cut begins
            z = back if back > a else int(np.searchsorted(joint[z:], joint[a], "right")) + z
        yield a, z
        a = z


def judge(sent: DataFrame, decide: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Rows (chunk, answer): of each window of each entry the value that decide() gives, packed.

    Windows are equal only if their anchors are, so a bucket is worked through in slices of whole anchors, of about
    decide.most windows each, and a text whose anchor no other text has gets one value for all its windows (unless
    decide.within says that a text can repeat a window itself). decide(texts, numbers, values) gets the other
    distinct texts of a slice, their numbers of windows and the least or summed values of their entries; it returns
    the value of every window, in order.
    """

    def settle(texts: list[bytes], number: np.ndarray, value: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        known: dict[bytes, int] = {}
        which = np.fromiter((known.setdefault(t, len(known)) for t in texts), np.int64, len(texts))
        if decide.combine == "sum":
            total = np.zeros(len(known), np.int64)
            np.add.at(total, which, value)
        else:
            total = np.full(len(known), np.iinfo(np.int64).max)
            np.minimum.at(total, which, value)
        sizes, anchors = np.zeros(len(known), np.int64), np.zeros(len(known), np.uint64)
        sizes[which], anchors[which] = number, anchor
        _, same, often = np.unique(anchors, return_inverse=True, return_counts=True)
        verdict = np.repeat(total, sizes)
        mixed = (often[same] > 1) | ((sizes > 1) & decide.within)
        if mixed.any():
            verdict[np.repeat(mixed, sizes)] = decide([t for t, m in zip(known, mixed.tolist(), strict=True) if m], sizes[mixed], total[mixed])
        return verdict[expand((np.cumsum(sizes) - sizes)[which], number)]

    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        entry = [np.frombuffer(x, "<i4") for x in table.column("entry").to_pylist()]
        number = np.concatenate([np.frombuffer(x, "<i4") for x in table.column("number").to_pylist()]).astype(np.int64)
        value = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("value").to_pylist()])
        anchor = np.concatenate([read48(x) for x in table.column("anchor").to_pylist()])
        text, start, end = unpress(table.column("texts").to_pylist())
        del table
        order = np.argsort(anchor, kind="stable")
        begin = np.cumsum(number) - number
        verdict = np.empty(int(number.sum()), np.int64)
        for a, z in slices(number[order], decide.most, anchor[order]):
            own = order[a:z]
            texts = [text[i:j] for i, j in zip(start[own].tolist(), end[own].tolist(), strict=True)]
            verdict[expand(begin[own], number[own])] = settle(texts, number[own], value[own], anchor[own])
        out, at, window = [], 0, 0
        for chunk, own in zip(chunks, entry, strict=True):
            mine = number[at : at + len(own)]
            n = int(mine.sum())
            out.append((chunk, own.tobytes(), mine.astype("<i4").tobytes(), verdict[window : window + n].astype("<i8").tobytes()))
            at, window = at + len(own), window + n
        c = list(zip(*out, strict=True))
        answer = _squeeze(pa.table([pa.array(c[0], pa.int64()), *(pa.array(x, pa.binary()) for x in c[1:])], names=["chunk", "entry", "number", "verdict"]))
        del text, verdict, out, c
        relax()
        return answer

    return sent.where("bucket >= 0").groupBy("bucket").applyInArrow(run, "chunk long, answer binary")


def expand(first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run of `number` places, one run after another."""
    return np.arange(int(number.sum())) + np.repeat(first - (np.cumsum(number) - number), number)


def _squeeze(table: pa.Table) -> pa.Table:
    """The three arrays of an answer in one compressed value: verdicts of neighbours are mostly the same."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    rows = []
    for e, n, v in zip(*(table.column(k).to_pylist() for k in ("entry", "number", "verdict")), strict=True):
        rows.append(z.compress(len(e).to_bytes(8, "little") + e + n + v))
    return pa.table([table.column("chunk"), pa.array(rows, pa.binary())], names=["chunk", "answer"])


def _stretch(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw[8 : 8 + n], "<i4"), np.frombuffer(raw[8 + n : 8 + 2 * n], "<i4"), np.frombuffer(raw[8 + 2 * n :], "<i8")


def conclude(chunks: DataFrame, sent: DataFrame, judged: DataFrame, units: Units, text: str, rank, marked: Callable, finish: Callable, schema) -> DataFrame:
    """finish(table, units of each row, mask of each row) for every chunk; marked(verdicts, rank) tells which windows go."""
    release(chunks.sparkSession)
    kept = sent.where("bucket = -1").select("chunk", F.col("entry").alias("occurrence"), F.col("number").alias("start"))
    told = judged.groupBy("chunk").agg(F.collect_list("answer").alias("answers"))
    joined = chunks.select("chunk", "payload").join(kept, "chunk", "left").join(told, "chunk", "left").select("payload", "occurrence", "start", "answers")

    def run(batches):
        for b in batches:
            for payload, occurrence, start, replies in zip(*(x.to_pylist() for x in b.columns), strict=True):
                table = open_chunk(payload)
                own, codes, bounds = units.cut(table.column(text).to_pylist())
                begins = np.zeros(len(codes) + 1, np.int32)
                if occurrence and replies:
                    entry, number, verdict = (np.concatenate(x) for x in zip(*map(_stretch, replies), strict=True))
                    first = np.zeros(int(entry.max()) + 1, np.int64)
                    size = np.zeros(int(entry.max()) + 1, np.int64)
                    first[entry], size[entry] = np.cumsum(number) - number, number
                    occurrence, start = np.frombuffer(occurrence, "<i4"), np.frombuffer(start, "<i4").astype(np.int64)
                    ranks, n = rank(table), size[occurrence]
                    for a, z in slices(n, SLICE):
                        some = occurrence[a:z]
                        windows = expand(start[a:z], n[a:z])
                        values = verdict[expand(first[some], n[a:z])]
                        mine = np.repeat(ranks[np.searchsorted(bounds, start[a:z], "right") - 1], n[a:z]) if ranks is not None else None
                        begins[windows[marked(values, mine)] + 1] = 1
                    del entry, number, verdict, first, size, n
                count = np.cumsum(begins, dtype=np.int32)  # of windows that go, by start
                mask = count[1:].copy()
                if len(mask) > units.length:
                    mask[units.length :] -= count[1 : len(mask) - units.length + 1]
                mask = mask > 0
                del begins, count, codes
                yield from finish(table, own, [mask[a:z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
                del table, own, mask
                relax()

    return joined.mapInArrow(run, schema)


def n_buckets(chunks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(LEAST_BUCKETS, -(-total // bucket_bytes))
