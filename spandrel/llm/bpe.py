"""Byte-level BPE by longest matches and backtracking, with exact decoding (operator 6)."""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spandrel.llm.common import Bounded, prepare, table
from spandrel.llm.packing import COARSE, PLAIN


class BytePairCodec:
    """The tokens of a rank file. encode() gives the ids of exact merges in time linear in the text.

    The tokens stand in an Aho-Corasick automaton as Latin-1 strings, one character a byte. At each place the
    longest match is tried first, then its shorter prefixes that are tokens; a token may follow another only if
    merging their joined bytes gives just these two, which is kept in a memo of pairs. If none fits, the last
    token is taken back and its end is marked, so no place is tried twice.
    """

    def __init__(self, path: str, pattern: str):
        import ahocorasick

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.text_of = [b""] * (max(self.ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.text_of[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.left_spine: dict[int, list] = {}
        self.right_spine: dict[int, list] = {}
        self.chunks = Bounded(self._chunk, most=500_000)

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranked = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            i = ranked.index(min(ranked))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The tokens that stand at an end of this one while it is merged, each with the rank that ends it."""
        text, ends, out = self.text_of[token], 1 << 60, []
        while True:
            out.append((text, ends))
            ends, halves = self.ranks[text], self._halves(text)
            if halves is None:
                return out
            text = halves[side]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of both gives just both.

        Merges come in rising rank. They differ only if, at some time, the tokens x at the end of a and y at the
        start of b both stand and x + y ranks before what either is merged into; of equal ranks the left goes first.
        """
        key = a << 32 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            left = self.right_spine.get(a) or self.right_spine.setdefault(a, self._spine(a, 1))
            right = self.left_spine.get(b) or self.left_spine.setdefault(b, self._spine(b, 0))
            rank_of = self.ranks.get
            found = True
            for x, x_ends in left:
                for y, y_ends in right:
                    rank = rank_of(x + y)
                    if rank is not None and rank < x_ends and rank <= y_ends:
                        found = False
                        break
                if not found:
                    break
            self.fits[key] = found
        return found

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            text = self.text_of[token]
            found = next((self.ranks[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ranks), -1)
            self.shorter[token] = found
        return found

    def piece(self, text: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest = [0] * n
        for end, (rank, size) in self.automaton.iter(text.decode("latin-1")):
            longest[end - size + 1] = rank  # ends rise, so the last one stays
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token, text_of = 0, longest[0], self.text_of
        while True:
            end = at + len(text_of[token])
            if not dead[end] and (not out or self._compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = self._shorter(token)
            while token < 0:
                dead[at] = 1
                last = out.pop()
                at -= len(text_of[last])
                token = self._shorter(last)

    def _chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk):  # one match of the pattern
            return array("I", self.piece(chunk.encode())).tobytes()
        return array("I", [i for m in self.pattern.findall(chunk) for i in self.piece(m.encode())]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, COARSE.findall(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = BytePairCodec(path, pattern)
    return _CODECS[path, pattern]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _run(path: str, pattern: str, digests: bool):
    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            ids, first, second = b.column(0), [], []
            n = []
            for text in b.column(1).to_pylist():
                codes = own.encode(text or "")
                back = own.decode(codes)
                n.append(len(codes))
                packed = codes.tobytes()
                first.append(hashlib.sha256(packed).hexdigest() if digests else packed)
                second.append(hashlib.sha256(back).hexdigest() if digests else back)
            if digests:
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=DIGESTS.names)
            else:
                yield pa.RecordBatch.from_arrays([ids, pa.array(first, pa.binary()), pa.array(second, pa.binary())], names=SCHEMA.names)

    return run


def encode_documents(docs: DataFrame, ranks: str, pattern: str, digests: bool = False) -> DataFrame:
    """Ids (little-endian unsigned 32-bit) and decoded bytes of every text of docs (doc_id, text).

    Each match of the pattern is encoded by itself; special tokens are ordinary text. A null text is empty and
    gives no ids. Rows map one to one, so repeated rows, null ids and empty tables need nothing special; other
    columns of docs are not looked at. Encoded chunks of up to 64 characters are kept in a bounded memo of the
    worker; a longer chunk is encoded each time, in linear time. digests: n_tokens and SHA-256 in their place.
    """
    prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_run(ranks, pattern, digests), DIGESTS if digests else SCHEMA)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
