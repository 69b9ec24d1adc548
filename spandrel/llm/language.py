"""Language identification by a bidirectional gated recurrent network over bytes (operator 9)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.common import id_crc, prepare, table

#: The bounded sample that the network is trained on: whole documents, so many and of so many bytes together.
TRAIN_DOCS, TRAIN_BYTES = 1500, 2_000_000
HIDDEN = 12
#: Updates of the weights that training makes at least, passing over a small sample several times.
STEPS = 150
#: A text is read in windows: bytes that a window labels, and bytes around them that it reads for context only.
CORE, CONTEXT = 240, 16
#: Windows that are read together, in training and afterwards.
BATCH, TOGETHER = 64, 1024
UNKNOWN = "und"
#: A document of a lower score is rejected by screen().
LEAST = 0.5

LETTER = re.compile(r"[^\W\d_]")
#: Neighbouring bytes are read from one state, so they do not count as independent: this many count as one.
TEMPERATURE = 12.0


def has_letters(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def windows(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The windows of texts in lower case, as UTF-8; of each its text's number and the first and last byte it labels.

    Every byte of a text is labelled by exactly one of its windows.
    """
    out, own, first, last = [], [], [], []
    for i, text in enumerate(texts):
        data = text.lower().encode("utf-8", "replace")
        for a in range(0, len(data), CORE):
            start = max(0, a - CONTEXT)
            out.append(data[start : a + CORE + CONTEXT])
            own.append(i)
            first.append(a - start)
            last.append(min(a + CORE, len(data)) - start)
    return out, *(np.array(v, np.int64) for v in (own, first, last))


def pad(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the windows (0 where they end) and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.zeros((len(words), max(1, int(lengths.max(initial=1)))), np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    rows = np.repeat(np.arange(len(words)), lengths)
    columns = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes[rows, columns] = flat
    return codes, lengths


class ByteTagger:
    """A gated recurrent unit in each direction over bytes, and a softmax over the languages at every byte.

    Parameters, the first axis being the direction: an input table x (256 x 3H: update, reset and candidate), a
    recurrent matrix u (H x 3H), a bias c, and a readout w (H x languages) with bias o. The gates are the hard
    sigmoid clip(x / 4 + 1/2, 0, 1), the candidate is clip(x, -1, 1): these cost a fraction of exponentials.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.p = {
            "x": (r.normal(size=(2, 256, 3 * hidden)) * 0.3).astype("f4"),
            "u": (r.normal(size=(2, hidden, 3 * hidden)) / np.sqrt(hidden)).astype("f4"),
            "c": np.zeros((2, 3 * hidden), "f4"),
            "w": (r.normal(size=(2, hidden, len(languages))) * 0.1).astype("f4"),
            "o": np.zeros(len(languages), "f4"),
        }

    @staticmethod
    def _ways(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rows of the flattened input table: steps x 2 x windows. The second direction has each window reversed."""
        at = lengths[:, None] - 1 - np.arange(codes.shape[1])
        back = np.where(at >= 0, np.take_along_axis(codes, np.maximum(at, 0), 1), 0)
        return np.ascontiguousarray(np.stack([codes.T, back.T + 256], 1))

    @staticmethod
    def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """steps x windows x values, each window's own steps in reverse."""
        at = lengths[None] - 1 - np.arange(len(x))[:, None]
        return x[np.where(at >= 0, at, np.arange(len(x))[:, None]), np.arange(x.shape[1])[None]]

    def _pass(self, ways: np.ndarray, keep: bool):
        """Scores at each step and direction, before they are added; and what the way back needs."""
        hid, p = self.hidden, self.p
        given_all = (p["x"] + p["c"][:, None]).reshape(512, -1)
        both, new_ = np.ascontiguousarray(p["u"][:, :, : 2 * hid]), np.ascontiguousarray(p["u"][:, :, 2 * hid :])
        state = np.zeros((2, ways.shape[2], hid), given_all.dtype)
        scores, tape = np.empty((len(ways), 2, ways.shape[2], len(self.languages)), given_all.dtype), []
        for t in range(len(ways)):
            given = given_all.take(ways[t], axis=0)
            gates = state @ both
            gates += given[..., : 2 * hid]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            held = gates[..., hid:] * state
            new = held @ new_
            new += given[..., 2 * hid :]
            np.clip(new, -1, 1, out=new)
            after = new - state
            after *= gates[..., :hid]
            after += state
            if keep:
                tape.append((state, gates, held, new))
            state = after
            np.matmul(state, p["w"], out=scores[t])
        return scores, tape, state

    def logits(self, codes: np.ndarray, live: np.ndarray) -> np.ndarray:
        """steps x windows x languages; live tells which bytes are there, from the left."""
        lengths = live.sum(1)
        scores, _, _ = self._pass(self._ways(codes, lengths), False)
        return scores[:, 0] + self._turned(scores[:, 1], lengths) + self.p["o"]

    def log_probabilities(self, words: list[bytes], first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """For each window, the sum of the log-probabilities of the languages over the bytes it labels."""
        out = np.zeros((len(words), len(self.languages)), "f4")
        sizes = np.array([len(w) for w in words], np.int64)
        first, last = np.zeros(len(words), np.int64) if first is None else first, sizes if last is None else last
        order = np.argsort(sizes, kind="stable")
        for i in range(0, len(order), TOGETHER):
            own = order[i : i + TOGETHER]
            codes, lengths = pad([words[k] for k in own])
            at = np.arange(codes.shape[1])
            x = self.logits(codes, at < lengths[:, None])
            x -= x.max(2, keepdims=True)
            x -= np.log(np.exp(x).sum(2, keepdims=True))
            counts = (at[:, None] >= first[own]) & (at[:, None] < last[own])
            out[own] = (x * counts[:, :, None]).sum(0)
        return out

    def train(self, words: list[bytes], labels: np.ndarray, weights: np.ndarray | None = None, epochs: int | None = None, batch: int = BATCH, rate: float = 0.015, seed: int = 3) -> ByteTagger:
        """Backpropagation through time with Adam; the loss is the weighted cross-entropy at every byte."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        epochs = epochs or min(100, -(-STEPS * batch // len(words)))
        step, total = 0, epochs * -(-len(words) // batch)
        weights = np.ones(len(words), "f4") if weights is None else weights
        sizes = np.array([len(w) for w in words])
        for _ in range(epochs):
            order = r.permutation(len(words))
            order = order[np.argsort(sizes[order] // 32, kind="stable")]  # alike in length, else at random
            for i in r.permutation(np.arange(0, len(words), batch)).tolist():
                own = order[i : i + batch]
                grads = self._gradients([words[k] for k in own], labels[own], weights[own])
                step += 1
                now = rate * (1 - 0.95 * step / total)
                for k, g in grads.items():
                    np.clip(g, -0.1, 0.1, out=g)
                    m[k] += 0.1 * (g - m[k])
                    v2[k] += 0.01 * (g * g - v2[k])
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(g.dtype)
        return self

    def _gradients(self, words: list[bytes], labels: np.ndarray, weights: np.ndarray | None = None) -> dict[str, np.ndarray]:
        codes, lengths = pad(words)
        live = np.arange(codes.shape[1]) < lengths[:, None]
        hid, p = self.hidden, self.p
        ways = self._ways(codes, lengths)
        scores, tape, end = self._pass(ways, True)
        x = scores[:, 0] + self._turned(scores[:, 1], lengths) + p["o"]
        x = np.exp(x - x.max(2, keepdims=True))
        x /= x.sum(2, keepdims=True)
        x[:, np.arange(len(words)), labels] -= 1
        part = live.T[:, :, None] * (1.0 if weights is None else weights[None, :, None])
        x *= (part / part.sum()).astype(x.dtype)
        down = np.stack([x, self._turned(x, lengths)], 1)  # steps x 2 x windows x languages
        states = [s for s, *_ in tape[1:]] + [end]  # after each step
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"] = x.sum((0, 1))
        u1, u2 = p["u"][:, :, : 2 * hid].transpose(0, 2, 1), p["u"][:, :, 2 * hid :].transpose(0, 2, 1)
        w, carry = p["w"].transpose(0, 2, 1), np.zeros_like(end)
        inputs = g["x"].reshape(512, -1)
        for t in range(len(ways) - 1, -1, -1):
            before, gates, held, new = tape[t]
            g["w"] += states[t].transpose(0, 2, 1) @ down[t]
            inner = carry + down[t] @ w
            whole = np.empty((*inner.shape[:2], 3 * hid), inner.dtype)
            whole[..., :hid] = inner * (new - before)
            dn = inner * gates[..., :hid] * ((new > -1) & (new < 1))
            dheld = dn @ u2
            whole[..., hid : 2 * hid] = dheld * before
            whole[..., : 2 * hid] *= 0.25 * ((gates > 0) & (gates < 1))
            whole[..., 2 * hid :] = dn
            carry = inner * (1 - gates[..., :hid]) + dheld * gates[..., hid:] + whole[..., : 2 * hid] @ u1
            np.add.at(inputs, ways[t], whole)
            g["u"][:, :, : 2 * hid] += before.transpose(0, 2, 1) @ whole[..., : 2 * hid]
            g["u"][:, :, 2 * hid :] += held.transpose(0, 2, 1) @ dn
        g["c"] = g["x"].sum(1)
        return g


def train_tagger(docs: DataFrame, most_docs: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> ByteTagger | None:
    """A tagger for the languages of docs (doc_id, text, lang), from a bounded sample of them.

    The sample: of the most_docs distinct rows whose hashed ids are least, those that fit into most_bytes in that
    order (the first in any case), each with its whole text. Bytes of a language that is rare in it weigh more.
    None if no document has a language and letters.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    drawn = usable.select("doc_id", "h", "lang", "n").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h", "lang").limit(most_docs).collect()
    picked, size = [], 0
    for r in drawn:
        if not picked or size + r.n <= most_bytes:
            picked.append((r.doc_id, r.h, r.lang))
            size += r.n
    if not picked:
        return None
    chosen = docs.sparkSession.createDataFrame(picked, usable.select("doc_id", "h", "lang").schema)
    same = [usable.doc_id.eqNullSafe(chosen.doc_id), usable.h == chosen.h, usable.lang == chosen.lang]
    rows = usable.join(F.broadcast(chosen), same, "left_semi").select("lang", "text").distinct().collect()  # most_docs and most_bytes bound it
    texts = sorted((r.lang, r.text) for r in rows if has_letters(r.text))
    if not texts:
        return None
    languages = sorted({lang for lang, _ in texts})
    held, own, _, _ = windows([t for _, t in texts])
    labels = np.array([languages.index(lang) for lang, _ in texts])[own]
    weight = np.bincount(labels, [len(w) for w in held], len(languages))
    weight = np.minimum(weight.max() / weight, 30.0).astype("f4")
    return ByteTagger(languages).train(held, labels, weight[labels])


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
def predict(tagger: ByteTagger | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Of each text the language of the largest pooled log-probability, and its share."""
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if has_letters(t)]
    if tagger is not None and at:
        for part in _portions(texts, at):
            held, own, first, last = windows([texts[i] for i in part])
            sums = np.zeros((len(part), len(tagger.languages)))
            np.add.at(sums, own, tagger.log_probabilities(held, first, last))
            p = np.exp((sums - sums.max(1, keepdims=True)) / TEMPERATURE)
            p /= p.sum(1, keepdims=True)
            for i, k, share in zip(part, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                lang[i], score[i] = tagger.languages[k], share
    return lang, score.tolist()


def _portions(texts: list[str | None], at: list[int], most: int = 4 << 20):
    """Places of texts in portions of about `most` characters, so that few windows are held at a time."""
    held, size = [], 0
    for i in at:
        held.append(i)
        size += len(texts[i])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def screen(docs: DataFrame, tagger: ByteTagger | None, least: float = LEAST) -> DataFrame:
    """The rows of docs, with all their columns, whose language is told with a score of at least `least`.

    A null lang, if there is such a column, becomes the predicted one. A null or empty text, or one without letters,
    goes. Without a tagger every row with a letter stays. Rows are judged one by one by their whole texts, so
    repeated rows, null ids and very long texts need nothing special; columns named like this module's own
    (lang_pred, score) are carried as they are. An empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            if tagger is None:
                keep = [has_letters(t) for t in texts]
            else:
                lang, score = predict(tagger, texts)
                keep = [k != UNKNOWN and s >= least for k, s in zip(lang, score, strict=True)]
                if "lang" in names:
                    known = [a if a is not None else k for a, k in zip(b.column("lang").to_pylist(), lang, strict=True)]
                    b = b.set_column(names.index("lang"), "lang", pa.array(known, pa.string()))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, tagger: ByteTagger | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text).

    The network reads the whole text in lower case as bytes, in both directions and over the borders of words, in
    windows that overlap by CONTEXT on either side; every byte gets its label from one of them, and the
    log-probabilities are summed over all bytes. A text without letters, an empty or a null text is `und` with score
    0, as is everything where nothing could be learned. Rows map one to one; repeated rows, null ids and empty
    tables need nothing special; other columns are not looked at.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            lang, score = predict(tagger, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=SCHEMA.names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def held_out() -> F.Column:
    return id_crc() % 4 == 2


def op9_byte_recurrent_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    tagger = train_tagger(docs.where(~held_out()))
    out = identify(docs, tagger)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
