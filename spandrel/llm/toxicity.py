"""Toxic passages as maximal scoring segments, calibrated as extreme values (operator 1)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.common import Bounded, durable, forget, id_crc, prepare, table

#: The bounded sample of labelled rows that the word scores and the calibration are learned from. It is the only
#: bound: the lexicon has the features of its toxic documents, and the fits see every word and passage of it.
TRAIN_DOCS = 20_000
#: A feature counts as toxic if the z of its log-odds is at least this, in at least so many toxic documents.
LEAST_Z, LEAST_DOCS = 3.2, 4
#: The Dirichlet prior of a feature: an equal part for each, and a weight spread as the features occur.
EQUAL, PRIOR = 0.5, 500.0
#: Word scores are counted in bins of this width when the extreme-value law is fitted.
BIN = 1 / 64
#: The share of toxic words in a toxic passage: the score of any other word is log(1 - share).
PASSAGE_SHARE = 0.08
#: Log-odds of a feature are cut off here, so one word alone cannot make any passage significant.
MOST_SCORE = 6.0
#: A passage is significant if its p-value over the document is below this.
SIGNIFICANT = 0.05
REJECT = 0.7

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def features(word: str) -> list[str]:
    """The word, and its beginnings: a stem can be toxic whatever follows it."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one scan, by Ruzzo and Tompa's rule.

    A maximal segment has no part of a higher score and is in no larger one of this kind. Each candidate keeps
    the cumulative scores before it and at its end; a new one joins back to the nearest candidate that began
    lower, if that one ended lower too.
    """
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype="f8")])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at the end, nearest that began lower
    for i in hits.tolist():
        start, end, before, after = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= before:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= after:
                stack.append((start, end, before, after, k))
                break
            start, before = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, d - c) for a, b, c, d, _ in stack]


@dataclass
class Model:
    """Scores of features, the extreme-value law of clean text, and a logistic map to probabilities."""

    scores: dict[str, float] = field(default_factory=dict)
    other: float = float(np.log1p(-PASSAGE_SHARE))
    decay: float = 1.0  # lambda and K of P(best >= s) = 1 - exp(-K n exp(-lambda s))
    rate: float = 0.1
    weights: tuple[float, ...] = (-3.0, 1.0, 0.0, 0.0)

    def __post_init__(self):
        self.memo = Bounded(self.score, most=250_000)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def score(self, word: str) -> float:
        found = [s for f in features(word) if (s := self.scores.get(f)) is not None]
        return max(found) if found else self.other

    def passages(self, text: str) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        """The scores of all words of a text, and its maximal segments."""
        words = WORD.findall(text.lower())
        got = np.fromiter(map(self.memo.__getitem__, words), "f4", len(words))
        return got, segments(got)

    def surprise(self, n: int, score: float) -> float:
        """-ln of the chance that clean text of n words has a segment of this score."""
        e = np.log(max(self.rate * max(n, 1), 1e-12)) - self.decay * score  # log of the expected number
        return float(-e if e < -20 else -np.log(-np.expm1(-np.exp(min(e, 30)))))

    def summary(self, text: str | None) -> tuple[float, float, float, list[tuple[int, int, float]]]:
        """Surprise of the best passage, of all significant ones together, their number, and they themselves."""
        scores, found = self.passages(text or "")
        n = len(scores)
        if not found:
            return 0.0, 0.0, 0.0, []
        limit = -np.log(SIGNIFICANT)
        each = [(self.surprise(n, s), (a, b, s)) for a, b, s in found]
        kept = [x for x in each if x[0] >= limit]
        return max(x[0] for x in each), sum(x[0] for x in kept), float(len(kept)), [p for _, p in kept]

    def inputs(self, best: float, total: float, number: float) -> np.ndarray:
        return np.array([1.0, np.log1p(best), np.log1p(total), np.log1p(number)])

    def probability(self, best: float, total: float, number: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, self.inputs(best, total, number)), -30, 30))))


def _decay(scores: np.ndarray, counts: np.ndarray, n_words: float, other: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 for the scores of clean words: positive ones, and `other`."""
    low, high = 1e-3, 20.0
    for _ in range(80):
        x = (low + high) / 2
        value = ((counts * np.exp(np.minimum(x * scores, 600))).sum() + (n_words - counts.sum()) * np.exp(x * other)) / n_words
        low, high = (x, high) if value < 1 else (low, x)
    return low


def _sample(docs: DataFrame, labels: DataFrame | None, most: int) -> DataFrame:
    """Texts with their labels: of at most `most` distinct rows, those of the least hashed ids and texts.

    A text that stands in several of them counts once, and is toxic if one row says so. Rows are chosen by ids and
    hashes, so that only the texts of the chosen ones are shuffled.
    """
    h = F.xxhash64("text").alias("h")
    usable = docs.where("text is not null")
    keys = usable.select("doc_id", h, "toxic") if labels is None else labelled_rows(usable.select("doc_id", h), labels, "h")
    keys = keys.where("toxic is not null").groupBy("doc_id", "h").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = keys.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "h").limit(most)
    texts = usable.select("doc_id", "text", h)
    rows = texts.join(F.broadcast(chosen), [texts.doc_id.eqNullSafe(chosen.doc_id), texts.h == chosen.h]).select("text", "toxic")  # at most `most` keys
    return durable(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Log-odds of the features that stand out in toxic texts, under an informative Dirichlet prior.

    A feature's prior is EQUAL plus its share of PRIOR in proportion to its count in all texts; the prior's mass
    is the sum of these over all features.
    """

    def count(batches):
        for b in batches:
            tally: dict[str, list[int]] = {}
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for f in {f for w in set(WORD.findall(text.lower())) for f in features(w)}:  # a text that repeats a word counts once
                    tally.setdefault(f, [0, 0])[0 if toxic else 1] += 1
            rows = list(tally.items())
            for i in range(0, len(rows), 50_000):
                part = rows[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part]), *(pa.array([r[k] for _, r in part], pa.int64()) for k in range(2))], names=["f", "toxic", "clean"])

    counts = sample.mapInArrow(count, "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = durable(counts, "toxic-counts")
    n1, n0, kinds = counts.agg(F.sum("toxic"), F.sum("clean"), F.count(F.lit(1))).first()
    if not n1 or not n0:
        return {}
    mass = EQUAL * kinds + PRIOR
    prior = F.lit(EQUAL) + F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / F.lit(float(n1 + n0))
    y1, y0 = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.ln(y1 / (F.lit(n1 + mass) - y1)) - F.ln(y0 / (F.lit(n0 + mass) - y0))
    kept = (
        counts.where((F.col("toxic") >= LEAST_DOCS) & (y1 < n1 + mass) & (y0 < n0 + mass))
        .select("f", odds.alias("odds"), (odds / F.sqrt(1 / y1 + 1 / y0)).alias("z"))
        .where((F.col("z") >= LEAST_Z) & (F.col("odds") >= 1.0))
    )
    found = {r.f: min(MOST_SCORE, r.odds) for r in kept.select("f", "odds").collect()}
    forget(counts)
    return found


def _calibrate(model: Model, sample: DataFrame) -> None:
    """Fit lambda and K of the extreme-value law to the clean texts: all their words, and their best segments."""

    def measure(batches):
        hits: dict[int, int] = {}
        n_words = n_high = 0
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not toxic:
                    scores, found = model.passages(text)
                    n_words += len(scores)
                    n_high += max((s for _, _, s in found), default=0.0) >= 1.0
                    bins, counts = np.unique(np.rint(scores[scores > 0] / BIN).astype(int), return_counts=True)
                    for k, c in zip(bins.tolist(), counts.tolist(), strict=True):
                        hits[k] = hits.get(k, 0) + c
        rows = [(-1, n_words), (-2, n_high), *hits.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.int64())], names=["bin", "n"])

    seen = {r.bin: r.n for r in sample.mapInArrow(measure, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    n_words, n_high = float(seen.pop(-1, 0)), seen.pop(-2, 0)
    bins = np.array(sorted(seen), float)
    counts = np.array([seen[int(k)] for k in bins], float)
    model.decay = min(_decay(bins * BIN, counts, max(n_words, counts.sum() + 1.0), model.other), 5.0)
    # each clean document is expected to have K n exp(-lambda s) segments beyond s = 1
    model.rate = float(max((n_high + 0.5) / (max(n_words, 1.0) * np.exp(-model.decay) + 1e-9), 1e-6))


def learn(docs: DataFrame, most: int = TRAIN_DOCS, labels: DataFrame | None = None) -> Model:
    """A model from rows (doc_id, text, toxic); at most `most` distinct ones, those of the least hashed ids.

    With labels (doc_id, toxic) it is learned from labelled_rows() of both, whose texts are not joined whole.
    Words are counted where the rows are; only features that pass LEAST_Z and LEAST_DOCS, bins of scores and three
    numbers for each text come to the driver. Without toxic or clean rows nothing scores.
    """
    prepare(docs.sparkSession)
    sample = _sample(docs, labels, most)
    model = Model(scores=_lexicon(sample), weights=(-3.0, 0.0, 0.0, 0.0))
    if not model.scores:
        return model
    _calibrate(model, sample)

    def measure(batches):
        for b in batches:
            rows = [model.summary(t)[:3] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(3))], names=["toxic", "best", "total", "number"])

    seen = sample.mapInArrow(measure, "toxic int, best double, total double, number double").collect()  # a row for each text of the sample
    seen.sort()
    x = np.array([model.inputs(r.best, r.total, r.number) for r in seen])
    model.weights = tuple(_logistic(x, np.array([float(bool(r.toxic)) for r in seen])))
    forget(sample)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


PASSAGE = T.ArrayType(T.StructType([T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()), T.StructField("score", T.DoubleType())]))
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("passages", PASSAGE)])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the significant passages (words, counted from 0) of every row of docs (doc_id, text).

    The whole text is scanned once. A null, empty or wordless text has no passage and the score of a clean
    one. Rows map one to one, so repeated rows, null ids and empty tables need nothing special; other columns
    of docs are not looked at.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = [model.summary(t) for t in b.column(1).to_pylist()]
            passages = [[{"start_word": a, "end_word": e, "score": float(s)} for a, e, s in g[3]] for g in got]
            kind = pa.list_(pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.probability(*g[:3]) for g in got], pa.float64()), pa.array(passages, kind)], names=SCHEMA.names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def held_out() -> F.Column:
    return id_crc() % 3 == 1


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str = "text") -> DataFrame:
    """Texts (or another column) with labels that may be learned from; a document with several labels is toxic if one says so."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", column).where(~held_out()).join(one.where(~held_out()), "doc_id")


def op1_scoring_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, with the passages (words from 0) that made them."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, labels=table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "passages")


def screen(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below reject.

    A null, empty or wordless text scores as a clean one and stays. Rows are judged one by one by their texts, so
    repeated rows, null ids and very long texts need nothing special; columns named like this module's own (score,
    passages) are carried as they are. An empty table gives an empty one.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            keep = [model.probability(*model.summary(t)[:3]) < reject for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
