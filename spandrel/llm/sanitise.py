"""Operator 11: personal data, and the terms that give it away.

E-mail and IP addresses, card and phone numbers are found by pattern. They are the protected entities. Terms that stand
within WINDOW words of an entity are counted over the whole corpus against all their occurrences: the pointwise mutual
information of term and entity, as a share of the entity's information content, is how much of it the term discloses.
A term that discloses DISCLOSURE or more, and does so in CONTEXTS or more different contexts (two to the power of their
min-entropy, so that a passage copied with small changes counts as about one), is generalised to the first of its more
general forms that does not, or removed.

Counts are DataFrame aggregations; what a task needs to know of the terms in question comes as a Bloom filter of one
size for any input, and a join with the exact terms follows it.
"""

from __future__ import annotations

import functools
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.common import durable, mix64, prepare, relax, table

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words on either side of an entity that count as near it; the shares and numbers that make a term disclosing.
WINDOW, DISCLOSURE, CONTEXTS = 8, 0.9, 3.0
#: Bits of the filter of terms, and how many each term sets.
BITS, PROBES = 1 << 23, 4
#: The base of a form's polynomial, and the characters of the words that the filter is asked for at once.
BASE, SLICE = 0x9E3779B97F4A7C15, 1 << 19

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_MAYBE_IP = re.compile(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a run of digits that fails from its start fails from within
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
_MASK = str.maketrans(string.digits, "#" * 10)
_EDGES = string.punctuation + "«»„“”‘’…¿¡–—"


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with local characters before it, back to the end of the last match, and a domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start. Time is linear in the text, whatever it holds."""
    out = [("email", s, e) for s, e in _emails(text)]
    if _MAYBE_IP.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def entity(kind: str, value: str) -> str:
    """An entity whatever way it is written: case of addresses, separators of numbers and zeros before them are nothing."""
    if kind == "email":
        return "email:" + value.lower()
    if kind == "ip":
        return "ip:" + ".".join(str(int(p[-4:])) for p in value.split("."))
    return f"{kind}:" + "".join(c for c in value if c.isdigit())


def ladder(word: str) -> tuple[str, ...]:
    """The forms of a word, the most special first: itself, with digits masked, its first letters. Empty: no term."""
    core = word.strip(_EDGES).lower()
    if len(core) < 3:
        return ()
    masked = core if core.isalpha() else core.translate(_MASK)
    out = ("0:" + core,) if masked == core else ("0:" + core, "1:" + masked)
    return (*out, "2:" + masked[:4]) if len(core) > 6 else out


def _hash(form: str) -> int:
    return xxhash.xxh3_64_intdigest(form)


def mentions(text: str) -> list[tuple[str, int, int, list[tuple[str, int, int]]]]:
    """(entity, hash of the words around it, their number, [(form, how often, context)]) of each entity.

    The context of a form is the word of least hash among the others: equal in copies that differ in other words.
    """
    spans = base_spans(text)
    if not spans:
        return []
    cover = sorted((s, e) for _, s, e in spans)
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    starts = np.array([w[0] for w in words])
    ends = np.array([w[1] for w in words])
    free = np.ones(len(words), bool)
    for s, e in cover:  # words that hold a part of an entity
        free[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e, "left")] = False
    places = np.flatnonzero(free)
    out = []
    for kind, s, e in spans:
        left = places[: np.searchsorted(places, np.searchsorted(ends, s, "right"))][-WINDOW:]
        right = places[np.searchsorted(places, np.searchsorted(starts, e, "left")) :][:WINDOW]
        near = [words[k][2] for k in (*left, *right)]
        forms = [ladder(w) for w in near]
        hashes = sorted({_hash(f[0]) for f in forms if f})
        count = Counter(x for f in forms for x in f)
        of = {x: _hash(f[0]) for f in forms for x in f}
        least = lambda x: next((h for h in hashes if h != of[x]), 0)
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        out.append((entity(kind, text[s:e]), signed(_hash("\0".join(near))), len(near), [(x, n, signed(least(x))) for x, n in count.items()]))
    return out


MENTION = "entity string, win long, words long, terms array<struct<form: string, n: long, context: long>>"


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = pa.list_(pa.struct([("form", pa.string()), ("n", pa.int64()), ("context", pa.int64())]))
    for b in batches:
        found = [m for text in b.column("text").to_pylist() if text for m in mentions(text)]
        named = [[dict(zip(("form", "n", "context"), t, strict=True)) for t in m[3]] for m in found]
        columns = [pa.array([m[0] for m in found], pa.string()), *(pa.array([m[k] for m in found], pa.int64()) for k in (1, 2)), pa.array(named, terms)]
        yield pa.RecordBatch.from_arrays(columns, names=["entity", "win", "words", "terms"])
    relax()


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power 0, 1, 2 ... and its inverse likewise, modulo 2^64."""
    n = 2 * size + 2  # one character becomes two at most when it is lower-cased
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))


class Filter:
    """A Bloom filter of forms, which is asked for the words of many texts at once.

    A form is known by its level and by a polynomial of its characters. One running sum over the characters of many
    words gives those of all of them, and of their beginnings.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self._bytes = np.frombuffer(words.astype("<u8").tobytes(), np.uint8)

    @staticmethod
    def sums(codes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(SLICE)[0][: len(codes)], dtype=np.uint64)])

    @staticmethod
    def keys(sums: np.ndarray, start: np.ndarray, end: np.ndarray, level: np.ndarray | int) -> np.ndarray:
        """What the forms of a level are known by whose characters stand from start to end."""
        return mix64((sums[end] - sums[start]) * _powers(SLICE)[1][start] + np.asarray(level, np.uint64) * np.uint64(BASE))

    @staticmethod
    def probe(keys: np.ndarray, k: int) -> np.ndarray:
        return ((keys + np.uint64(k) * ((keys >> np.uint64(32)) | np.uint64(1))) & np.uint64(BITS - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of the forms may be in the filter."""
        left = np.arange(len(keys))
        for k in range(PROBES):
            p = self.probe(keys[left], k)
            left = left[(self._bytes[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out

    @classmethod
    def of(cls, forms: DataFrame) -> Filter | None:
        """The filter of a column form; None if there is none. At most BITS / 64 numbers come to the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(BITS >> 6, np.uint64)
            some = False
            for b in batches:
                for _, codes, start, end in _joined(b.column("form")):
                    some = True
                    if codes is not None:
                        keys = cls.keys(cls.sums(codes), start + 2, end, codes[start] - np.uint64(ord("0")))
                        for p in (cls.probe(keys, k) for k in range(PROBES)):
                            np.bitwise_or.at(words, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
            at = np.flatnonzero(words)
            if some and not len(at):
                at = np.zeros(1, np.int64)  # words that are too long for a slice need no bit
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(words[at].view(np.int64))], names=["at", "bits"])

        got = forms.select("form").mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect()
        if not got:
            return None
        words = np.zeros(BITS >> 6, np.int64)
        words[[r["at"] for r in got]] = [r.bits for r in got]
        return cls(words.view(np.uint64))

    def among(self, words: pa.Array) -> np.ndarray:
        """Which of these words may have a form in the filter; those that have one are all told."""
        out = np.ones(len(words), bool)
        for part, codes, start, end in _joined(pc.utf8_trim(words, characters=_EDGES)):
            if codes is None:
                continue
            digit = (codes >= ord("0")) & (codes <= ord("9"))
            plain, masked = self.sums(codes), self.sums(np.where(digit, np.uint64(ord("#")), codes))
            size = end - start
            known = self.has(self.keys(plain, start, end, 0))
            at = np.unique(np.searchsorted(end, np.flatnonzero(digit)))
            known[at] |= self.has(self.keys(masked, start[at], end[at], 1))
            at = np.flatnonzero(size > 6)
            known[at] |= self.has(self.keys(masked, start[at], start[at] + 4, 2))
            out[part] = known & (size >= 3)
        return out


def _joined(strings: pa.Array) -> Iterator[tuple[slice, np.ndarray | None, np.ndarray, np.ndarray]]:
    """Slices of strings with the code points of all in lower case, and where each begins and ends; for one that is too long, None."""
    ends = np.cumsum(pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(strings):
        to = int(np.searchsorted(ends, SLICE + (ends[at - 1] if at else 0), "right"))
        if to <= at:
            yield slice(at, at + 1), None, np.zeros(1, np.int64), np.zeros(1, np.int64)
            at += 1
            continue
        part = strings.slice(at, to - at)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), "\n")[0].as_py().lower() + "\n"
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        end = np.flatnonzero(codes == 10)
        yield slice(at, to), codes.astype(np.uint64), np.concatenate([[0], end[:-1] + 1]), end
        at = to


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and the number of its text for each."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # at the six blanks of ASCII
    flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), np.repeat(np.arange(len(n)), n)[full.to_numpy(zero_copy_only=False)]


def occurrences(docs: DataFrame, known: Filter) -> DataFrame:
    """(form, n): how often forms in the filter stand in all texts; form null: the number of all words."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(known.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Filter(held.value)
        for b in batches:
            words, _ = _words(b.column("text"))
            n: Counter = Counter()
            for w, times in Counter(words.filter(pa.array(seen.among(words))).to_pylist()).items():
                for f in ladder(w):
                    n[f] += times
            yield pa.RecordBatch.from_arrays([pa.array([None, *n], pa.string()), pa.array([len(words), *n.values()], pa.int64())], names=["form", "n"])
        relax()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, share: float = DISCLOSURE, contexts: float = CONTEXTS) -> DataFrame:
    """(form, entities, disclosure): the forms that disclose an entity, how many they do, and the greatest share."""
    spark = docs.sparkSession
    found = durable(docs.select("text").where(F.col("text").rlike("[@+0-9]")).mapInArrow(_mentions, MENTION), "mentions")
    windows = found.groupBy("entity", "win").agg(F.count(F.lit(1)).alias("times"), F.any_value("words").alias("words"), F.any_value("terms").alias("terms"))
    windows = durable(windows, "windows")
    entities = windows.groupBy("entity").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.col("times") * F.col("words")).alias("n_near")).where(F.col("windows") >= contexts)
    pairs = windows.join(entities.select("entity"), "entity", "left_semi").select("entity", "times", F.explode("terms").alias("t")).select("entity", "times", "t.*")
    # one row for each context, so that a hot entity or term is many groups first
    by_context = pairs.groupBy("entity", "form", "context").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("times") * F.col("n")).alias("n_both"))
    pairs = by_context.groupBy("entity", "form").agg((F.sum("c") / F.max("c")).alias("contexts"), F.sum("n_both").alias("n_both"))
    pairs = durable(pairs.where(F.col("contexts") >= contexts).join(entities, "entity"), "pairs")
    known = Filter.of(pairs.select("form").distinct())
    if known is None:  # no term stands near an entity in enough contexts, so there is nothing to count
        return spark.createDataFrame([], "form string, entities long, disclosure double")
    counts = durable(occurrences(docs, known), "counts")
    total = counts.where("form is null").first().n
    together = F.least(F.col("n_both"), F.col("n"))
    content = F.log2(F.lit(float(total)) / F.col("n_near"))
    told = 1 + F.log2(together / F.col("n")) / content  # mutual information over information content
    out = pairs.join(counts.where("form is not null"), "form").where(content > 0).select("form", "entity", told.alias("told")).where(F.col("told") >= share)
    return durable(out.groupBy("form").agg(F.count(F.lit(1)).alias("entities"), F.max("told").alias("disclosure")), "disclosing")


_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_TERMS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("forms", pa.list_(pa.string()))]))
SCANNED = "base array<struct<kind: string, start: int, end: int>>, found array<struct<start: int, end: int, forms: array<string>>>"


def _scan(docs: DataFrame, known: Filter | None, whole: bool) -> DataFrame:
    """doc_id, base spans, and words with a form in the filter that touch none of them (and the text, if asked for)."""
    held = docs.sparkSession.sparkContext.broadcast(known.words) if known else None
    names = ["doc_id", "text"] if whole else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Filter(held.value) if held else None
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            hits: dict[int, dict[str, tuple[str, ...]]] = {}  # of each text, its words that may have such a form
            if seen:
                words, of = _words(b.column("text"))
                at = np.flatnonzero(seen.among(words))
                for k, w in zip(of[at].tolist(), words.take(pa.array(at)).to_pylist(), strict=True):
                    own = hits.setdefault(k, {})
                    if w not in own:
                        own[w] = ladder(w)
            base, found = [], []
            for k, text in enumerate(texts):
                spans = base_spans(text)
                own = []
                if k in hits:
                    taken = sorted((s, e) for _, s, e in spans)
                    for m in _WORD.finditer(text):
                        if forms := hits[k].get(m[0]):
                            core = m[0].strip(_EDGES)
                            s = m.start() + len(m[0]) - len(m[0].lstrip(_EDGES))
                            if not any(a < s + len(core) and s < z for a, z in taken):
                                own.append({"start": s, "end": s + len(core), "forms": forms})
                base.append([{"kind": x, "start": s, "end": e} for x, s, e in spans])
                found.append(own)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(base, _BASE), pa.array(found, _TERMS)], names=[*names, "base", "found"])
        relax()

    kinds = "doc_id long, text string, " if whole else "doc_id long, "
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds + SCANNED)


def spans(docs: DataFrame, revealing: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """doc_id, base (kind, start, end) and terms (start, end, instead) of each text, and the text if whole.

    base holds what base_spans() finds; terms the words that disclose an entity and overlap none, with what they are
    generalised to, empty where each of their forms discloses. A null text is empty; repeated rows and null ids count
    each by itself; columns of other names are not looked at; an empty table stays empty.
    """
    prepare(docs.sparkSession)
    revealing = disclosing(docs) if revealing is None else revealing
    known = Filter.of(revealing)
    none = F.array().cast("array<struct<start: int, end: int, instead: string>>")
    scanned = _scan(docs, known, whole)
    if known is None:
        return scanned.withColumn("terms", none).drop("found")
    scanned = durable(scanned.withColumn("row", F.monotonically_increasing_id()), "spans")
    words = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("w")).select("row", "w.start", "w.end", F.posexplode("w.forms").alias("level", "form"))
    words = words.join(revealing.select("form", F.lit(True).alias("told")), "form", "left")
    # the first form after the last that tells something
    last = F.max(F.when(F.col("told"), F.col("level")))
    step = words.groupBy("row", "start", "end").agg(last.alias("last"), F.array_sort(F.collect_list(F.struct("level", "form"))).alias("forms"))
    step = step.where("last is not null").withColumn("form", F.coalesce(F.get(F.col("forms"), F.col("last") + 1)["form"], F.lit("")))
    step = step.withColumn("instead", F.concat(F.expr("substring(form, 3)"), F.when(F.col("form").startswith("2:"), "*").otherwise("")))
    own = step.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "instead"))).alias("terms"))  # of one text
    return scanned.drop("found").join(own, "row", "left").withColumn("terms", F.coalesce("terms", none)).drop("row")


def _named(spans: Column, kind: Column | None = None) -> Column:
    """kind:start:end of spans, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"] if kind is None else kind, s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def sanitise(docs: DataFrame, revealing: DataFrame | None = None) -> DataFrame:
    """doc_id, the text without personal data, base and terms: entities become <KIND>, terms what they are generalised to."""
    found = spans(docs, revealing, whole=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [replaced(t or "", base, terms) for t, base, terms in zip(*(b.column(n).to_pylist() for n in ("text", "base", "terms")), strict=True)]
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(clean, pa.string()))

    return found.mapInArrow(run, found.schema)


def replaced(text: str, base: list[dict], terms: list[dict]) -> str:
    """Of entities that overlap, the one that begins first, and of those the longest, gives its name to what they cover."""
    marks = sorted([(s["start"], -s["end"], f"<{s['kind'].upper()}>") for s in base] + [(s["start"], -s["end"], s["instead"]) for s in terms])
    out, at = [], 0
    for start, end, instead in marks:
        if start >= at:
            out += [text[at:start], instead]
        at = max(at, -end)
    return "".join([*out, text[at:]])


def op11_disclosure_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    every = F.array_join(F.filter(F.array(_named(F.col("base")), _named(F.col("terms"), F.lit(TERM))), lambda x: x != ""), ",")
    return found.select("doc_id", *counts, F.sha2(_named(F.col("base")), 256).alias("base_sha256"), every.alias("spans"), F.size("terms").cast("bigint").alias("n_term"))
