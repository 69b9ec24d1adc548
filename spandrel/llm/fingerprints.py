"""Passages that stand more than once, by a log-structured fingerprint index (operator 8)."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm import fragments
from spandrel.llm.common import durable, forget, prepare, release, shared_dir, table

LENGTH, GRAM = 35, 8
#: The registered query adds the chunks in so many batches; runs of a level are compacted when there are FANIN.
BATCHES, FANIN = 3, 2
#: Files of a run, at most: each holds the buckets of one hash class.
FILES = 4096
#: Windows that a bucket compares at a time, at some hundred bytes of memory each.
WINDOWS = 1 << 17

MANIFEST = re.compile(r"manifest-([0-9]+)\.json")
RUN = "bucket long, hashes binary, state binary, holder binary"
MERGED = "kind int, bucket long, chunk long, hashes binary, state binary, holder binary"


def merge(bucket: int, chunks: list[int], hashes: list[bytes], twice: list[bytes], runs: list[tuple[bytes, bytes, bytes]]) -> list[tuple]:
    """Merge-join the hashes that a batch has in a bucket with the bucket's part of each run; all are sorted.

    Gives the batch's own run (kind 0: distinct hashes, sorted, with one chunk that holds each and whether it is
    repeated) and answers (kind 1): to chunks of the batch, their hashes that stand elsewhere in it or in the
    history; to the holder of a hash that stood alone in the history, that it does no more.
    """
    each = [fragments.read48(x) for x in hashes]
    new, first, place, n = np.unique(np.concatenate(each), return_index=True, return_inverse=True, return_counts=True)
    holder = np.repeat(np.array(chunks, np.int64), [len(e) for e in each])[first]
    repeated = n > 1
    np.logical_or.at(repeated, place, np.frombuffer(b"".join(twice), np.uint8) > 0)
    known, alone = np.zeros(len(new), bool), np.full(len(new), -1, np.int64)
    for old, state, owner in runs:
        old, state, owner = fragments.read48(old), np.frombuffer(state, np.uint8), np.frombuffer(owner, "<i8")
        spot = np.minimum(np.searchsorted(old, new), len(old) - 1)
        hit = old[spot] == new
        single = hit & (state[spot] == 0)
        repeated |= hit
        known |= hit & ~single
        alone[single] = owner[spot][single]
    out = [(0, bucket, -1, fragments.write48(new), repeated.astype(np.uint8).tobytes(), holder.astype("<i8").tobytes())]
    at = 0
    for chunk, own in zip(chunks, each, strict=True):
        mine = repeated[place[at : at + len(own)]]
        at += len(own)
        if mine.any():
            out.append((1, bucket, chunk, fragments.write48(own[mine]), b"", b""))
    alone[known] = -1
    for chunk in np.unique(alone[alone != -1]).tolist():
        out.append((1, bucket, chunk, fragments.write48(new[alone == chunk]), b"", b""))
    return out


def compact(runs: list[tuple[bytes, bytes, bytes]]) -> tuple[bytes, bytes, bytes]:
    """One run of several: a hash that is in two of them, or repeated in one, is repeated."""
    each = np.concatenate([fragments.read48(h) for h, _, _ in runs])
    state = np.frombuffer(b"".join(s for _, s, _ in runs), np.uint8)
    holder = np.frombuffer(b"".join(o for _, _, o in runs), "<i8")
    values, first, inverse, n = np.unique(each, return_index=True, return_inverse=True, return_counts=True)
    again = n > 1
    np.logical_or.at(again, inverse, state > 0)
    return fragments.write48(values), again.astype(np.uint8).tobytes(), holder[first].astype("<i8").tobytes()


def beside(spine: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """spine (bucket, ...) with the columns h0, s0, o0, h1, ... of the runs' rows of its bucket.

    A left join keeps the spine's partitions, so the bucketed runs are read where they lie. (A union of bucketed
    tables does not do: it may claim partitions that it has not.)
    """
    for i, run in enumerate(runs):
        named = run.select(F.col("bucket").alias(f"b{i}"), F.col("hashes").alias(f"h{i}"), F.col("state").alias(f"s{i}"), F.col("holder").alias(f"o{i}"))
        spine = spine.join(named, spine.bucket == named[f"b{i}"], "left").drop(f"b{i}")
    return spine


def _runs(row: dict, n: int) -> list[tuple[bytes, bytes, bytes]]:
    return [(row[f"h{i}"], row[f"s{i}"], row[f"o{i}"]) for i in range(n) if row[f"h{i}"] is not None]


class FingerprintIndex:
    """Hashes of all anchors so far, in sorted immutable runs on disk; append() tells what a batch repeats.

    A run is a bucketed table: each distinct hash of its batches once, by bucket, so a passage that is everywhere is
    one entry, and runs meet a batch file by file without being shuffled again. When FANIN runs are of one level,
    they are compacted into a run of the next level and deleted, so there are about log(batches) runs at any time.
    Chunks and answers of every batch stay too: a later batch is compared in full with what it meets.

    The index is the folder `path`: a manifest, the runs, the chunks and the answers. FingerprintIndex(spark, path)
    opens it again, in any session. A batch counts once its manifest is written; what a lost append left behind is
    not named there and is never read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, units: fragments.Units | None = None, buckets: int = fragments.LEAST_BUCKETS, text: str = "text", fanin: int = FANIN):
        prepare(spark)
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        units = units or fragments.Units(LENGTH, GRAM, words=True)
        fresh = {"version": 0, "length": units.length, "gram": units.gram, "buckets": buckets, "files": min(buckets, FILES), "text": text, "fanin": fanin, "runs": [], "chunks": [], "answers": []}
        self.state = self._read() or fresh
        self.units = fragments.Units(self.state["length"], self.state["gram"], words=True)
        self.buckets, self.text = self.state["buckets"], self.state["text"]
        self.held: dict[str, str] = {}

    @property
    def runs(self) -> list[tuple[int, DataFrame]]:
        return [(level, self._run(name)) for level, name in self.state["runs"]]

    def chunks(self) -> DataFrame:
        return self._all("chunks", "chunk long, n_bytes long, payload binary")

    def answers(self) -> DataFrame:
        """Rows (bucket, chunk, hashes) of all batches: what is repeated, of chunks of any batch."""
        return self._all("answers", MERGED).where("kind = 1").select("bucket", "chunk", "hashes")

    def append(self, chunks: DataFrame) -> DataFrame:
        """Rows (bucket, chunk, hashes): what is repeated since this batch, of its chunks and of earlier ones."""
        sent = fragments.hashes_by_bucket(chunks, self.units, self.buckets, self.text, twice_within=True)
        batch = sent.groupBy("bucket").agg(F.collect_list(F.struct("chunk", "hashes", "twice")).alias("batch"))
        own = [run for _, run in self.runs]
        n = len(own)

        def meet(batches):
            for b in batches:
                for row in b.to_pylist():
                    held = [[x[k] for x in row["batch"]] for k in ("chunk", "hashes", "twice")]
                    c = list(zip(*merge(row["bucket"], *held, _runs(row, n)), strict=True))
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["kind", "bucket", "chunk", "hashes", "state", "holder"])

        merged = beside(batch, own).mapInArrow(meet, MERGED)
        answers = self._name("answers")
        release(self.spark)
        merged.write.option("compression", "zstd").parquet(f"{self.path}/{answers}")
        merged = self.spark.read.schema(MERGED).parquet(f"{self.path}/{answers}")
        run = self._store(merged.where("kind = 0").select("bucket", "hashes", "state", "holder"))
        self.state["answers"].append(answers)
        self.state["runs"].append([0, run])
        self._write()
        self.compact()
        return merged.where("kind = 1").select("bucket", "chunk", "hashes")

    def add(self, docs: DataFrame) -> DataFrame:
        """Store docs as chunks of this index and append them: the rows (bucket, chunk, hashes) of append()."""
        salt = uuid.uuid4().int >> 66  # chunks of all batches have numbers of their own
        chunks = fragments.to_chunks(docs, self.text, salt=salt)
        name = self._name("chunks")
        chunks.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        forget(chunks)
        self.state["chunks"].append(name)
        return self.append(self._batch(name))

    def last_chunks(self) -> DataFrame:
        return self._batch(self.state["chunks"][-1])

    def compact(self) -> None:
        while True:
            levels = [level for level, _ in self.state["runs"]]
            full = [level for level in sorted(set(levels)) if levels.count(level) >= self.state["fanin"]]
            if not full:
                return
            own = [name for level, name in self.state["runs"] if level == full[0]]
            new = self._store(self._compacted(own))
            self.state["runs"] = [x for x in self.state["runs"] if x[0] != full[0]] + [[full[0] + 1, new]]
            self._write()
            for name in own:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.held.pop(name)}")
                self._files().delete(self._at(name), True)

    def _compacted(self, names: list[str]) -> DataFrame:
        def join(batches):
            for b in batches:
                rows = [(row["id"], *compact(own)) for row in b.to_pylist() if (own := _runs(row, len(names)))]
                c = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "hashes", "state", "holder"])

        spine = self.spark.range(self.buckets).withColumn("bucket", F.col("id"))
        return beside(spine, [self._run(name) for name in names]).drop("bucket").mapInArrow(join, RUN)

    def close(self) -> None:
        """Take the runs out of this session's catalog; the folder stays and can be opened again."""
        for held in self.held.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {held}")
        self.held.clear()

    def delete(self) -> None:
        """Remove the whole folder."""
        self.close()
        self._files().delete(self._at(""), True)


    def _name(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def _batch(self, name: str) -> DataFrame:
        return self.spark.read.schema("chunk long, n_bytes long, payload binary").parquet(f"{self.path}/{name}")

    def _all(self, kind: str, schema: str) -> DataFrame:
        names = [f"{self.path}/{n}" for n in self.state[kind]]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _store(self, rows: DataFrame) -> str:
        name, files = self._name("run"), self.state["files"]
        self.held[name] = f"spandrel_{uuid.uuid4().hex}"
        rows = rows.repartition(files, "bucket").write.bucketBy(files, "bucket").sortBy("bucket").option("compression", "zstd")
        rows.option("path", f"{self.path}/{name}").format("parquet").saveAsTable(self.held[name])
        return name

    def _run(self, name: str) -> DataFrame:
        if name not in self.held:  # written by another session
            self.held[name] = f"spandrel_{uuid.uuid4().hex}"
            columns = "bucket BIGINT, hashes BINARY, state BINARY, holder BINARY"
            self.spark.sql(f"CREATE TABLE {self.held[name]} ({columns}) USING parquet CLUSTERED BY (bucket) SORTED BY (bucket) INTO {self.state['files']} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(self.held[name])

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[tuple[int, str]]:
        """(version, name) of the manifests in the folder, the newest first."""
        files = self._files()
        names = [s.getPath().getName() for s in files.listStatus(self._at(""))] if files.exists(self._at("")) else []
        return sorted(((int(m[1]), m[0]) for m in map(MANIFEST.fullmatch, names) if m), reverse=True)

    def _read(self) -> dict | None:
        """The newest state; None where there is none. A folder with runs but no manifest is no index."""
        found, files = self._manifests(), self._files()
        if not found:
            if files.exists(self._at("")) and any(s.getPath().getName().startswith("run-") for s in files.listStatus(self._at(""))):
                raise OSError(f"{self.path} holds runs, but no manifest")
            return None
        jvm, stream = self.spark.sparkContext._jvm, files.open(self._at(found[0][1]))
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _write(self) -> None:
        """A new version of the manifest: written beside, renamed to its number, and only then are older ones deleted. At
        any moment the newest whole one says what counts."""
        files, older = self._files(), self._manifests()
        self.state["version"] += 1
        draft = self._at(f"draft-{uuid.uuid4().hex}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        name = f"manifest-{self.state['version']}.json"
        if not files.rename(draft, self._at(name)):  # another session has written this version
            files.delete(draft, False)
            raise OSError(f"{name} of {self.path} could not be written")
        for _, old in older:
            files.delete(self._at(old), False)


def settle(answers: DataFrame, hot: int, met: DataFrame | None = None) -> DataFrame:
    """Rows (chunk, hashes, state) of all answers, with the same state for a hash wherever it is.

    met: rows (bucket, hashes); other hashes are left out.
    """

    def run(rows: pa.Table, wanted: pa.Table | None = None) -> pa.Table:
        chunk = np.array(rows.column("chunk").to_pylist(), np.int64)
        each = [fragments.read48(x) for x in rows.column("hashes").to_pylist()]
        if wanted is not None:
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(fragments.read48(x) for x in wanted.column("hashes").to_pylist())]))
            each = [e[np.isin(e, keys)] for e in each]
        owners = np.repeat(chunk, [len(e) for e in each])
        flat = np.concatenate([np.zeros(0, np.uint64), *each])
        order = np.lexsort((flat, owners))
        owners, flat = owners[order], flat[order]
        new = np.concatenate([[True], (owners[1:] != owners[:-1]) | (flat[1:] != flat[:-1])])[: len(flat)]
        owners, flat = owners[new], flat[new]
        held, first = np.unique(owners, return_index=True)
        parts = np.split(flat, first[1:])
        return fragments.answers(held.tolist(), parts if len(held) else [], np.ones(len(flat), np.uint8), hot)

    schema = "chunk long, hashes binary, state binary"
    if met is None:
        return answers.groupBy("bucket").applyInArrow(lambda t: run(t), schema)
    return answers.groupBy("bucket").cogroup(met.groupBy("bucket")).applyInArrow(lambda a, b: run(a, b), schema)


class _Count:
    """Of each window the number of places where it stands, its words compared in full."""

    combine, within = "sum", True

    def __init__(self, length: int, most: int = WINDOWS):
        self.length, self.most = length, most

    def __call__(self, texts: list[bytes], sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        ids: dict[bytes, int] = {}
        which, weight = [], np.repeat(counts, sizes)
        for text, n in zip(texts, sizes.tolist(), strict=True):
            ends = np.flatnonzero(np.frombuffer(text + b" ", np.uint8) == 32).tolist()
            begin = 0
            for i in range(n):
                which.append(ids.setdefault(text[begin : ends[i + self.length - 1]], len(ids)))
                begin = ends[i] + 1
        which = np.array(which, np.int64)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, which, weight)
        return total[which]


def remove_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, hot: int = fragments.HOT_CHUNKS, keep: tuple[str, ...] = (), index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256, carried of every row of docs (doc_id, text).

    A word (ASCII white space parts words) goes if a window of `length` words over it stands anywhere else, in
    the same document or another; all is judged on the input. With an index that has earlier documents, docs are
    added to it, and what stands in any of those counts too; earlier documents are not judged anew. What is kept is
    joined by single spaces. A null or empty text has no words. carried is a struct of the columns named in keep
    (null without any). Rows are taken each by itself, so the windows of a repeated row are repeated; a null doc_id
    is like any other. An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    carried = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("int")
    held = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", carried.alias("carried"))
    none = lambda t: None
    if index is None:
        units = fragments.Units(length, gram, words=True)
        chunks = every = fragments.to_chunks(held)
        index = FingerprintIndex(spark, None, units, fragments.n_buckets(chunks))
        for i in range(batches):
            index.append(chunks.where(F.pmod("chunk", F.lit(batches)) == i) if batches > 1 else chunks)
        index.close()  # answers are files; the runs are not read again
        found = settle(index.answers(), hot)
    else:
        units, length = index.units, index.units.length
        told = index.add(held)
        chunks, every = index.last_chunks(), index.chunks()
        found = settle(index.answers(), hot, told.select("bucket", "hashes"))
    sent = fragments.entries(every, found, units, index.buckets, "text", none)
    judged = durable(fragments.judge(sent, _Count(length)), "judged")

    def finish(t: pa.Table, own: list[list[bytes]], masks: list[np.ndarray]):
        n, gone, kept, sha = [], [], [], []
        for words, mask in zip(own, masks, strict=True):
            left = b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m] if mask.any() else words)
            n.append(len(words))
            gone.append(int(mask.sum()))
            kept.append(left.decode())
            sha.append(hashlib.sha256(left).hexdigest())
        for a in range(0, len(own), 200):
            part = t.slice(a, 200)
            ids, extra = (part.column(c).combine_chunks() for c in ("doc_id", "carried"))
            z = a + 200
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n[a:z], pa.int64()), pa.array(gone[a:z], pa.int64()), pa.array(kept[a:z], pa.string()), pa.array(sha[a:z], pa.string()), extra],
                names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "carried"],
            )

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType()), T.StructField("carried", held.schema["carried"].dataType)])
    return fragments.conclude(chunks, sent, judged, units, "text", none, lambda n, _: n >= 2, finish, schema)


def op8_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
