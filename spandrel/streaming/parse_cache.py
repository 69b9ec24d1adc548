"""Parsed modules as keyed state: a file is parsed when it is new or another than the state holds.

Paths are dealt to shards, each of which is one key of a stateful operator. A shard holds the modules of so many paths
and lets go of the one used longest ago when it is full; a timer lets go of what was not used for some time. Every row
that comes in leaves as a hit, a miss, a refusal (too large to keep) or a removal, and the shard tells its counters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spandrel.functions import paths
from spandrel.operators import parse
from spandrel.schemas import MODULE

SHARDS, CAPACITY, IDLE_MS, MOST_CHARS = 64, 1000, 3_600_000, 4 << 20
ROWS = 10_000  # of one frame that leaves
OUTCOME = "path string, outcome string, version string, language string, module string, error string, hits long, misses long, evicted long, held long"

_ENTRY = T.StructType([T.StructField(n, t) for n, t in (("version", T.StringType()), ("used", T.LongType()), ("language", T.StringType()), ("module", T.StringType()), ("error", T.StringType()))])
_KEY = T.StructType([T.StructField("path", T.StringType())])
_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("hits", "misses", "evicted", "clock")])


def parsed(path: str, content: str) -> tuple[str | None, str | None, str | None]:
    """(language, module as JSON, error)."""
    language = paths.language(path)
    found, error = parse.attempt_module(content, language)
    return language, None if found is None else json.dumps(found, ensure_ascii=False, separators=(",", ":")), error


class ParseCache(StatefulProcessor):
    """State of one shard: path -> entry, and counters. used is a counter of the shard's own, so that the order of use
    does not depend on clocks; timers go by the time of processing."""

    def __init__(self, capacity: int = CAPACITY, idle_ms: int = IDLE_MS, most_chars: int = MOST_CHARS):
        self.capacity, self.idle_ms, self.most_chars = capacity, idle_ms, most_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", _KEY, _ENTRY)
        self.counts = handle.getValueState("counts", _COUNTS)
        self.idle = handle.getMapState("idle", T.StructType([T.StructField("at", T.LongType())]), T.StructType([T.StructField("clock", T.LongType())]))

    def _counts(self) -> list[int]:
        return list(self.counts.get()) if self.counts.exists() else [0, 0, 0, 0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        hits, misses, evicted, clock = self._counts()
        held = {k[0]: v for k, v in self.entries.iterator()}  # at most the capacity
        before = dict(held)
        frames = list(rows)  # they come in no order, so all rows of the shard that arrive together are sorted as one
        arrived = pd.concat(frames).sort_values(["order", "path"], kind="stable") if frames else pd.DataFrame()
        for start in range(0, len(arrived), ROWS):
            out = []
            for r in arrived.iloc[start : start + ROWS].itertuples(index=False):
                clock += 1
                if r.event == "deleted" or r.content is None:
                    known = held.pop(r.path, None)
                    out.append((r.path, "removed" if known else "unknown", r.version, None, None, None))
                    continue
                entry = held.get(r.path)
                if entry is not None and entry[0] == r.version:
                    hits += 1
                    outcome, (_, _, language, module, error) = "hit", entry
                else:
                    misses += 1
                    outcome, (language, module, error) = "miss", parsed(r.path, r.content)
                held.pop(r.path, None)
                if len(module or "") <= self.most_chars:
                    if len(held) >= self.capacity:
                        held.pop(min(held, key=lambda p: held[p][1]))
                        evicted += 1
                    held[r.path] = (r.version, clock, language, module, error)
                elif outcome == "miss":
                    outcome = "refused"
                out.append((r.path, outcome, r.version, language, module, error))
            yield pd.DataFrame([(*o, hits, misses, evicted, len(held)) for o in out], columns=[f.split()[0] for f in OUTCOME.split(", ")])
        for path in before.keys() - held.keys():
            self.entries.removeKey((path,))
        for path, entry in held.items():
            if before.get(path) != entry:
                self.entries.updateValue((path,), entry)
        self.counts.update((hits, misses, evicted, clock))
        now = timerValues.getCurrentProcessingTimeInMs()
        if now > 0:  # what was last used before this clock goes when the timer rings
            self.handle.registerTimer(now + self.idle_ms)
            self.idle.updateValue((now + self.idle_ms,), (clock,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        at = expiredTimerInfo.getExpiryTimeInMs()
        hits, misses, evicted, clock = self._counts()
        out = []
        if self.idle.containsKey((at,)):
            upto = self.idle.getValue((at,))[0]
            self.idle.removeKey((at,))
            gone = [k[0] for k, v in self.entries.iterator() if v[1] <= upto]
            left = sum(1 for _ in self.entries.keys()) - len(gone)
            for path in gone:
                self.entries.removeKey((path,))
                out.append((path, "expired", None, None, None, None, hits, misses, evicted, left))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUTCOME.split(", ")])

    def close(self) -> None:
        pass


def outcomes(changes: DataFrame, shards: int = SHARDS, capacity: int = CAPACITY, idle_ms: int = IDLE_MS, most_chars: int = MOST_CHARS) -> DataFrame:
    """What becomes of each row of changes (path, event, version, order, content), a stream or a table.

    capacity is that of all shards together. Rows of one shard that arrive together are taken by order.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _ = spark.streams  # starts what keeps track of state, which a session without a stream lacks
    rows = changes.select(F.pmod(F.xxhash64("path"), F.lit(shards)).alias("shard"), "path", "event", "version", F.col("order").cast("bigint").alias("order"), "content")
    cache = ParseCache(max(1, capacity // shards), idle_ms, most_chars)
    return rows.groupBy("shard").transformWithStateInPandas(statefulProcessor=cache, outputStructType=OUTCOME, outputMode="append", timeMode="ProcessingTime" if changes.isStreaming else "None")


def of_files(changes: DataFrame) -> DataFrame:
    """Rows of the file_changes source as outcomes() takes them: a version is (modified, size)."""
    return changes.select("path", "event", F.concat_ws(",", "modified", "size").alias("version"), F.col("modified").alias("order"), "content")


def modules(found: DataFrame) -> DataFrame:
    """Rows of MODULE of hits and misses."""
    kept = found.where(F.col("outcome").isin("hit", "miss", "refused") & F.col("language").isNotNull())
    held = kept.select("path", "language", F.from_json("module", T.StructType([f for f in MODULE.fields if f.name not in ("path", "language", "error")])).alias("m"), "error")
    arrays = (F.coalesce(F.col(f"m.{f.name}"), F.array().cast(f.dataType)).alias(f.name) for f in MODULE.fields if f.name not in ("path", "language", "error"))
    return held.select("path", "language", *arrays, "error")


def observed(found: DataFrame, name: str = "parse_cache") -> DataFrame:
    """outcomes() whose counts of hits, misses, removals and expiries come with each batch's progress, without a job."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return found.observe(name, n("hit").alias("hits"), n("miss", "refused").alias("misses"), n("removed").alias("removed"), n("expired").alias("expired"))


def statistics(found: DataFrame) -> DataFrame:
    """One row of totals over outcomes: hits, misses, evicted, expired, removed."""
    n = lambda o, name: F.count_if(F.col("outcome").isin(*o)).alias(name)
    return found.agg(n(["hit"], "hits"), n(["miss", "refused"], "misses"), n(["expired"], "expired"), n(["removed"], "removed"))
