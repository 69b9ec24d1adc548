"""Operator 12: a trie over conversations that share their first turns, as succinct level-order tries.

A turn is the first 16 bytes of the SHA-256 of its role and text; texts themselves go nowhere. Conversations are
rebuilt and their turns chained to path hashes in range-partitioned scans, so a conversation of any length is spread
over tasks. A prefix of 1, 2, 4, 8 ... turns under which no more than a bound of turns lie is a shard's root; shards are
binned, and a task builds the LOUDS bit vector of its bin with numpy and rolls counts up from the last level to the
first. What lies above all shards, the heavy upper levels, is merged by Spark: each shard gives its totals to the
conversation that owns it, and running sums carry them up that conversation's path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.common import durable, prepare, table
from spandrel.llm.sharding import SQL_CRC
from spandrel.operators import order

#: Path hashes are polynomials of the turns' hashes, modulo a prime, at a fixed point.
PRIME, POINT = (1 << 127) - 1, 0x5D8F3A6C91E7B2440F6E1C7D9B385A21
#: Every BLOCK-th conversation is the one that those after it begin like; HEADS is one more than the most turns taken.
BLOCK, HEADS = 5, 9
#: Turns of a bin, and the most turns under a prefix that stays whole. At most 1 / SPLITS of all turns, if that is more:
#: so there are never more than SPLITS heavy prefixes of a length, and their list, which is broadcast, has a bound.
BIN, SPLITS = 50_000, 20_000
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = "depth long, hi long, lo long, conv_id long, parent_conv_id long, p_hi long, p_lo long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, is_top boolean"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), key and bytes of each turn of the conversations that have an id.

    Turns are ordered by turn, null first; equal ones by role, then by the first 64 characters of their text, then by
    its SHA-256. A null role or text is empty.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("head"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.substring(key, 1, 16).alias("key"), F.octet_length(text).cast("bigint").alias("bytes"),
    )
    placed = order.numbered(rows, ["turn", "role", "head", "sha"], "place", within=["conv_id"])
    return placed.select("conv_id", (F.col("place") - 1).alias("place"), "key", "bytes")


def taken(conv_id: Column) -> Column:
    """How many turns a conversation takes from the one that its block begins with."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(placed: DataFrame) -> DataFrame:
    """The same columns after each conversation's first turns were replaced by those of its block's first one."""
    first = F.col("conv_id") % BLOCK == 0
    own = placed.where(first | (F.col("place") >= taken(F.col("conv_id"))))
    others = placed.select("conv_id").distinct().where(~first).select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("block"), taken(F.col("conv_id")).alias("h"))
    heads = placed.where(first & (F.col("place") < HEADS - 1))
    given = heads.join(others, (F.col("conv_id") == F.col("block")) & (F.col("place") < F.col("h"))).select(F.col("c").alias("conv_id"), "place", "key", "bytes")
    return own.unionByName(given)


def _halves(h: int) -> tuple[int, int]:
    low = h & 0xFFFFFFFFFFFFFFFF
    return h >> 64, low - (1 << 64) if low >= 1 << 63 else low


def _whole(hi: int, lo: int) -> int:
    return (hi << 64) | (lo & 0xFFFFFFFFFFFFFFFF)


CHAINED = "conv_id long, bytes long, i long, hi long, lo long, p_hi long, p_lo long, part int, opens boolean"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path hashes within a range, each conversation as if it began here; opens marks the range's first one."""
    part, now, i, h, opens = TaskContext.get().partitionId(), None, 0, 0, True
    started = False
    for b in batches:
        out: list[list] = [[] for _ in range(6)]
        marks = []
        for c, key in zip(b.column("conv_id").to_pylist(), b.column("key").to_pylist(), strict=True):
            if c != now or not started:
                opens, started, now, i, h = not started, True, c, 0, 0
            before = h
            h = (h * POINT + int.from_bytes(key, "big") % PRIME + 1) % PRIME
            for column, v in zip(out, (c, i, *_halves(h), *_halves(before)), strict=True):
                column.append(v)
            marks.append(opens)
            i += 1
        c, i_s, *hashes = (pa.array(v, pa.int64()) for v in out)
        yield pa.RecordBatch.from_arrays([c, b.column("bytes"), i_s, *hashes, pa.array([part] * len(marks), pa.int32()), pa.array(marks)], names=[f.split()[0] for f in CHAINED.split(", ")])


def carried(rows: list) -> dict[int, tuple[int, int]]:
    """By range: turns and hash that its first conversation had before it. rows: one of each range, in order.

    A range's row has first and last conversation, and the number of turns and hash of either within it.
    """
    out, conv, count, h = {}, None, 0, 0
    for r in rows:
        if conv is not None and conv == r.first_conv:
            out[r.part] = (count, h)
            count, h = count + r.first_n, (h * pow(POINT, r.first_n, PRIME) + _whole(r.first_hash.hi, r.first_hash.lo)) % PRIME
        else:
            conv, count, h = r.first_conv, r.first_n, _whole(r.first_hash.hi, r.first_hash.lo)
        if r.last_conv != r.first_conv:
            conv, count, h = r.last_conv, r.last_n, _whole(r.last_hash.hi, r.last_hash.lo)
    return out


def chained(rows: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), the path's hash (hi, lo), its parent's (p_hi, p_lo), and the last turn's bytes."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = durable(rows.repartitionByRange(parts, "conv_id", "place").sortWithinPartitions("conv_id", "place").mapInArrow(_chain, CHAINED), "chain")
    end = F.struct("i", "hi", "lo")
    ends = held.groupBy("part").agg(
        F.min("conv_id").alias("first_conv"), F.max("conv_id").alias("last_conv"), F.count_if("opens").alias("first_n"),
        F.max(F.when(F.col("opens"), end)).alias("first_hash"), F.max_by(end, F.struct("conv_id", "i")).alias("last_hash"),
    )
    known = carried(ends.withColumn("last_n", F.col("last_hash.i") + 1).orderBy("part").collect())  # one row a range

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in b.schema.names}
            for k, part in enumerate(cols["part"]):
                count, h = known[part]
                i = cols["i"][k]
                for hi, lo, n in (("hi", "lo", i + 1), ("p_hi", "p_lo", i)):
                    cols[hi][k], cols[lo][k] = _halves((h * pow(POINT, n, PRIME) + _whole(cols[hi][k], cols[lo][k])) % PRIME)
                cols["i"][k] = i + count
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], b.schema.field(n).type) for n in b.schema.names], names=b.schema.names)

    late = F.col("opens") & F.col("part").isin(list(known)) if known else F.lit(False)
    out = held.where(~late)
    if known:
        out = out.unionByName(held.where(late).mapInArrow(go_on, CHAINED))
    return out.select("conv_id", (F.col("i") + 1).alias("depth"), "hi", "lo", "p_hi", "p_lo", "bytes")


def digests(ends: DataFrame) -> DataFrame:
    """depth, hi, lo and the SHA-256 of the comma-joined conv_ids, rising, of each node.

    Ids are sorted by ranges and joined to chunks there; one task hashes a node's chunks in their order, and holds one.
    """
    keys = ["depth", "hi", "lo"]
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            if not b.num_rows:
                continue
            node = np.stack([np.asarray(b.column(k)) for k in keys], 1)
            starts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]).any(1)])
            ids = b.column("conv_id").to_pylist()
            texts = [",".join(map(str, ids[s:e])) for s, e in zip(starts, [*starts[1:], len(ids)], strict=True)]
            seqs = range(at, at + len(starts))
            at += len(starts)
            yield pa.RecordBatch.from_arrays([*(pa.array(node[starts, k]) for k in range(3)), pa.array(seqs, pa.int64()), pa.array(texts)], names=[*keys, "seq", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for b in batches:
            for *key, ids in zip(*(b.column(k).to_pylist() for k in (*keys, "ids")), strict=True):
                if key != now:
                    if state:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield _digest_rows(out)
                out = []
        if state:
            yield _digest_rows([(*now, state.hexdigest())])

    by = [*keys, "conv_id"]
    pieces = ends.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(chunks, "depth long, hi long, lo long, seq long, ids string")
    return pieces.repartition(parts, *keys).sortWithinPartitions(*keys, "seq").mapInArrow(hashed, "depth long, hi long, lo long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:3]), pa.array([r[3] for r in rows])], names=["depth", "hi", "lo", "ends_sha256"])


class Louds:
    """A forest in level order: bits (as many ones as a node has children, then a zero; the first node stands for what
    is above the roots), and from them by counting zeros each node's parent."""

    def __init__(self, children: np.ndarray):
        ends = np.cumsum(children + 1) - 1
        self.bits = np.ones(int(ends[-1]) + 1, bool)
        self.bits[ends] = False
        zeros = np.cumsum(~self.bits)
        self.parent = zeros[self.bits]  # of node k + 1, whose one is the k-th
        self.children = np.diff(np.r_[-1, np.flatnonzero(~self.bits)]) - 1

    def roll_up(self, levels: list[slice], *values: np.ndarray) -> None:
        """Add to each node's value those of all nodes below it, from the last level to the first."""
        for level in reversed(levels):
            for v in values:
                np.add.at(v, self.parent[level.start - 1 : level.stop - 1], v[level])


def build(b: pa.Table) -> dict[str, np.ndarray | list]:
    """The nodes of a bin in level order. Columns of b: conv_id, depth, hi, lo, p_hi, p_lo, bytes, last, root_depth."""
    col = {n: np.asarray(b.column(n)) for n in ("conv_id", "depth", "hi", "lo", "p_hi", "p_lo", "bytes", "last", "root_depth")}
    level_of = col["depth"] - col["root_depth"]
    sort = np.lexsort((col["conv_id"], col["lo"], col["hi"], col["depth"], level_of))
    col = {n: v[sort] for n, v in col.items()}
    level_of = level_of[sort]
    key = np.stack([level_of, col["depth"], col["hi"], col["lo"]], 1)
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
    level_of = level_of[starts]
    # level order proper: within a level by the parent's place, then by hash
    place: dict[tuple, int] = {}
    total = len(starts)
    at_order = np.empty(total, np.int64)
    parent_place = np.zeros(total, np.int64)
    levels, done = [], 1
    bounds = np.r_[np.flatnonzero(np.r_[True, level_of[1:] != level_of[:-1]]), total]
    d, hi, lo, p_hi, p_lo = (col[n][starts] for n in ("depth", "hi", "lo", "p_hi", "p_lo"))
    for k, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if k:
            above = np.array([place[x] for x in zip((d[s:e] - 1).tolist(), p_hi[s:e].tolist(), p_lo[s:e].tolist(), strict=True)], np.int64)
        else:
            above = np.zeros(e - s, np.int64)
        own = np.lexsort((lo[s:e], hi[s:e], d[s:e], above))
        at_order[done - 1 : done - 1 + e - s] = s + own
        parent_place[done - 1 : done - 1 + e - s] = above[own]
        place = {x: done + r for r, x in enumerate(zip(d[s:e][own].tolist(), hi[s:e][own].tolist(), lo[s:e][own].tolist(), strict=True))}
        levels.append(slice(done, done + e - s))
        done += e - s
    trie = Louds(np.bincount(parent_place, minlength=total + 1))
    members = np.diff(np.r_[starts, len(sort)])
    pick = at_order
    n = members[pick]
    leaves = np.r_[0, (trie.children[1:] == 0).astype(np.int64)]
    saved = np.r_[0, (n - 1) * col["bytes"][starts][pick]]
    trie.roll_up(levels, leaves, saved)
    conv = col["conv_id"][starts][pick]  # the least: rows of a node are sorted by it
    owners = np.r_[-1, conv]
    ends = []
    for s, m in zip(starts[pick].tolist(), n.tolist(), strict=True):
        last = col["last"][s : s + m]
        ends.append(hashlib.sha256(",".join(map(str, col["conv_id"][s : s + m][last].tolist())).encode()).hexdigest() if last.any() else EMPTY)
    top = trie.parent == 0
    return {
        "depth": d[pick], "hi": hi[pick], "lo": lo[pick], "conv_id": conv, "parent_conv_id": owners[trie.parent], "p_hi": p_hi[pick], "p_lo": p_lo[pick], "n_convs": n,
        "n_children": trie.children[1:], "n_leaves": leaves[1:], "saved_tokens": saved[1:], "ends_sha256": ends, "is_top": top,
    }


def _tries(group: pa.Table) -> pa.Table:
    made = build(group)
    names = [f.split()[0] for f in NODE.split(", ")]
    out = {n: pa.array(made[n]) for n in names}
    out["parent_conv_id"] = pa.array(made["parent_conv_id"], pa.int64(), mask=made["is_top"])
    return pa.table(out)


def tries(conversations: DataFrame, bin_turns: int = BIN, splits: int = SPLITS) -> DataFrame:
    """One row for each node of the trie over all rebuilt conversations, the root included.

    Rows without a conv_id are left out, repeated rows are turns of their own, null and empty roles and texts are
    equal, other columns are not looked at; an empty table has no node, a conversation without turns ends in the root.
    """
    spark = prepare(conversations.sparkSession)
    placed = durable(turns(conversations), "turns")
    convs = placed.select("conv_id").distinct()
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).first()
    if not root.n:
        return spark.createDataFrame([], NODE)
    rows = durable(chained(rebuilt(placed)), "paths")
    node = F.struct("depth", "hi", "lo")
    power = F.col("depth").bitwiseAND(F.col("depth") - 1) == 0
    # the rungs of a conversation are its prefixes of 1, 2, 4, 8 ... turns: no more than 63
    paths = durable(rows.groupBy("conv_id").agg(F.max("depth").alias("length"), F.array_sort(F.collect_list(F.when(power, node))).alias("rungs")), "rungs")
    total = paths.agg(F.sum("length").alias("s")).first().s or 0
    bound = max(bin_turns, total // splits)
    rungs = paths.select("conv_id", "length", F.explode("rungs").alias("rung"))
    heavy = rungs.groupBy("rung").agg(F.sum(F.col("length") - F.col("rung.depth") + 1).alias("under")).where(F.col("under") > bound).select("rung")
    light = rungs.join(F.broadcast(heavy), "rung", "left_anti").groupBy("conv_id").agg(F.min("rung").alias("root"))
    cut = durable(paths.select("conv_id", "length").join(light, "conv_id", "left"), "cuts")
    rows = rows.join(cut, "conv_id").withColumn("last", F.col("depth") == F.col("length"))
    below = F.col("root").isNotNull() & (F.col("depth") >= F.col("root.depth"))
    bins = total // bin_turns + 1
    sharded = rows.where(below).select("*", F.pmod(F.xxhash64("root"), F.lit(bins)).alias("bin"), F.col("root.depth").alias("root_depth")).drop("root", "length")
    shards = durable(sharded.groupBy("bin").applyInArrow(_tries, NODE), "tries")
    upper = durable(rows.where(~below).drop("root", "length"), "upper")
    out = _merge(spark, root, shards, upper, convs.join(paths, "conv_id", "left_anti"))
    return out


def _merge(spark: SparkSession, root, shards: DataFrame, upper: DataFrame, turnless: DataFrame) -> DataFrame:
    """All nodes: those of shards, those above, and the root."""
    key = ["depth", "hi", "lo"]
    tops = shards.where("is_top")
    nodes = upper.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(F.first(c).alias(c) for c in ("p_hi", "p_lo", "bytes")))
    up = [(F.col("depth") - 1).alias("depth"), F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo")]
    children = nodes.select(*up).unionByName(tops.select(*up)).groupBy(*key).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = durable(nodes.join(children, key, "left").fillna(0, ["n_children"]), "nodes")
    # what a node or shard adds to the nodes above and with it, kept with the conversation that owns it
    own = nodes.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    given = tops.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    weights = own.unionByName(given).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    path = upper.select("conv_id", *key).join(weights, ["conv_id", "depth"], "left")
    path = order.running(path, [F.desc("depth")], {"n_leaves": "leaves", "saved_tokens": "saved"}, within=["conv_id"])
    sums = path.groupBy(*key).agg(*(F.sum(c).cast("bigint").alias(c) for c in ("n_leaves", "saved_tokens")))
    ends = upper.where("last").select(*key, "conv_id").unionByName(turnless.select(*(F.lit(0).cast("bigint").alias(c) for c in key), "conv_id"))
    hashes = durable(digests(ends), "ends")
    nodes = nodes.join(sums, key, "left").join(hashes, key, "left").withColumn("parent_conv_id", F.lit(None).cast("bigint")).withColumn("is_top", F.lit(True))
    columns = shards.columns
    every = shards.unionByName(nodes.select(*(F.coalesce("ends_sha256", F.lit(EMPTY)).alias(c) if c == "ends_sha256" else c for c in columns)))
    parents = nodes.select(F.col("conv_id").alias("above"), *(F.col(c).alias(f"above_{c}") for c in key))
    waits = every.where("is_top and depth > 1").join(parents, (F.col("depth") - 1 == F.col("above_depth")) & (F.col("p_hi") == F.col("above_hi")) & (F.col("p_lo") == F.col("above_lo")), "left")
    settled = every.where("not is_top or depth = 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root.conv_id)).otherwise(F.col("parent_conv_id")))
    every = settled.unionByName(waits.withColumn("parent_conv_id", F.col("above")).select(*columns))
    first = every.where("depth = 1").agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    end = hashes.where("depth = 0").first()
    top = (0, 0, 0, root.conv_id, None, None, None, root.n, first.n, first.leaves if first.n else 1, first.saved or 0, end.ends_sha256 if end else EMPTY, True)
    return every.unionByName(spark.createDataFrame([top], NODE))


def op12_level_order_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tries(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_KEPT = "coalesce(role, '') AS role, coalesce(text, '') AS text"

#: Each node is the list of its turns' hashes; what lies below a node is found by cutting every list at every length.
SQL = f"""
WITH crc AS ({SQL_CRC}), k AS (
  SELECT conv_id, turn, {_KEPT}, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, key, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text)) - 1 AS place FROM k
), c AS (
  SELECT conv_id, conv_id - conv_id % {BLOCK} AS block,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, b: xor(words[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM k), crc
), r AS (
  SELECT conv_id, key, bytes, place FROM p JOIN c USING (conv_id) WHERE place >= h OR conv_id = block
  UNION ALL SELECT c.conv_id, key, bytes, place FROM c JOIN p ON p.conv_id = c.block WHERE place < h AND c.conv_id <> block
), l AS (
  SELECT conv_id, list(key ORDER BY place) AS keys, list(bytes ORDER BY place) AS sizes FROM r GROUP BY conv_id
), whole AS (
  SELECT conv_id, coalesce(keys, []) AS keys, coalesce(sizes, []) AS sizes FROM c LEFT JOIN l USING (conv_id)
), m AS (
  SELECT conv_id, sizes, len(keys) AS length, keys, unnest(range(0, len(keys) + 1)) AS depth FROM whole
), n AS (
  SELECT list_slice(keys, 1, depth) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(sizes[depth]), 0) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM m GROUP BY 1, 2
), kids AS (
  SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), w AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)
), sums AS (
  SELECT list_slice(path, 1, d) AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM w) GROUP BY 1
)
SELECT w.conv_id, w.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN sums USING (path) LEFT JOIN n above ON w.depth > 0 AND above.path = list_slice(w.path, 1, w.depth - 1)
"""
