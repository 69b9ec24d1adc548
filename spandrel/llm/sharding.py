"""Shards by a hierarchical weighted hash tree (operator 2); DataFrame functions only."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.llm.common import table

#: (region, rack, shard, weight): the 16 shards of the registered query, two regions of two racks.
TREE = tuple((s // 8, s // 4, s, 1.0) for s in range(16))
#: Slots are numbered by (shard, bucket) blocks; the table of block offsets has this many rows a shard.
SLOT_BUCKETS = 1024


def grow(tree, weight: float = 1.0):
    """The tree with one more shard, in a rack and a region of its own.

    No weight of an existing node changes, so a draw that changes its outcome moves to the new subtree and
    nowhere else.
    """
    return (*tree, (max(t[0] for t in tree) + 1, max(t[1] for t in tree) + 1, max(t[2] for t in tree) + 1, weight))


def _uniform(key: Column, node: str) -> Column:
    """In (0, 1), from the first 13 hexadecimal digits of an MD5."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{node}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _draw(key: Column, level: str, children: list[tuple[int, float]]) -> Column:
    """The child that wins the weighted draw: the least -ln(u) / weight; ties go to the smaller child."""
    if len(children) == 1:
        return F.lit(children[0][0])
    bids = [F.struct((-F.ln(_uniform(key, f"{level}{c}")) / F.lit(float(w))).alias("bid"), F.lit(c).alias("child")) for c, w in children]
    return F.least(*bids)["child"]


def place(key: Column, tree=TREE) -> Column:
    """The shard of a key: a draw among the regions, then the racks of the winner, then its shards."""
    regions, racks, shards = defaultdict(float), defaultdict(lambda: defaultdict(float)), defaultdict(list)
    for region, rack, shard, weight in tree:
        regions[region] += weight
        racks[region][rack] += weight
        shards[rack].append((shard, weight))
    region = _draw(key, "region", sorted(regions.items()))
    out = None
    for r in sorted(regions):
        within = None
        rack = _draw(key, "rack", sorted(racks[r].items()))
        for k in sorted(racks[r]):
            shard = _draw(key, "shard", sorted(shards[k]))
            within = shard if within is None else F.when(rack == k, shard).otherwise(within)
        out = within if out is None else F.when(region == r, within).otherwise(out)
    return out.cast("int")


def shard_documents(docs: DataFrame, tree=TREE, slot_buckets: int = SLOT_BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text).

    The law is `key`: the shard follows from the doc_id and the tree. A null doc_id is placed as an empty
    key; a null text has size 1 and the crc32 of no bytes; rows that repeat a doc_id share its shard and take
    slots of their own. An empty table gives an empty result. Other columns of docs are not looked at.

    Slots: equal rows are counted first, so a row that is repeated very often is one row here. Those are numbered
    inside (shard, bucket) blocks by hashed id and text, of which there are slot_buckets for each shard, and the
    offsets of the blocks come from sums. So no task sees a whole shard or one id's rows, and the joined table has
    len(tree) * slot_buckets rows whatever the input.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    bucket = F.pmod(F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), crc.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(slot_buckets)).cast("int")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        crc.alias("text_crc32"),
        place(key, tree).alias("shard"),
        bucket.alias("bucket"),
        place(key, grow(tree)).alias("grown_shard"),
    )
    same = rows.groupBy("shard", "bucket", "doc_id", "size", "text_crc32", "grown_shard").agg(F.count(F.lit(1)).alias("n"))
    blocks = same.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = same.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0)))
    joined = numbered.join(F.broadcast(offsets), ["shard", "bucket"])  # at most len(tree) * slot_buckets rows
    slots = F.sequence(F.col("base") + F.col("at"), F.col("base") + F.col("at") + F.col("n") - 1)
    return joined.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(slots).alias("slot"), "grown_shard")


def op2_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def _sql_draw(level: str, children: list[int], weights: list[float]) -> str:
    if len(children) == 1:
        return str(children[0])
    bids = ", ".join(f"{{'bid': -ln((('0x' || substr(md5(key || ':{level}{c}'), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE) / {w!r}::DOUBLE, 'child': {c}}}" for c, w in zip(children, weights, strict=True))
    return f"(least({bids})).child"


def _sql_place(tree) -> str:
    regions: dict = defaultdict(lambda: defaultdict(list))
    for region, rack, shard, weight in tree:
        regions[region][rack].append((shard, weight))
    whole = lambda racks: sum(w for own in racks.values() for _, w in own)
    arms = []
    for r, racks in regions.items():
        rack_arms = " ".join(f"WHEN {k} THEN {_sql_draw('shard', [s for s, _ in own], [w for _, w in own])}" for k, own in racks.items())
        arms.append(f"WHEN {r} THEN CASE {_sql_draw('rack', list(racks), [sum(w for _, w in own) for own in racks.values()])} {rack_arms} END")
    return f"CASE {_sql_draw('region', list(regions), [whole(k) for k in regions.values()])} {' '.join(arms)} END"


#: crc32 in SQL: the table of 256 words from the reflected polynomial, then a fold over the bytes.
SQL_CRC = """
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS words
  FROM (SELECT unnest(range(256)) AS b)
"""

SQL = f"""
WITH crc AS ({SQL_CRC}), keyed AS (
  SELECT doc_id, coalesce(text, '') AS text, (coalesce(strlen(text), 0) + 1)::BIGINT AS size, coalesce(doc_id::VARCHAR, '') AS key
  FROM documents
), placed AS (
  SELECT doc_id, size, key,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(words[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)::BIGINT AS text_crc32,
         ({_sql_place(TREE)})::INT AS shard, ({_sql_place(grow(TREE))})::INT AS grown_shard
  FROM keyed, crc
), bucketed AS (
  SELECT *, ('0x' || substr(md5(key || ':' || text_crc32::VARCHAR), 1, 8))::BIGINT % {SLOT_BUCKETS} AS bucket FROM placed
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM bucketed
"""
