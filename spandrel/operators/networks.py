"""Addresses and the networks that hold them: a join on prefixes of 128 bits.

IPv4 addresses are taken as the IPv6 addresses that stand for them, so both kinds meet one table. Ranges are cut into
prefixes; for each length that occurs an address has one key, its first bits, and is joined on it. So the join is an
equi-join whose work is addresses times lengths, whatever the number of ranges.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.sources import shared

_V4 = 0xFFFF << 32
_KEY = "hi long, lo long"


def _number(text: str | None) -> int | None:
    try:
        found = ipaddress.ip_address(text)
    except ValueError:
        return None
    return int(found) if found.version == 6 else _V4 | int(found)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _halves(v: int | None) -> tuple[int | None, int | None]:
    return (None, None) if v is None else (_signed(v >> 64), _signed(v & 0xFFFFFFFFFFFFFFFF))


def key(address: Column) -> Column:
    """struct<hi, lo> of the 128 bits of an address; null halves where it is none."""

    @F.pandas_udf(_KEY)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_halves(_number(v)) for v in values], columns=["hi", "lo"]).astype("Int64")

    return run(address)


def prefixes(ranges: DataFrame) -> DataFrame:
    """(length, hi, lo, width, label) of ranges (low, high, label), addresses as texts: at most 254 rows each.

    width is the bits of the range's size, by which narrower ones are told. A range whose ends are not addresses of one
    kind, or that ends before it begins, is an error.
    """

    def run(batches):
        for b in batches:
            out = []
            for low, high, label in zip(b["low"], b["high"], b["label"], strict=True):
                first, last = ipaddress.ip_address(low), ipaddress.ip_address(high)
                size = f"{int(last) - int(first):033x}"
                for net in ipaddress.summarize_address_range(first, last):
                    length = net.prefixlen + (96 if net.version == 4 else 0)
                    out.append((length, *_halves(_number(str(net.network_address))), size, label))
            yield pd.DataFrame(out, columns=["length", "hi", "lo", "width", "label"])

    return ranges.select("low", "high", "label").mapInPandas(run, "length int, hi long, lo long, width string, label string")


def _narrowest(ranges: DataFrame) -> DataFrame:
    """prefixes() with one row for each prefix, that of its narrowest range, the first by label; written.

    Ranges of equal ends come to one before they are cut, and they are dealt to tasks by their ends: cutting costs far
    more than the bytes say by which Spark would put all of them into one task.
    """
    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.min(F.struct("label")).alias("r")  # a null label is the first
    different = ranges.repartition(parts, "low", "high").groupBy("low", "high").agg(first).select("low", "high", "r.label")
    best = prefixes(different).groupBy("length", "hi", "lo").agg(F.min(F.struct("width", "label")).alias("r"))
    return shared.written(best.select("length", "hi", "lo", "r.*"), "prefixes")


def _first_bits(hi: Column, lo: Column, length: int) -> tuple[Column, Column]:
    mask = lambda bits: F.lit(_signed(((1 << 64) - 1) ^ ((1 << (64 - bits)) - 1)))
    return hi.bitwiseAND(mask(min(length, 64))), lo.bitwiseAND(mask(max(length - 64, 0)))


def locate(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """addresses (address) with the label of the narrowest range that holds each, null if none does.

    Of ranges of one size the first by label. Repeated addresses are looked up once and keep their rows; a text that is
    no address has no range.
    """
    table = _narrowest(ranges)
    lengths = sorted(r.length for r in table.select("length").distinct().collect())  # 129 at most
    distinct = addresses.select("address").where("address is not null").distinct().withColumn("key", key(F.col("address"))).where("key.hi is not null")
    keys = [F.struct(F.lit(n).alias("length"), *(c.alias(name) for c, name in zip(_first_bits(F.col("key.hi"), F.col("key.lo"), n), ("hi", "lo"), strict=True))) for n in lengths]
    asked = distinct.select("address", F.explode(F.array(*keys)).alias("k")).select("address", "k.*") if keys else distinct.select("address", F.lit(0).alias("length"), "key.hi", "key.lo").limit(0)
    best = asked.join(table, ["length", "hi", "lo"]).groupBy("address").agg(F.min(F.struct("width", "label")).alias("r"))
    return addresses.join(best.select("address", F.col("r.label").alias("label")), "address", "left")
