"""Records as JSON and streams of them, addresses, and retries."""

from __future__ import annotations

import ipaddress
import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one record of a token stream.
MOST_RECORD = 1 << 20


def exact_record(column: Column, schema: T.StructType) -> Column:
    """A JSON object as a struct; null unless it has just the schema's keys, each of its type and not null."""
    keys = F.array_sort(F.json_object_keys(column))
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    whole = keys == F.array(*(F.lit(k) for k in sorted(schema.names)))
    for name in schema.names:
        whole = whole & parsed[name].isNotNull()
    return F.when(F.coalesce(whole, F.lit(False)), parsed)


def base64url_decode(x: Column) -> Column:
    """Bytes of a base64url text; null if it has other characters or is not what encoding gives."""
    from spandrel.functions.text import base64url

    plain = F.translate(x, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(x), F.lit(4))))
    out = F.when(x.rlike(r"^[A-Za-z0-9_-]*\z") & (F.length(x) % 4 != 1), F.unbase64(padded))
    return F.when(base64url(out) == x, out)


def ndjson(body: Column, field: str, done: str = "done") -> Column:
    """The joined texts of field of newline-delimited records up to the one that is done; null if none is."""
    lines = F.filter(F.split(body, "\n"), lambda line: F.trim(line) != "")
    parsed = F.transform(lines, lambda line: F.struct(F.get_json_object(line, f"$.{field}").alias("text"), (F.get_json_object(line, f"$.{done}") == "true").alias("done"), F.octet_length(line).alias("n")))
    good = F.exists(parsed, lambda r: F.coalesce(r["done"], F.lit(False))) & ~F.exists(parsed, lambda r: r["n"] > MOST_RECORD)
    return F.when(good, F.array_join(F.transform(parsed, lambda r: F.coalesce(r["text"], F.lit(""))), ""))


def server_events(body: Column) -> Column:
    """The data of each event of a text/event-stream; null unless it ends with [DONE]."""
    events = F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n\n+")
    data = F.transform(events, lambda e: F.array_join(F.transform(F.filter(F.split(e, "\n"), lambda line: line.startswith("data:")), lambda line: F.regexp_replace(line, "^data: ?", "")), "\n"))
    data = F.filter(data, lambda d: d != "")
    ended = (F.element_at(data, -1) == "[DONE]") & ~F.exists(data, lambda d: F.octet_length(d) > MOST_RECORD)
    return F.when(F.coalesce(ended, F.lit(False)), F.slice(data, 1, F.greatest(F.size(data) - 1, F.lit(0))))


def address_class(address: Column) -> Column:
    """public, local (loopback) or private, of an IPv4 or IPv6 address; null if it is none."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        def one(value):
            try:
                found = ipaddress.ip_address(value)
            except ValueError:
                return None
            found = getattr(found, "ipv4_mapped", None) or found
            return "local" if found.is_loopback else "public" if found.is_global and not found.is_multicast else "private"

        return values.map(one)

    return run(address)


def in_ranges(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """IPv4 addresses (address) with the label of the narrowest range (low, high, label) that holds them.

    ranges is a list of special networks, some dozens of rows; addresses without a range have a null label.
    """
    parts = F.split("address", r"\.")
    number = sum((parts[i].cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    held = ranges.agg(F.collect_list(F.struct((F.col("high") - F.col("low")).alias("width"), "low", "high", "label")).alias("ranges"))
    own = addresses.withColumn("number", number).crossJoin(F.broadcast(held))  # one row
    found = F.filter("ranges", lambda r: (r["low"] <= F.col("number")) & (F.col("number") <= r["high"]))
    return own.select("address", F.array_min(found)["label"].alias("label"))


def delay(attempt: int, base: float = 1.0, cap: float = 30.0, jitter: bool = True) -> float:
    """Seconds before a retry: doubled each time up to the cap, times 0.5 to 1."""
    return min(base * 2**attempt, cap) * (0.5 + random.random() / 2 if jitter else 1.0)


def with_retry(f: Callable, retries: int = 3, sleep: Callable[[float], None] = time.sleep):
    """f(), again after rate limits, server errors and lost connections."""
    words = ("429", "rate limit", "500", "502", "503", "econnreset", "econnrefused", "timeout")
    for attempt in range(retries + 1):
        try:
            return f()
        except Exception as error:
            if attempt == retries or not any(w in str(error).lower() for w in words):
                raise
            sleep(delay(attempt))
    return None
