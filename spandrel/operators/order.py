"""Places and running sums along an order of a whole table, with no task that sees more than its share of rows.

The rows are dealt out by ranges of the order, each range is sorted by its own task, and what a range has to know of
those before it is one number. These come to the driver, one row a range, and go back as a literal; so the plan has
neither a window over all rows nor a join for them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.sources import shared

_AT, _PART = "__at", "__part"  # a row's place in its range, below the number of the range, which is above 2^33


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows with __at, which rises along the order; written, so that a second reading finds the same ranges."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [_column(c) for c in order]
    return shared.written(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id()), "ranges")


def _range_of(at: Column) -> Column:
    return F.shiftright(at, 33).cast("int")


def _before(totals: dict[int, int], kind: str) -> Column:
    """What the ranges before a row's own hold together, as a look-up by the number of its range."""
    out, run = [], 0
    for k in range(max(totals, default=-1) + 1):
        out.append(F.lit(str(run)).cast(kind))  # beyond a long, too
        run += totals.get(k, 0)
    return F.get(F.array(*out), _range_of(F.col(_AT))) if out else F.lit(0).cast(kind)


def _from_start(df: DataFrame, within: Sequence[str], before: dict[str, Column]) -> DataFrame:
    """Each named column less what it was before the first row of equal `within`.

    The first rows are written, so that their number is known before the join: few of them go to all tasks, and the rows
    of a hot key stay where they are.
    """
    first = shared.written(df.groupBy(*within).agg(*(F.min(c).alias(f"__first_{n}") for n, c in before.items())), "first")
    renamed = first.withColumnsRenamed({c: f"__of_{c}" for c in within})
    on = [df[c].eqNullSafe(renamed[f"__of_{c}"]) for c in within]
    out = df.join(renamed, on)
    return out.withColumns({n: F.col(n) - F.col(f"__first_{n}") for n in before}).drop(*(f"__first_{n}" for n in before), *(f"__of_{c}" for c in within))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "position", within: Sequence[str] = ()) -> DataFrame:
    """df with a column of each row's place in the order, from 1, among the rows of equal `within`.

    Rows that the order does not tell apart have different places, in no order of their own. Null comes first, as
    asc() has it. A key that holds most of the rows is spread over as many tasks as any other rows.
    """
    held = by_ranges(df, [*within, *order])
    totals = {r.part: r["count"] for r in held.groupBy(_range_of(F.col(_AT)).alias("part")).count().collect()}
    local = F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1))
    out = held.withColumn(name, _before(totals, "bigint") + local + 1).drop(_AT)
    return _from_start(out, within, {name: F.col(name) - 1}) if within else out


#: A whole number below 10^20 is two longs, its multiples of _BASE and the rest, whose sums over a range are longs too.
_BASE = 1 << 32


def _added_up(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with each named column of longs replaced by its sum over the rows of the task up to and with each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = dict.fromkeys(names, 0)
        for b in batches:
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            for n in names if b.num_rows else ():
                sums = held[n] + np.cumsum(columns[n].to_numpy(zero_copy_only=False))
                columns[n], held[n] = pa.array(sums, pa.int64()), int(sums[-1])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]))


def running(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str], within: Sequence[str] = ()) -> DataFrame:
    """df with sums over the rows up to and with each row: sums maps new columns to columns of whole numbers, none
    below zero.

    Rows count in the order, among those of equal `within`; null counts as zero. Sums are decimal(38,0). A range is
    added up by the task that sorts it, so no row is shuffled twice.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [_column(c) for c in [*within, *order]]
    halves = {}
    for n, c in sums.items():
        whole = F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)")
        high = F.floor(whole / F.lit(_BASE).cast("decimal(20,0)")).cast("bigint")
        halves |= {f"__own_{n}": whole, f"__high_{n}": high, f"__low_{n}": (whole - high * F.lit(_BASE).cast("decimal(20,0)")).cast("bigint")}
    ranges = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns(halves).withColumn(_AT, F.monotonically_increasing_id())
    held = shared.written(_added_up(ranges, [h for h in halves if not h.startswith("__own_")]), "ranges")
    part = _range_of(F.col(_AT))
    local = {n: F.col(f"__high_{n}").cast("decimal(20,0)") * F.lit(_BASE) + F.col(f"__low_{n}") for n in sums}
    totals = held.groupBy(part.alias("part")).agg(*(F.max(c).alias(n) for n, c in local.items())).collect()  # sums rise
    out = held.withColumns({n: (_before({r.part: int(r[n]) for r in totals}, "decimal(38,0)") + c).cast("decimal(38,0)") for n, c in local.items()})
    if within:
        out = _from_start(out, within, {n: F.col(n) - F.col(f"__own_{n}") for n in sums})
    return out.drop(_AT, *halves)
