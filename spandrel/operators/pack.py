"""First-fit choice under a budget of bytes."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_BUDGET, MOST_BUDGET, USUAL_BUDGET = 1024, 1_048_576, 12_000


def check_budget(budget: int) -> int:
    if not isinstance(budget, int) or isinstance(budget, bool) or not LEAST_BUDGET <= budget <= MOST_BUDGET:
        raise ValueError(f"a budget is a whole number from {LEAST_BUDGET} to {MOST_BUDGET}")
    return budget


def contenders(items: DataFrame, keys: list[str], order: str, least: Column, budget: int) -> DataFrame:
    """The items that first fit may take, for groups of any size.

    What is left never grows. So when an item of least size s is taken, each item before it of that size or less was
    taken too; of the items of one size only the first budget / s can be, and no group keeps more than budget times the
    logarithm of budget. Sizes are 1 or more, anything else is an error. They are counted in two steps, so that a hot
    group or size is many small groups first.
    """
    size = F.coalesce(least, F.lit(budget + 1)).cast("bigint")
    checked = F.when(size < 1, F.raise_error(F.lit("a size is below 1")).cast("bigint")).otherwise(size)
    held = items.withColumn("_size", checked).where(F.col("_size") <= budget).withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(SALTS)))
    for within in ([*keys, "_size", "_salt"], [*keys, "_size"]):
        place = F.row_number().over(Window.partitionBy(*within).orderBy(order))
        held = held.withColumn("_place", place).where(F.col("_place") * F.col("_size") <= budget)
    return held.drop("_size", "_salt", "_place")


SALTS = 32


def pack_groups(items: DataFrame, key: str, order: str, full: str, compact: str | None, budget: int) -> DataFrame:
    """(key, order, form) of what is taken of each group, in order.

    Each item is taken in full if that fits what is left, else compact if that fits, else passed over; later ones can
    still fit. full and compact are sizes, null where there is no such form. The contenders of each group pass through
    one task in order, which holds what is used so far and nothing else.
    """
    size = lambda c: F.col(c).cast("bigint") if c else F.lit(None).cast("bigint")
    rows = items.select(F.col(key), F.col(order).cast("bigint").alias("order"), size(full).alias("full"), size(compact).alias("compact"))
    held = contenders(rows, [key], "order", F.least("full", "compact"), budget)
    kind = items.schema[key].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = object(), 0
        for b in batches:
            at, forms = [], []
            for i, (k, whole, small) in enumerate(zip(*(b.column(c).to_pylist() for c in (key, "full", "compact")), strict=True)):
                if k != now:
                    now, used = k, 0
                for form, n in (("full", whole), ("compact", small)):
                    if n is not None and used + n <= budget:
                        used += n
                        at.append(i)
                        forms.append(form)
                        break
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(key).take(taken), b.column("order").take(taken), pa.array(forms, pa.string())], names=[key, "order", "form"])

    by = [key, "order", "full", "compact"]
    schema = T.StructType([T.StructField(key, kind), T.StructField("order", T.LongType()), T.StructField("form", T.StringType())])
    return held.repartition(key).sortWithinPartitions(*by).mapInArrow(scan, schema)


def non_overlapping(items: DataFrame, key: str, start: str, end: str, ties: list[Column | str]) -> DataFrame:
    """The intervals of each key that are accepted: by start, then by ties; none that begins before the end of one
    accepted earlier. A key's rows pass through one task in order, which holds their last end and nothing else."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), None
        for b in batches:
            at = []
            for i, (k, s, e) in enumerate(zip(*(b.column(c).to_pylist() for c in (key, start, end)), strict=True)):
                if k != now:
                    now, last = k, None
                if last is None or s >= last:
                    last = e
                    at.append(i)
            yield b.take(pa.array(at, pa.int64()))

    return items.repartition(key).sortWithinPartitions(key, start, *ties).mapInArrow(scan, items.schema)


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; None is left out of objects, non-finite numbers are refused."""

    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if x is not None}
        return [clean(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(clean(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


class Budget:
    """Bytes of an envelope's canonical JSON, kept up while records are added: nothing is serialised twice.

    The envelope holds two lists and the number of records that it leaves out, whose digits count too.
    """

    def __init__(self, digest: str, summary: dict, records: int, budget: int):
        self.budget, self.left, self.taken, self.lists = budget, records, 0, {"changes": [0, 0], "documentation": [0, 0]}
        empty = {"schemaVersion": "impact-context.v1", "impactDigest": digest, "summary": summary, "changes": [], "documentation": [], "omittedRecords": 0}
        self.frame = len(canonical(empty).encode()) - 1
        if self.used() > budget:
            raise ValueError("the budget cannot hold the envelope")

    def used(self, left: int | None = None, **added: tuple[int, int]) -> int:
        total = self.frame + len(str(self.left if left is None else left))
        for name, (n, size) in self.lists.items():
            more, bytes_ = added.get(name, (0, 0))
            total += size + bytes_ + max(n + more - 1, 0)  # commas
        return total

    def take(self, change: int, documentation: list[int]) -> bool:
        """Whether a record of a change and its documentation, in bytes, fits; then it is counted."""
        added = {"changes": (1, change), "documentation": (len(documentation), sum(documentation))}
        if self.used(self.left - 1, **added) > self.budget:
            return False
        for name, (n, size) in added.items():
            self.lists[name][0] += n
            self.lists[name][1] += size
        self.left -= 1
        self.taken += 1
        return True


def build_context(digest: str, summary: dict, records: Iterable[dict], budget: int = USUAL_BUDGET, total: int | None = None) -> tuple[dict, dict]:
    """A bounded envelope and its report.

    records, in order: {full, full_docs, compact, compact_docs}; either form can be None. total is the number of all
    records, if those that cannot fit are not among them.
    """
    check_budget(budget)
    records = list(records) if total is None else records
    total = len(records) if total is None else total
    count, changes, documentation = Budget(digest, summary, total, budget), [], []
    size = lambda v: len(canonical(v).encode())
    for r in records:
        for form in ("full", "compact"):
            docs = r.get(f"{form}_docs") or []
            if r.get(form) is not None and count.take(size(r[form]), [size(d) for d in docs]):
                changes.append(r[form])
                documentation += docs
                break
    envelope = {"schemaVersion": "impact-context.v1", "impactDigest": digest, "summary": summary, "changes": changes, "documentation": documentation, "omittedRecords": count.left}
    return envelope, {"maxBytes": budget, "usedBytes": count.used(), "totalRecords": total, "includedRecords": count.taken, "omittedRecords": count.left, "impactDigest": digest}
