"""Text differences and reports."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions import text
from spandrel.schemas import DIFF_SUMMARY


def common_lines(before: list[str], after: list[str]) -> int:
    """The length of a longest common subsequence, by Hunt and Szymanski: matches as increasing runs."""
    from bisect import bisect_left

    low = 0
    while low < min(len(before), len(after)) and before[low] == after[low]:
        low += 1
    high = 0
    while high < min(len(before), len(after)) - low and before[-1 - high] == after[-1 - high]:
        high += 1
    before, after = before[low : len(before) - high], after[low : len(after) - high]
    places: dict[str, list[int]] = {}
    for i, line in enumerate(after):
        places.setdefault(line, []).append(i)
    ends: list[int] = []
    for line in before:
        for i in reversed(places.get(line, ())):
            k = bisect_left(ends, i)
            ends[k : k + 1] = [i]
    return low + high + len(ends)


def _lines(value: str) -> list[str]:
    return value.splitlines(keepends=True) if "\r" not in value else value.replace("\r\n", "\n").replace("\r", "\n").splitlines(keepends=True)


def diff_summaries(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, changed, added_lines, removed_lines, old_bytes, new_bytes; no line of either text is given away."""

    def run(batches):
        for b in batches:
            rows = []
            for k, old, new in zip(b[key], b[before], b[after], strict=True):
                old, new = old or "", new or ""
                x, y = _lines(old), _lines(new)
                same = len(x) if old == new else common_lines(x, y)
                rows.append((k, old != new, len(y) - same, len(x) - same, len(old.encode()), len(new.encode())))
            yield pd.DataFrame(rows, columns=[key, *DIFF_SUMMARY.names])

    schema = pairs.select(key).schema
    for f in DIFF_SUMMARY.fields:
        schema = schema.add(f)
    return pairs.select(key, before, after).mapInPandas(run, schema)


def unified_diff(name: str, before: str, after: str) -> str:
    return "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{name}", f"b/{name}"))


def checksums_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """path of each file (path, content) that is new, gone or different."""
    sums = lambda df, n: df.select("path", F.sha2("content", 256).alias(n))
    return sums(before, "x").join(sums(after, "y"), "path", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("path")


def plan_report(documentation: DataFrame, summary: DataFrame, targets: DataFrame, used: int, budget: int) -> DataFrame:
    """One row (report): what changed, which documents say something about it, and what to do next."""
    label = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(c, lambda r: F.concat(F.lit("  "), r["file"], F.lit(" -> "), r["section"]))))))
    docs = documentation.agg(label(F.col("direct_references")).alias("direct"), label(F.col("recommendations")).alias("advised"))
    paths = targets.agg(F.array_sort(F.collect_list("path")).alias("targets"))
    row = summary.crossJoin(docs).crossJoin(paths)  # one row each
    none = F.array().cast("array<string>")
    when = lambda c, *lines: F.when(c, F.array(*lines)).otherwise(none)
    count = lambda c, one, many: F.concat(F.col(c).cast("string"), F.lit(" "), text.plural(F.col(c), one, many))
    titled = lambda title, items: F.when(F.size(items) > 0, F.concat(F.array(F.lit(""), F.lit(title)), items)).otherwise(none)
    some = (F.size("direct") > 0) | (F.size("advised") > 0) | (F.col("unmapped") > 0)
    body = F.concat(
        when(F.col("potentially_breaking") > 0, F.concat(F.lit("! "), count("potentially_breaking", "potentially breaking change", "potentially breaking changes"))),
        titled("Direct documentation references:", F.col("direct")),
        titled("Recommended documentation:", F.col("advised")),
        when(F.col("unmapped") > 0, F.lit(""), F.concat(count("unmapped", "changed symbol is", "changed symbols are"), F.lit(" not mapped to documentation."))),
    )
    following = F.when(F.size("targets") == 1, F.array(F.lit(""), F.concat(F.lit("Target: "), F.get("targets", F.lit(0)))))
    following = following.when(F.size("targets") > 1, F.concat(F.array(F.lit(""), F.lit("Targets:")), F.transform("targets", lambda t: F.concat(F.lit("  "), t))))
    following = following.otherwise(F.array(F.lit(""), F.lit("No safe automatic documentation target was found.")))
    lines = F.concat(
        F.array(F.concat(F.lit("Documentation impact: "), count("public_api_changes", "public API change", "public API changes"))),
        F.when(some, body).otherwise(F.array(F.lit("No documentation updates are indicated."))),
        F.array(F.lit(f"Context: {used} / {budget} bytes")),
        F.when(some, following).otherwise(none),
    )
    return row.select(F.array_join(lines, "\n").alias("report"))
