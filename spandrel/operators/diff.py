"""Two snapshots of symbols to a list of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.text import canonical_json
from spandrel.operators import order
from spandrel.schemas import FACETS

#: Categories in the order of their weight, and the risk of each. Fixed values.
RISK = {
    "removed": "potentially-breaking",
    "contract-changed": "review-required",
    "moved": "informational",
    "added": "informational",
    "dependency-changed": "informational",
    "implementation-changed": "informational",
    "documentation-changed": "informational",
}
KEYS = ("file_id", "kind", "qualified_name")
PRINTS = ("contract_fp", "implementation_fp", "documentation_fp")


def priority(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RISK)), category)


def risk(category: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in RISK.items() for x in pair)), category)


def last_wins(symbols: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Of rows with the same file, kind and name the last."""
    rest = [c for c in symbols.columns if c not in (*KEYS, ordinal)]
    return symbols.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("r")).select(*KEYS, "r.*")


def _facet(side: str, name: str) -> Column:
    return F.col(f"{side}.contract_facets")[name]


def same_symbol() -> Column:
    out = F.col("b.language").eqNullSafe(F.col("a.language"))
    for c in PRINTS:
        out = out & F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    for f in FACETS:
        out = out & _facet("b", f).eqNullSafe(_facet("a", f))
    return out


def changed_facets() -> Column:
    """Names of the facets that differ, in alphabetical order."""
    return F.filter(F.array(*(F.when(~_facet("b", f).eqNullSafe(_facet("a", f)), f) for f in sorted(FACETS))), lambda x: x.isNotNull())


def categories() -> Column:
    """What became of a symbol: one category, or two for one that changed while its file was renamed."""
    gone, new = F.col("b.kind").isNull(), F.col("a.kind").isNull()
    cascade = (
        F.when(~F.col("b.contract_fp").eqNullSafe(F.col("a.contract_fp")), F.array(F.lit("contract-changed")))
        .when(~F.col("b.implementation_fp").eqNullSafe(F.col("a.implementation_fp")), F.array(F.lit("implementation-changed")))
        .when(~F.col("b.documentation_fp").eqNullSafe(F.col("a.documentation_fp")), F.array(F.lit("documentation-changed")))
    )
    moved = F.when(same_symbol(), F.array(F.lit("moved"))).otherwise(F.array(F.lit("removed"), F.lit("added")))
    both = F.when(F.col("renamed"), moved).otherwise(cascade)
    return F.when(gone, F.array(F.lit("added"))).when(new, F.array(F.lit("removed"))).otherwise(both)


def finish(changes: DataFrame) -> DataFrame:
    """Adds risk and digest to rows of changes."""
    out = changes.withColumn("risk", risk(F.col("category")))
    payload = canonical_json(
        scope=F.col("scope"), id=F.col("id"), beforeId=F.col("before_id"), afterId=F.col("after_id"), category=F.col("category"), risk=F.col("risk"), language=F.col("language"),
        path=F.col("path"), kind=F.col("kind"), qualifiedName=F.col("qualified_name"), changedContractFacets=F.col("changed_facets"),
    )
    names = ("scope", "id", "before_id", "after_id", "category", "risk", "language", "path", "kind", "qualified_name", "changed_facets")
    return out.select(*names, F.sha2(payload, 256).alias("digest"))


def symbol_id(language: Column, path: Column, kind: Column, name: Column) -> Column:
    return F.concat(language, F.lit(":"), path, F.lit("#"), kind, F.lit(":"), name)


def compare_symbols(files: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of symbols.

    files: file_id, status, before_path, after_path. before and after: file_id, ordinal and the columns of SYMBOL.
    One full outer join on file, kind and name; a file that is on one side only has all its symbols added or
    removed.
    """
    b, a = (last_wins(x).alias(n) for x, n in ((before, "b"), (after, "a")))
    on = [F.col(f"b.{k}") == F.col(f"a.{k}") for k in KEYS]
    paths = files.select(F.col("file_id").alias("fid"), (F.col("status") == "renamed").alias("renamed"), "before_path", "after_path")
    joined = b.join(a, on, "full_outer").withColumn("fid", F.coalesce("b.file_id", "a.file_id")).join(paths, "fid")
    out = joined.withColumn("category", F.explode(categories()))
    category = F.col("category")
    kind, name = F.coalesce("a.kind", "b.kind"), F.coalesce("a.qualified_name", "b.qualified_name")
    language = F.when(category == "removed", F.col("b.language")).otherwise(F.coalesce("a.language", "b.language"))
    path = F.when(category == "removed", F.col("before_path")).when(category == "added", F.col("after_path")).otherwise(F.coalesce("after_path", "before_path"))
    path = F.coalesce(path, F.lit(""))
    moved = category == "moved"
    out = out.select(
        F.lit("symbol").alias("scope"),
        symbol_id(language, path, kind, name).alias("id"),
        F.when(moved, symbol_id(F.col("b.language"), F.coalesce("before_path", F.lit("")), kind, name)).alias("before_id"),
        F.when(moved, symbol_id(F.col("a.language"), F.coalesce("after_path", F.lit("")), kind, name)).alias("after_id"),
        "category", language.alias("language"), path.alias("path"), kind.alias("kind"), name.alias("qualified_name"),
        F.when(category == "contract-changed", changed_facets()).alias("changed_facets"),
    )
    return finish(out)


def compare_modules(files: DataFrame) -> DataFrame:
    """A change of kind module for each file, present on both sides, whose imports differ.

    files: language, before_path, after_path, before_dependency_fp, after_dependency_fp.
    """
    both = F.col("before_dependency_fp").isNotNull() & F.col("after_dependency_fp").isNotNull()
    path = F.coalesce("after_path", "before_path", F.lit(""))
    none = F.lit(None).cast("string")
    out = files.where(both & (F.col("before_dependency_fp") != F.col("after_dependency_fp"))).select(
        F.lit("module").alias("scope"), F.concat("language", F.lit(":"), path, F.lit("#module")).alias("id"), none.alias("before_id"), none.alias("after_id"),
        F.lit("dependency-changed").alias("category"), "language", path.alias("path"), F.lit("module").alias("kind"), none.alias("qualified_name"), F.lit(None).cast("array<string>").alias("changed_facets"),
    )
    return finish(out)


def order_of() -> list[Column | str]:
    """By weight of category, then path, kind, name and id."""
    return [priority(F.col("category")), "path", "kind", F.coalesce("qualified_name", F.lit("")), "category", "id"]


def ordered(changes: DataFrame) -> DataFrame:
    return changes.orderBy(*order_of())


def ranked(changes: DataFrame, *within: str) -> DataFrame:
    """The same order as a column, position, counted from 1 (within the given columns)."""
    return order.numbered(changes, order_of(), "position", within)


def summarize(changes: DataFrame, unmapped: DataFrame | None = None) -> DataFrame:
    """One row: totals by scope, risk and category (all categories, zero too), and unmapped changes."""
    of = lambda c, v, n: F.count_if(F.col(c) == v).alias(n)
    out = changes.agg(
        F.count(F.lit(1)).alias("total_changes"),
        of("scope", "symbol", "public_api_changes"),
        of("risk", "potentially-breaking", "potentially_breaking"),
        of("risk", "review-required", "review_required"),
        of("risk", "informational", "informational"),
        *(of("category", c, c.replace("-", "_")) for c in sorted(RISK)),
    )
    if unmapped is None:
        return out.withColumn("unmapped", F.lit(0).cast("bigint"))
    return out.crossJoin(unmapped.agg(F.count_if("unmapped").alias("unmapped")))  # one row each


def payload_digest(changes: DataFrame, column: str = "digest") -> DataFrame:
    """One row (digest, n): a digest over the digests of all changes, whatever their order.

    Digests are sorted and hashed within the 4096 classes of their first three digits, then the classes in order; so
    no row holds more than a class.
    """
    classes = changes.groupBy(F.substring(column, 1, 3).alias("c")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(column)), ","), 256).alias("d"), F.count(F.lit(1)).alias("k"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "d"))), lambda x: x["d"]), ",")
    return classes.agg(F.sha2(whole, 256).alias("digest"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
