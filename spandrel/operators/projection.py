"""What of changes, their documentation and their summary may leave the repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions import canonical, paths, secrets, text
from spandrel.operators import diff

#: Kinds of symbols that a change can be of. Fixed values.
KINDS = ("class", "enum", "function", "interface", "method", "module", "type")


def is_safe(*values: Column) -> Column:
    """No identity among the values (null is none) holds control characters, secrets or places outside the repository.

    They pass through Python together, once a row.
    """
    every = F.array(*(F.coalesce(v, F.lit("")) for v in values))
    return F.forall(every, text.is_plain_identity) & (F.size(secrets.matches(F.array_join(every, "\n"), user_paths=True)) == 0)


def candidates(changes: DataFrame) -> DataFrame:
    """changes with full and compact, canonical JSON of what may be told of each.

    full needs identities that are safe and a path inside the repository; compact needs a digest that is one. Rows that
    have neither, or a category, risk or kind that is none, are left out.
    """
    known = F.col("category").isin(*diff.RISK) & F.col("risk").isin(*set(diff.RISK.values())) & F.col("kind").isin(*KINDS)
    inside = F.coalesce(paths.is_repository_relative(F.col("path")), F.lit(False)) & F.col("id").isNotNull()
    full = F.when(inside & is_safe(F.col("id"), F.col("path"), F.col("qualified_name")), canonical.rows(changes))
    short = F.concat(*(x for k in ("category", "digest", "kind", "risk") for x in (F.lit(f'"{k}":'), canonical.quoted(F.col(k)), F.lit(","))))
    compact = F.when(F.coalesce(F.col("digest").rlike(r"^[0-9a-f]{64}\z"), F.lit(False)), F.concat(F.lit('{"compacted":true,'), F.substr(short, F.lit(1), F.char_length(short) - 1), F.lit("}")))
    return changes.where(known).withColumns({"full": full, "compact": compact}).where("full is not null or compact is not null")


def with_documentation(rows: DataFrame, documentation: DataFrame) -> DataFrame:
    """rows (id, ...) with docs, canonical JSON of the mappings of each change in order; empty where it has none."""
    own = documentation.select(F.col("change_id").alias("id"), canonical.rows(documentation).alias("doc")).groupBy("id").agg(F.array_sort(F.collect_list("doc")).alias("docs"))  # of one change
    return rows.join(own, "id", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))


def summary(row: DataFrame) -> DataFrame:
    """The same summary with zero where a count is missing; the job fails on one that is below zero."""
    checked = lambda c: F.when(F.col(c) < 0, F.raise_error(F.lit(f"{c} is below zero")).cast("bigint")).otherwise(F.coalesce(F.col(c), F.lit(0)).cast("bigint"))
    return row.select(*(checked(c).alias(c) for c in row.columns))
