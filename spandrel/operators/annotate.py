"""Comments paired with functions and put into source texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fifo_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str, ordinal: str = "n") -> DataFrame:
    """The n-th row of a key on the left with the n-th on the right; what is left over is dropped."""
    number = lambda df, order: df.withColumn(ordinal, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return number(left, left_order).join(number(right, right_order), [*keys, ordinal])


def splice(sources: DataFrame, notes: DataFrame, key: str, indent: bool = True) -> DataFrame:
    """sources (key, text) with the comments of notes (key, line, name, comment) before their lines.

    Lines count from 1 in the text as it was, so no comment moves another. Of several at a line the one whose
    name is last comes first. With indent, a comment is indented like its line. CRLF texts stay so.
    """
    newline = F.when(F.col("text").contains("\r\n"), F.lit("\r\n")).otherwise(F.lit("\n"))
    by_line = notes.groupBy(key, "line").agg(F.reverse(F.array_sort(F.collect_list(F.struct("name", "comment")))).alias("own"))
    grouped = by_line.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "own"))).alias("notes"))
    held = sources.join(grouped, key, "left").withColumns({"newline": newline, "lines": F.split("text", "\r?\n")})
    none = F.array().cast(grouped.schema["notes"].dataType)
    held = held.withColumn("notes", F.filter(F.coalesce("notes", none), lambda n: (n["line"] >= 1) & (n["line"] <= F.size("lines"))))

    def put(note, index):
        """The comments of one line, and the lines from it up to the next that has some: each line is copied once."""
        lead = F.regexp_extract(F.get("lines", note["line"] - 1), r"^(\s*)", 1) if indent else F.lit("")
        shifted = F.transform(note["own"], lambda n: F.array_join(F.transform(F.split(n["comment"], "\r?\n"), lambda c: F.concat(lead, c)), "\n"))
        after = F.coalesce(F.get("notes", index + 1)["line"], F.size("lines") + 1)
        return F.concat(shifted, F.slice("lines", note["line"], after - note["line"]))

    first = F.coalesce(F.get("notes", F.lit(0))["line"], F.size("lines") + 1)
    text = F.array_join(F.concat(F.slice("lines", F.lit(1), first - 1), F.flatten(F.transform("notes", put))), "\n")
    out = F.when(F.col("newline") == "\r\n", F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    return held.select(key, out.alias("text"))


def annotate(sources: DataFrame, functions: DataFrame, notes: DataFrame) -> DataFrame:
    """sources (path, content) with the generated notes (path, ordinal, name, jsdoc) before functions (path, name,
    line_range) of the same name, the n-th note of a name with the n-th function."""
    left = notes.select("path", "name", F.col("ordinal").alias("note_order"), F.col("jsdoc").alias("comment"))
    right = functions.select("path", "name", F.element_at("line_range", 1).alias("line"))
    pairs = fifo_join(left, right, ["path", "name"], "note_order", "line")
    out = splice(sources.select("path", F.col("content").alias("text")), pairs.select("path", "line", "name", "comment"), "path")
    return out.withColumnRenamed("text", "content")
