"""Documentation coverage of parsed modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions import text


def documented_symbols(modules: DataFrame) -> DataFrame:
    """(file, name, doc): exported functions and classes, and the public methods of these classes."""
    entry = lambda name, doc: F.struct(name.alias("name"), doc.alias("doc"))
    functions = F.transform(F.filter("functions", lambda f: f["is_exported"]), lambda f: entry(f["name"], f["existing_doc"]))
    public = lambda c: F.filter(c["methods"], lambda m: m["visibility"] == "public")
    classes = F.transform(
        F.filter("classes", lambda c: c["is_exported"]),
        lambda c: F.concat(F.array(entry(c["name"], c["existing_doc"])), F.transform(public(c), lambda m: entry(F.concat(c["name"], F.lit("."), m["name"]), m["existing_doc"]))),
    )
    return modules.select(F.col("path").alias("file"), F.explode_outer(F.concat(functions, F.flatten(classes))).alias("s")).select("file", "s.name", "s.doc")


def coverage(symbols: DataFrame, key: str = "file") -> DataFrame:
    """Per key and in all (key null, is_total true): total, documented, low_quality, coverage, band.

    symbols has key, name and doc; a row with a null name counts nothing.
    """
    named = F.col("name").isNotNull()
    count = lambda c: F.count_if(named & c)
    counted = symbols.groupBy(key).agg(
        F.count_if(named).alias("total"),
        count(text.is_documented(F.col("doc"))).alias("documented"),
        count(text.is_stub(F.col("doc"))).alias("low_quality"),
        F.array_sort(F.collect_list(F.when(named & ~text.is_documented(F.col("doc")), F.col("name")))).alias("undocumented"),
    )
    per = counted.select(key, F.lit(False).alias("is_total"), "total", "documented", "low_quality", "undocumented")
    numbers = ("total", "documented", "low_quality")
    whole = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers))  # names stay with their keys
    whole = whole.select(F.lit(None).cast(symbols.schema[key].dataType).alias(key), F.lit(True).alias("is_total"), *numbers, F.array().cast("array<string>").alias("undocumented"))
    share = text.percent(F.col("documented"), F.col("total"))
    return per.union(whole).withColumn("coverage", share).withColumn("band", text.band(F.col("coverage")))


def score_modules(modules: DataFrame) -> DataFrame:
    return coverage(documented_symbols(modules))


def report_fragments(scores: DataFrame, style: str = "text") -> DataFrame:
    """The report in fragments (part, path, place, text): its head, then a line for each file."""
    part = F.concat(F.col("documented").cast("string"), F.lit("/"), F.col("total").cast("string"))
    head = F.concat(F.lit("Documentation score: "), F.col("coverage").cast("string"), F.lit("/100 ("), F.col("band"), F.lit(")"))
    if style == "markdown":
        head = F.concat(F.lit("# "), head, F.lit("\n\n| Module | Coverage | Documented |\n| --- | --- | --- |"))
        line = F.concat(F.lit("| "), F.col("file"), F.lit(" | "), F.col("coverage").cast("string"), F.lit("% | "), part, F.lit(" |"))
    else:
        line = F.concat(F.lit("  "), F.col("file"), F.lit(": "), F.col("coverage").cast("string"), F.lit("% ("), part, F.lit(")"))
    return scores.select(F.when(F.col("is_total"), 0).otherwise(1).alias("part"), F.coalesce("file", F.lit("")).alias("path"), F.lit(0).alias("place"), F.when(F.col("is_total"), head).otherwise(line).alias("text"))


def report(scores: DataFrame, style: str = "text") -> DataFrame:
    """One row with the report: text, markdown or json."""
    files = F.array_sort(F.collect_list(F.when(~F.col("is_total"), F.struct("file", "coverage", "documented", "total", "undocumented"))))
    whole = F.max_by(F.struct("coverage", "band", "documented", "total", "low_quality"), F.col("is_total"))
    held = scores.agg(files.alias("files"), whole.alias("whole"))
    part = lambda f: F.concat(f["documented"].cast("string"), F.lit("/"), f["total"].cast("string"))
    if style == "json":
        return held.select(F.to_json(F.struct(F.col("files").alias("modules"), F.col("whole.coverage").alias("score"), F.col("whole.band").alias("band"), F.col("whole.total").alias("total"), F.col("whole.documented").alias("documented"), F.col("whole.low_quality").alias("low_quality"))).alias("report"))
    head = F.concat(F.lit("Documentation score: "), F.col("whole.coverage").cast("string"), F.lit("/100 ("), F.col("whole.band"), F.lit(")"))
    if style == "markdown":
        rows = F.transform("files", lambda f: F.concat(F.lit("| "), f["file"], F.lit(" | "), f["coverage"].cast("string"), F.lit("% | "), part(f), F.lit(" |")))
        lines = F.concat(F.array(F.concat(F.lit("# "), head), F.lit(""), F.lit("| Module | Coverage | Documented |"), F.lit("| --- | --- | --- |")), rows)
    else:
        lines = F.concat(F.array(head), F.transform("files", lambda f: F.concat(F.lit("  "), f["file"], F.lit(": "), f["coverage"].cast("string"), F.lit("% ("), part(f), F.lit(")"))))
    return held.select(F.array_join(lines, "\n").alias("report"))
