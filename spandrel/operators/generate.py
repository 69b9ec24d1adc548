"""Deterministic documents from parsed modules and commits; what a language model would be asked otherwise."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.operators import order

SECTIONS = ("Added", "Fixed", "Changed")


# The sentences of the deterministic documents are our own.


def _bullets(items: Column, mark: str = "") -> Column:
    return F.transform(items, lambda x: F.concat(F.lit("- `"), x["name"], F.lit(f"{mark}` — "), F.coalesce(F.nullif(x["existing_doc"], F.lit("")), F.lit("No description"))))


def _by_path(*texts: str) -> Column:
    """The texts of all modules, which are made where the modules are: one row holds no more than what is written."""
    return F.array_sort(F.collect_list(F.struct("path", *texts)))


def readme(modules: DataFrame, name: str, description: str = "") -> DataFrame:
    """One row (content): a README with lists of functions and classes, modules by path."""
    own = lambda rows: F.when(F.size(rows) > 0, F.array_join(rows, "\n"))
    held = modules.select("path", own(_bullets(F.col("functions"), "()")).alias("f"), own(_bullets(F.col("classes"))).alias("c")).agg(_by_path("f", "c").alias("m"))

    def part(title: str, field: str) -> Column:
        rows = F.filter(F.transform("m", lambda m: m[field]), lambda x: x.isNotNull())
        return F.when(F.size(rows) > 0, F.concat(F.array(F.lit(f"### {title}"), F.lit("")), rows, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))

    head = F.array(*map(F.lit, (f"# {name}", "", f"> {description or 'A project'}", "", "## API", "")))
    return held.select(F.array_join(F.concat(head, part("Functions", "f"), part("Classes", "c")), "\n").alias("content"))


def _section(m: Column) -> Column:
    """What the API documentation says of one module."""
    doc = lambda x: F.coalesce(F.nullif(x["existing_doc"], F.lit("")), F.lit("No description available."))
    function = lambda f: F.concat(
        F.lit("### `"), f["name"], F.lit("("), F.array_join(F.transform(f["parameters"], lambda p: p["name"]), ", "), F.lit(")`\n\n"), doc(f), F.lit("\n\n**Returns:** `"), F.coalesce(f["return_type"], F.lit("unknown")), F.lit("`\n")
    )
    klass = lambda c: F.concat(F.lit("### Class: `"), c["name"], F.lit("`\n\n"), doc(c), F.lit("\n"))
    return F.concat(F.lit("## "), F.element_at(F.split(m["path"], "/"), -1), F.lit("\n\n"), F.array_join(F.concat(F.transform(m["functions"], function), F.transform(m["classes"], klass)), "\n"))


def api_docs(modules: DataFrame) -> DataFrame:
    """One row (content): a section for each module, by path, divided by rules."""
    held = modules.select("path", _section(F.struct("path", "functions", "classes")).alias("s")).agg(_by_path("s").alias("m"))
    return held.select(F.concat(F.lit("# API Documentation\n\n"), F.array_join(F.transform("m", lambda m: m["s"]), "\n---\n\n")).alias("content"))


def diagram(modules: DataFrame) -> DataFrame:
    """One row (content): a star of modules, the first by path in its centre."""
    name = lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]+\z", "")
    held = modules.agg(F.array_sort(F.collect_list("path")).alias("p"))
    nodes = F.transform("p", lambda p, i: F.concat(F.lit("    N"), i.cast("string"), F.lit('["'), name(p), F.lit('"]')))
    edges = F.when(F.size("p") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: F.concat(F.lit("    N0 --> N"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return held.select(F.array_join(F.concat(F.array(F.lit("graph TD")), nodes, edges), "\n").alias("content"))


def jsdoc(functions: DataFrame) -> DataFrame:
    """path, ordinal, name and a comment for each of functions (path, name, parameters, return_type, line_range)."""
    params = F.transform("parameters", lambda p: F.concat(F.lit(" * @param "), p["name"], F.lit(" - The "), p["name"], F.lit(" parameter\n")))
    comment = F.concat(F.lit("/**\n * "), "name", F.lit(" — generated documentation.\n"), F.array_join(params, ""), F.lit(" * @returns "), F.coalesce("return_type", F.lit("void")), F.lit("\n */"))
    return functions.select("path", F.element_at("line_range", 1).alias("ordinal"), "name", comment.alias("jsdoc"))


# --- documents of any size: fragments (part, path, place, text) that stand one below the other in this order ---------


def _fragment(df: DataFrame, part: int, text: Column, path: Column | None = None, place: Column | None = None) -> DataFrame:
    return df.select(F.lit(part).alias("part"), (path if path is not None else F.lit("")).alias("path"), (place if place is not None else F.lit(0)).cast("int").alias("place"), text.alias("text"))


def readme_fragments(modules: DataFrame, name: str, description: str = "") -> DataFrame:
    """readme(), a fragment for each function and class."""
    one = modules.sparkSession.range(1)
    out = _fragment(one, 0, F.lit(f"# {name}\n\n> {description or 'A project'}\n\n## API\n"))
    for at, title, column, mark in ((1, "Functions", "functions", "()"), (4, "Classes", "classes", "")):
        some = modules.agg(F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("n")).where("n > 0")  # one row or none
        own = modules.select("path", F.posexplode(column).alias("place", "x"))
        bullet = F.concat(F.lit("- `"), F.col("x.name"), F.lit(f"{mark}` — "), F.coalesce(F.nullif(F.col("x.existing_doc"), F.lit("")), F.lit("No description")))
        out = out.union(_fragment(some, at, F.lit(f"### {title}\n"))).union(_fragment(own, at + 1, bullet, F.col("path"), F.col("place"))).union(_fragment(some, at + 2, F.lit("")))
    return out


def api_fragments(modules: DataFrame) -> DataFrame:
    """api_docs(), a fragment for each module; rules stand between them, so all but the first begin with one."""
    numbered = order.numbered(modules.select("path", "functions", "classes"), ["path"])
    section = F.when(F.col("position") > 1, F.concat(F.lit("---\n\n"), _section(F.struct("path", "functions", "classes")))).otherwise(_section(F.struct("path", "functions", "classes")))
    head = _fragment(modules.sparkSession.range(1), 0, F.lit("# API Documentation\n"))
    return head.union(_fragment(numbered, 1, section, F.col("path")))


def diagram_fragments(modules: DataFrame) -> DataFrame:
    """diagram(), a fragment for each node and edge."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+\z", "")
    numbered = order.numbered(modules.select("path"), ["path"]).withColumn("i", (F.col("position") - 1).cast("string"))
    nodes = _fragment(numbered, 1, F.concat(F.lit("    N"), F.col("i"), F.lit('["'), name, F.lit('"]')), F.col("path"))
    edges = _fragment(numbered.where("position > 1"), 2, F.concat(F.lit("    N0 --> N"), F.col("i")), F.col("path"))
    return _fragment(modules.sparkSession.range(1), 0, F.lit("graph TD")).union(nodes).union(edges)


def changelog_fragments(commits: DataFrame, version: str, day: str | None = None) -> DataFrame:
    """changelog(), a fragment for each commit (position, message)."""
    date = F.lit(day) if day else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd")
    one = commits.sparkSession.range(1)
    out = _fragment(one, 0, F.concat(F.lit(f"## [{version}] - "), date))
    kind = F.array_position(F.array(*map(F.lit, SECTIONS)), changelog_section(F.col("message"))).cast("int")
    for k, title in enumerate(SECTIONS):
        out = out.union(_fragment(one, 2 * k + 1, F.lit(f"\n### {title}")))
    at = F.format_string("%020d", F.col("position").cast("bigint"))
    return out.union(commits.select((2 * kind).alias("part"), at.alias("path"), F.lit(0).alias("place"), F.concat(F.lit("- "), F.col("message")).alias("text")))


def placed(fragments: DataFrame) -> DataFrame:
    """position (from 1) and text of each fragment; the document is the texts with a line break between each two."""
    return order.numbered(fragments, ["part", "path", "place", "text"]).select("position", "text")


def changelog_section(message: Column, added: str = "feat", fixed: str = "fix") -> Column:
    return F.when(message.startswith(added), SECTIONS[0]).when(message.startswith(fixed), SECTIONS[1]).otherwise(SECTIONS[2])


def changelog(commits: DataFrame, version: str, day: str | None = None) -> DataFrame:
    """One row (content): the entry of a version, commits (position, message) grouped by their prefix."""
    date = F.lit(day) if day else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd")
    rows = F.array_sort(F.collect_list(F.struct("position", changelog_section(F.col("message")).alias("section"), "message")))
    held = commits.agg(rows.alias("r"))
    part = lambda s: F.concat(F.array(F.lit(f"### {s}")), F.transform(F.filter("r", lambda r: r["section"] == s), lambda r: F.concat(F.lit("- "), r["message"])))
    gap = F.array(F.lit(""))
    body = F.concat(F.array(F.concat(F.lit(f"## [{version}] - "), date)), gap, part(SECTIONS[0]), gap, part(SECTIONS[1]), gap, part(SECTIONS[2]))
    return held.select(F.array_join(body, "\n").alias("content"))


def prepend_changelog(existing: str | None, entry: str) -> str:
    """A changelog with the entry above the older ones; one without a title gets it."""
    title, old = "# Changelog", (existing or "").lstrip("﻿")
    if old.startswith(title):
        head, _, rest = old.partition("\n")
        return f"{head}\n\n{entry.strip()}\n\n{rest.lstrip()}".rstrip() + "\n"
    return f"{title}\n\n{entry.strip()}\n\n{old.strip()}".rstrip() + "\n"


def update_note(existing: str, records: int, day: str) -> str:
    return f"{existing}\n\n> Last updated: {day} ({records} impact records)\n"


#: For each operation what the model is told to be, and what it is asked.
SYSTEM = "You write documentation for software. Say only what the given facts say. Answer with the document alone."
PROMPTS = {
    "readme": "Write a README for the project {name}.\n\nDescription: {description}\nDependencies: {dependencies}\n\nModules:\n{modules}",
    "api": "Write API documentation in Markdown, a section for each module.\n\nModules:\n{modules}",
    "jsdoc": "Write a doc comment for this function, with its parameters and what it returns.\n\n{signature}",
    "diagram": "Write a Mermaid diagram, beginning with graph TD, of how these modules depend on each other.\n\nModules:\n{modules}",
    "changelog": "Write the entry of version {version} for a changelog, under Added, Fixed and Changed. Begin with ## [{version}].\n\nCommits:\n{commits}",
    "update": "Update this document for the changes below. Keep what they do not concern as it is.\n\nDocument:\n{existing}\n\nChanges, as JSON:\n{plan}",
}


def prompt(kind: str, **fields: str) -> str:
    """The prompt of an operation; fields that it does not name are refused, and so are missing ones."""
    named = {name for _, name, _, _ in string.Formatter().parse(PROMPTS[kind]) if name}
    if named != fields.keys():
        raise ValueError(f"the prompt {kind} takes {', '.join(sorted(named))}")
    return PROMPTS[kind].format(**fields)


def envelope(kind: str, **fields: str) -> tuple[str, str]:
    """(system, prompt) of an operation."""
    return SYSTEM, prompt(kind, **fields)


def module_lines(modules: DataFrame) -> DataFrame:
    """One row (text): a line for each module with the signatures of its functions."""
    line = F.concat(F.lit("- "), "path", F.lit(": "), F.array_join(F.transform("functions", lambda f: f["signature"]), "; "))
    return modules.select("path", line.alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n").alias("text"))


def generate(prompts: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """prompts (key, prompt) with content, from any function of a prompt; it runs on the executors."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "content": b["prompt"].map(model)})

    return prompts.select("key", "prompt").mapInPandas(run, "key string, content string")
