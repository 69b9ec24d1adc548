"""Changes to the documentation sections that mention them, and to target documents."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.functions import paths, text

#: Reasons in a fixed order.
REASONS = ("direct-reference", "recommendation", "explicit", "unmapped-public-change-fallback")
# Categories that call for API documentation, and below the names and words of topics. Fixed values.
API_CATEGORIES = ("added", "removed", "contract-changed")



def topics() -> dict[str, Column]:
    """How well a section stands for each topic: the least score, then file, slug and heading. Null: not at all."""
    name, heading = F.lower(paths.basename(F.col("file"))), F.col("heading")
    word = lambda w: heading.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{w})(?![A-Za-z0-9_])")
    return {
        "api": F.when(name == "api.md", 0).when(name.rlike(r"(?:^|[-_.])api(?:[-_.]|\z)"), 1).when(word("api") | heading.rlike("(?i)application programming interface"), 2),
        "changelog": F.when(name == "changelog.md", 0),
        "readme": F.when(name == "readme.md", 0),
        "architecture": F.when(name.contains("architecture"), 0).when(word("architecture|system design"), 1),
    }


def select_sections(sections: DataFrame) -> DataFrame:
    """One row (topic, file, heading, slug) for each topic that has a section: the least score, ties by file, slug, heading."""
    row = F.struct("file", "heading", "slug")
    best = [F.min_by(row, F.when(score.isNotNull(), F.struct(score, F.col("file"), F.col("slug"), F.col("heading")))).alias(t) for t, score in topics().items()]
    wide = sections.agg(*best)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(t).alias("topic"), F.col(t).alias("s")) for t in topics()))).alias("x")).where("x.s is not null").select("x.topic", "x.s.*")


def direct_references(changes: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, file, heading, slug, reason) where a section names a symbol in code, links its file, or is headed by it.

    A name stands in a text only between other characters than those of words, so the words that it consists of are
    words of the text too. Texts are cut into words, names are joined on their longest one, and only names of
    several parts are looked for in what they met; a name without any such character is found nowhere. The arms
    are equi-joins, of which Catalyst broadcasts a side where it is small.
    """
    linked = sections.select("file", "heading", "slug", F.explode("link_targets").alias("path"))
    by_link = changes.select("id", "path").join(linked, "path").select("id", "file", "heading", "slug", F.lit("source-link").alias("reason"))
    return named_references(changes, sections).union(by_link)


def named_references(changes: DataFrame, sections: DataFrame) -> DataFrame:
    """direct_references() of the sections that name a symbol in code or are headed by it."""
    named = changes.where("qualified_name is not null").select("id", "qualified_name", _key(F.col("qualified_name")).alias("key"))
    place = ("file", "heading", "slug")

    def arm(names: DataFrame, texts: DataFrame, reason: str) -> DataFrame:
        met = names.join(texts.select(*place, "text", F.explode(_words(F.col("text"))).alias("key")), "key")
        whole = (F.col("key") == F.col("qualified_name")) | text.contains_name(F.col("text"), F.col("qualified_name"))
        return met.where(whole).select("id", *place, F.lit(reason).alias("reason"))

    by_span = arm(named, sections.select(*place, F.explode("code_spans").alias("text")), "code-span")
    by_head = arm(named.where(text.is_heading_name(F.col("qualified_name"))), sections.select(*place, F.col("heading").alias("text")), "heading")
    return by_span.union(by_head)


def source_links(sections: DataFrame) -> DataFrame:
    """(path, file, slug, heading) of the sections that link a file: of one file and slug the first heading."""
    return sections.select("file", "slug", "heading", F.explode("link_targets").alias("path")).groupBy("path", "file", "slug").agg(F.min("heading").alias("heading"))


def _words(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"([\p{L}\p{M}\p{N}_$.]+)"), 1))


def _key(name: Column) -> Column:
    """The longest word of a name; of several the last in order."""
    return F.array_max(F.transform(_words(name), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("word")))).getField("word")


def recommendations(changes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, file, heading, slug, reason) by the rules for api, changelog, entry points and dependencies."""
    pick = {t: F.max(F.when(F.col("topic") == t, F.struct("file", "heading", "slug"))).alias(t) for t in topics()}
    row = chosen.agg(*pick.values())  # one row
    rule = lambda when, section, reason: F.when(when & section.isNotNull(), F.struct(section.alias("s"), F.lit(reason).alias("reason")))
    rules = F.array(
        rule((F.col("scope") == "symbol") & F.col("category").isin(*API_CATEGORIES), F.col("api"), "api-documentation"),
        rule(F.col("risk") == "potentially-breaking", F.col("changelog"), "changelog"),
        rule(paths.is_entrypoint(F.col("path")), F.coalesce("readme", "architecture"), "entrypoint"),
        rule(F.col("category") == "dependency-changed", F.coalesce("architecture", "readme"), "architecture"),
    )
    out = changes.crossJoin(F.broadcast(row)).select("id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
    return out.select("id", "r.s.*", "r.reason")


def first_wins(references: DataFrame) -> DataFrame:
    """Of references with the same file, slug and reason the first heading."""
    return references.groupBy("id", "file", "slug", "reason").agg(F.min("heading").alias("heading"))


def map_documentation(changes: DataFrame, sections: DataFrame) -> DataFrame:
    """For each change: direct and recommended references, sorted, and whether it has none."""
    direct = first_wins(direct_references(changes, sections)).withColumn("direct", F.lit(True))
    advised = first_wins(recommendations(changes, select_sections(sections))).withColumn("direct", F.lit(False))
    refs = direct.unionByName(advised).withColumn("ref", F.struct("file", F.col("heading").alias("section"), "slug", "reason"))
    order = lambda flag: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("direct") == flag, F.struct("file", "slug", "reason", "ref")))), lambda x: x["ref"]
    )
    per = refs.groupBy("id").agg(order(True).alias("direct_references"), order(False).alias("recommendations"))
    kind = per.schema["direct_references"].dataType
    out = changes.select(F.col("id").alias("change_id")).join(per, F.col("change_id") == F.col("id"), "left").drop("id")
    out = out.withColumns({c: F.coalesce(F.col(c), F.array().cast(kind)) for c in ("direct_references", "recommendations")})
    return out.withColumn("unmapped", (F.size("direct_references") == 0) & (F.size("recommendations") == 0))


class Impact:
    """What map_documentation() says, without a row that holds all references of a change.

    Every change of a file meets every section that links the file, so these pairs are as many as the product of both.
    They are kept as two tables, and joined only by rows(), whose pairs are made by as many tasks as a shuffle has and
    go nowhere but to the reader.
    """

    def __init__(self, changes: DataFrame, sections: DataFrame):
        self.changes = changes
        self.named = first_wins(named_references(changes, sections))
        self.advised = first_wins(recommendations(changes, select_sections(sections)))
        self.links = source_links(sections)

    def rows(self) -> DataFrame:
        """references() of all changes, in no order."""
        parts = int(self.changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        by_link = self.changes.select("id", "path").distinct().repartition(parts, "path").join(self.links.repartition(parts, "path"), "path")
        shown = lambda df, reason, tier: df.select(F.col("id").alias("change_id"), "file", F.col("heading").alias("section"), "slug", reason.alias("reason"), F.lit(tier).alias("tier"))
        direct = shown(self.named, F.col("reason"), REASONS[0]).union(shown(by_link, F.lit("source-link"), REASONS[0]))
        return direct.union(shown(self.advised, F.col("reason"), REASONS[1]))

    def unmapped(self) -> DataFrame:
        """The changes that have no reference."""
        ids = self.named.select("id").union(self.advised.select("id"))
        return self.changes.join(ids, "id", "left_anti").join(self.links.select("path"), "path", "left_anti")

    def candidates(self) -> DataFrame:
        """candidates() of rows()."""
        met = self.links.join(self.changes.select("path"), "path", "left_semi")
        shown = lambda df, tier: df.select("file", F.col("heading").alias("section"), F.lit(tier).alias("tier")).distinct()
        return _candidates(shown(self.named, REASONS[0]).union(shown(met, REASONS[0])).union(shown(self.advised, REASONS[1])))

    def targets(self, existing: DataFrame) -> DataFrame:
        """resolve_targets() without explicit ones."""
        return _existing_targets(self.candidates(), self.unmapped().where("scope = 'symbol'"), existing)


def safe_references(documentation: DataFrame, redact: Callable[[str], str]) -> DataFrame:
    """References whose headings hold secrets with redacted ones, their slugs made anew; redact(str) -> str."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def redacted(headings: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        for h in {h for own in headings if own is not None for h in own}:
            known[h] = redact(h)
        return headings.map(lambda own: None if own is None else [known[h] for h in own])

    def clean(column: str) -> Column:
        names = redacted(F.transform(column, lambda r: r["section"]))
        anew = lambda r, n: F.struct(r["file"].alias("file"), n.alias("section"), F.when(n == r["section"], r["slug"]).otherwise(text.slug(n)).alias("slug"), r["reason"].alias("reason"))
        return F.zip_with(column, names, anew)

    return documentation.withColumns({c: clean(c) for c in ("direct_references", "recommendations")})


def references(documentation: DataFrame) -> DataFrame:
    """(change_id, file, section, slug, reason, tier), tier being direct-reference or recommendation."""
    part = lambda column, tier: documentation.select("change_id", F.explode(column).alias("r")).select("change_id", "r.*", F.lit(tier).alias("tier"))
    return part("direct_references", REASONS[0]).union(part("recommendations", REASONS[1]))


def presentation(documentation: DataFrame) -> DataFrame:
    """(path, reasons, sections) of each file as it is named, without asking whether it exists: what a report shows
    where targets were not resolved. Without rows a target has to be given."""
    refs = references(documentation)
    seen = refs.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_set("tier")).alias("reasons"), F.array_sort(F.collect_set("section")).alias("sections"))
    return seen  # direct-reference comes before recommendation, as it is seen first


def projected_references(references: Column, is_safe: Callable[[Column], Column] = text.is_plain_identity) -> Column:
    """An array of references without those that hold what may not leave the repository, in canonical order."""
    safe = F.filter(references, lambda r: is_safe(r["file"]) & is_safe(r["section"]) & is_safe(r["slug"]))
    return text.canonical_sorted(safe)


def template_changes(documentation: DataFrame, changes: DataFrame) -> DataFrame:
    """For each change what a prompt says of it: id, category, risk, facets, direct and recommended targets.

    Changes without documentation keep empty targets; of several mappings of a change the last by its content counts.
    """
    target = lambda c: F.transform(c, lambda r: F.struct(r["file"].alias("file"), r["section"].alias("section")))
    one = documentation.groupBy("change_id").agg(F.max(F.struct("direct_references", "recommendations")).alias("d"))
    held = changes.join(one, changes.id == one.change_id, "left")
    none = F.array().cast("array<struct<file:string,section:string>>")
    return held.select(
        "id", "category", "risk", F.coalesce("changed_facets", F.array().cast("array<string>")).alias("changed_facets"),
        F.coalesce(target("d.direct_references"), none).alias("direct_targets"), F.coalesce(target("d.recommendations"), none).alias("recommended_targets"),
    )


def candidates(documentation: DataFrame) -> DataFrame:
    """(path, reasons, sections) of each file that a mapping points at; reasons in their fixed order."""
    return _candidates(references(documentation))


def _candidates(refs: DataFrame) -> DataFrame:
    refs = refs.withColumn("path", F.regexp_replace("file", r"^(\./)+", ""))
    seen = refs.groupBy("path").agg(F.collect_set("tier").alias("tiers"), F.array_sort(F.collect_set("section")).alias("sections"))
    return seen.select("path", F.filter(F.array(*map(F.lit, REASONS)), lambda r: F.array_contains("tiers", r)).alias("reasons"), "sections")


def resolve_targets(documentation: DataFrame, changes: DataFrame, existing: DataFrame, explicit: list[str] | None = None) -> DataFrame:
    """Target documents (path, reasons, sections): explicit ones, else mapped ones that exist, else the README
    if a public change is mapped nowhere. existing: path of every file. A target must be a Markdown file."""
    spark = documentation.sparkSession
    if explicit:
        none = F.array().cast("array<string>")
        asked = spark.createDataFrame([(p,) for p in sorted(set(explicit))], "path string")
        found = asked.join(existing.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
        missing = F.when(F.col("there"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no such target: "), "path")).cast("string"))
        return found.select(_markdown(missing).alias("path"), F.array(F.lit("explicit")).alias("reasons"), none.alias("sections"))
    public = changes.where("scope = 'symbol'").select(F.col("id").alias("change_id"))
    return _existing_targets(candidates(documentation), documentation.where("unmapped").join(public, "change_id", "left_semi"), existing)


def _markdown(p: Column) -> Column:
    return F.when(paths.is_markdown(p), p).otherwise(F.raise_error(F.concat(F.lit("not a Markdown file: "), p)).cast("string"))


def _existing_targets(found: DataFrame, lost: DataFrame, existing: DataFrame) -> DataFrame:
    """The candidates that exist, else the README if there are lost changes."""
    mapped = found.join(existing.select("path").distinct(), "path", "left_semi").withColumn("path", _markdown(F.col("path")))
    readme = existing.where("path = 'README.md'").select("path").distinct().join(lost.limit(1).select(F.lit(1).alias("one")), F.lit(True))
    readme = readme.select("path", F.array(F.lit(REASONS[3])).alias("reasons"), F.array().cast("array<string>").alias("sections"))
    any_mapped = mapped.agg(F.count(F.lit(1)).alias("n"))  # one row
    fallback = readme.crossJoin(F.broadcast(any_mapped)).where("n = 0").drop("n")  # one row at most
    return mapped.union(fallback)


def project(documentation: DataFrame, changes: DataFrame, target: str, reasons: list[str]) -> tuple[DataFrame, DataFrame]:
    """The mappings and changes that concern one target; all of them for an explicit one, the unmapped symbol
    changes for the fallback."""
    if "explicit" in reasons:
        return documentation, changes
    if REASONS[3] in reasons:
        docs = documentation.where("unmapped")
        return docs, changes.where("scope = 'symbol'").join(docs.select(F.col("change_id").alias("id")), "id", "left_semi")
    own = lambda c: F.filter(c, lambda r: F.regexp_replace(r["file"], r"^(\./)+", "") == target)
    docs = documentation.withColumns({c: own(c) for c in ("direct_references", "recommendations")})
    docs = docs.where((F.size("direct_references") > 0) | (F.size("recommendations") > 0)).withColumn("unmapped", F.lit(False))
    return docs, changes.join(docs.select(F.col("change_id").alias("id")), "id", "left_semi")


def has_impact(documentation: DataFrame, changes: DataFrame) -> bool:
    public = changes.where("scope = 'symbol'").select(F.col("id").alias("change_id"))
    mapped = (F.size("direct_references") > 0) | (F.size("recommendations") > 0)
    return not documentation.where(mapped).isEmpty() or not documentation.where("unmapped").join(public, "change_id", "left_semi").isEmpty()
