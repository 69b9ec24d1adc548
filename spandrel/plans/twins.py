"""The engine's operators on general tables, each with the same query in SQL.

The tables hold no source code, so rows of orders, events, documents and pages stand for symbols, changes,
sections and files; the functions that run are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.functions import paths, secrets, text
from spandrel.operators import diff, freshness, mapping, pack, score

QUERIES, SQL = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def twin(sql: str | None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- coverage ---------------------------------------------------------------------------------------------------

_DOCS = """
WITH s AS (SELECT d.source AS file, CASE WHEN l.quality = 1 THEN 'x' END AS doc FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT file, grouping(file) = 1 AS is_total, count(*) AS total, count(*) FILTER (doc IS NOT NULL) AS documented FROM s GROUP BY GROUPING SETS ((file), ())),
p AS (SELECT *, CASE WHEN total = 0 THEN 100 ELSE floor(documented::DOUBLE / total * 100 + 0.5)::INT END AS coverage FROM g)
SELECT file, is_total, total, documented, coverage, CASE WHEN coverage < 40 THEN 'poor' WHEN coverage < 70 THEN 'fair' ELSE 'good' END AS band FROM p
"""


@twin(_DOCS)
def doc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documented symbols by file and in all: sources as files, good documents as documented symbols."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"))
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    symbols = docs.join(quality, "doc_id", "left").select("file", F.col("doc_id").cast("string").alias("name"), F.when(F.col("quality") == 1, "x").alias("doc"))
    return score.coverage(symbols).select("file", "is_total", "total", "documented", "coverage", "band")


# --- snapshots --------------------------------------------------------------------------------------------------

_VERSIONS = """
before AS (SELECT o_orderkey AS k, o_orderpriority AS kind, o_orderstatus AS contract, floor(o_totalprice)::BIGINT::VARCHAR AS impl, o_custkey::VARCHAR AS doc FROM orders),
after AS (SELECT k, kind, CASE WHEN k % 5 = 0 THEN 'X' ELSE contract END AS contract, CASE WHEN k % 11 = 0 THEN impl || '1' ELSE impl END AS impl,
  CASE WHEN k % 13 = 0 THEN doc || '1' ELSE doc END AS doc FROM before WHERE k % 7 <> 0
  UNION ALL SELECT k + 100000000, kind, contract, impl, doc FROM before WHERE k % 17 = 0)
"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Symbols of two versions of orders: some keys go, some come, some change in one of three ways."""
    orders = table(spark, sf_dir, "orders")
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    shape = lambda df, key, contract, impl, doc: df.select(
        F.lit("orders").alias("file_id"), F.lit(0).alias("ordinal"), F.lit("sql").alias("language"), F.col("o_orderpriority").alias("kind"), key.cast("string").alias("qualified_name"),
        F.create_map(F.lit("parameters"), contract, F.lit("return"), F.lit("r"), F.lit("members"), impl).alias("contract_facets"), contract.alias("contract_fp"), impl.alias("implementation_fp"), doc.alias("documentation_fp"), none.alias("x"),
    ).drop("x")
    contract, impl, doc = F.col("o_orderstatus"), F.floor("o_totalprice").cast("string"), F.col("o_custkey").cast("string")
    before = shape(orders, k, contract, impl, doc)
    changed = shape(
        orders.where(k % 7 != 0), k, F.when(k % 5 == 0, F.lit("X")).otherwise(contract), F.when(k % 11 == 0, F.concat(impl, F.lit("1"))).otherwise(impl), F.when(k % 13 == 0, F.concat(doc, F.lit("1"))).otherwise(doc)
    )
    return before, changed.union(shape(orders.where(k % 17 == 0), k + 100000000, contract, impl, doc))


def _changes(spark: SparkSession, sf_dir: str, status: str = "modified") -> DataFrame:
    before, after = _versions(spark, sf_dir)
    files = spark.createDataFrame([("orders", status, "a/orders", "b/orders" if status == "renamed" else "a/orders")], "file_id string, status string, before_path string, after_path string")
    return diff.compare_symbols(files, before, after)


_CHANGES = f"""
WITH {_VERSIONS}, j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.kind, b.kind) AS kind,
  CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.contract <> b.contract THEN 'contract-changed'
       WHEN a.impl <> b.impl THEN 'implementation-changed' WHEN a.doc <> b.doc THEN 'documentation-changed' END AS category,
  a.contract <> b.contract AS c1, a.impl <> b.impl AS c2
  FROM before b FULL OUTER JOIN after a ON a.k = b.k AND a.kind = b.kind),
c AS (SELECT k::VARCHAR AS qualified_name, kind, category, 'sql:a/orders#' || kind || ':' || k AS id,
  CASE category WHEN 'removed' THEN 'potentially-breaking' WHEN 'contract-changed' THEN 'review-required' ELSE 'informational' END AS risk,
  CASE WHEN category = 'contract-changed' THEN CASE WHEN c2 THEN 'members,parameters' ELSE 'parameters' END END AS facets FROM j WHERE category IS NOT NULL)
"""


@twin(f"{_CHANGES} SELECT id, category, risk, kind, qualified_name FROM c")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("id", "category", "risk", "kind", "qualified_name")


@twin(f"{_CHANGES} SELECT id, facets FROM c WHERE category = 'contract-changed'")
def changed_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).where("category = 'contract-changed'").select("id", F.array_join("changed_facets", ",").alias("facets"))


@twin(f"""
WITH {_VERSIONS}, j AS (SELECT b.k AS bk, a.k AS ak, coalesce(a.k, b.k) AS k, coalesce(a.kind, b.kind) AS kind,
  b.k IS NOT NULL AND a.k IS NOT NULL AND a.contract = b.contract AND a.impl = b.impl AND a.doc = b.doc AS same
  FROM before b FULL OUTER JOIN after a ON a.k = b.k AND a.kind = b.kind)
SELECT 'moved' AS category, 'sql:b/orders#' || kind || ':' || k AS id, 'sql:a/orders#' || kind || ':' || k AS before_id FROM j WHERE same
UNION ALL SELECT 'removed', 'sql:a/orders#' || kind || ':' || k, NULL FROM j WHERE NOT same AND bk IS NOT NULL
UNION ALL SELECT 'added', 'sql:b/orders#' || kind || ':' || k, NULL FROM j WHERE NOT same AND ak IS NOT NULL
""")
def moved_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A renamed file: equal symbols moved, all others removed and added."""
    return _changes(spark, sf_dir, "renamed").select("category", "id", "before_id")


@twin(f"""{_CHANGES} SELECT count(*) AS total_changes, count(*) AS public_api_changes, count(*) FILTER (risk = 'potentially-breaking') AS potentially_breaking,
  count(*) FILTER (risk = 'review-required') AS review_required, count(*) FILTER (risk = 'informational') AS informational,
  count(*) FILTER (category = 'added') AS added, count(*) FILTER (category = 'contract-changed') AS contract_changed, 0::BIGINT AS dependency_changed,
  count(*) FILTER (category = 'documentation-changed') AS documentation_changed, count(*) FILTER (category = 'implementation-changed') AS implementation_changed,
  0::BIGINT AS moved, count(*) FILTER (category = 'removed') AS removed, 0::BIGINT AS unmapped FROM c""")
def impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.summarize(_changes(spark, sf_dir))


_WEIGHT = "CASE category WHEN 'removed' THEN 1 WHEN 'contract-changed' THEN 2 WHEN 'moved' THEN 3 WHEN 'added' THEN 4 WHEN 'dependency-changed' THEN 5 WHEN 'implementation-changed' THEN 6 ELSE 7 END"


@twin(f"{_CHANGES} SELECT id, kind, category, row_number() OVER (PARTITION BY kind ORDER BY {_WEIGHT}, qualified_name, id) AS position FROM c")
def change_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each change within its kind."""
    return diff.ranked(_changes(spark, sf_dir), "kind").select("id", "kind", "category", "position")


@twin(f"""{_CHANGES}, d AS (SELECT sha256('{{"category":"' || category || '",' || CASE WHEN facets IS NOT NULL THEN '"changedContractFacets":["' || replace(facets, ',', '","') || '"],' ELSE '' END
  || '"id":"' || id || '","kind":"' || kind || '","language":"sql","path":"a/orders","qualifiedName":"' || qualified_name || '","risk":"' || risk || '","scope":"symbol"}}') AS digest FROM c)
, g AS (SELECT substr(digest, 1, 3) AS c, sha256(string_agg(digest, ',' ORDER BY digest)) AS h, count(*) AS k FROM d GROUP BY 1)
SELECT sha256(string_agg(h, ',' ORDER BY c)) AS digest, sum(k)::BIGINT AS n FROM g""")
def change_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over the canonical JSON of all changes."""
    return diff.payload_digest(_changes(spark, sf_dir))


@twin("SELECT event_type AS kind, user_id::VARCHAR AS qualified_name, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.select(F.lit("f").alias("file_id"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("qualified_name"), "value", F.col("event_id").alias("ordinal"))
    return diff.last_wins(rows).select("kind", "qualified_name", "value")


# --- documentation ----------------------------------------------------------------------------------------------


@twin("""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_$.]+')) AS w FROM documents),
names AS (SELECT DISTINCT regexp_extract(p_name, '^[a-z]+') AS name FROM part UNION SELECT unnest(['thonti', 'erinnd', 'das', 'loser', 'token', 'of', 'the']))
SELECT name, count(DISTINCT doc_id) AS sections FROM words JOIN names ON w = name GROUP BY name""")
def section_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts name a term as a whole word: the code-span arm of the mapping."""
    docs, part = table(spark, sf_dir, "documents"), table(spark, sf_dir, "part")
    sections = docs.select(F.col("doc_id").cast("string").alias("file"), F.lit("h").alias("heading"), F.lit("h").alias("slug"), F.lit(0).alias("ordinal"), F.array("text").alias("code_spans"), F.array().cast("array<string>").alias("link_targets"))
    extra = F.explode(F.array(*map(F.lit, ("thonti", "erinnd", "das", "loser", "token", "of", "the"))))
    names = part.select(F.regexp_extract("p_name", "^[a-z]+", 0).alias("qualified_name")).union(spark.range(1).select(extra)).distinct()
    changes = names.select(F.col("qualified_name").alias("id"), "qualified_name", F.lit("none").alias("path"))
    refs = mapping.direct_references(changes, sections).where("reason = 'code-span'")
    return refs.groupBy(F.col("id").alias("name")).agg(F.countDistinct("file").alias("sections"))


@twin("""WITH h AS (SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS heading FROM pages)
SELECT page_id, heading, replace(regexp_replace(lower(trim(heading)), '[^\\p{L}\\p{M}\\p{N}_ -]', '', 'g'), ' ', '-') AS slug FROM h WHERE heading <> ''""")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("heading")).where("heading <> ''")
    return heads.withColumn("slug", text.slug(F.col("heading")))


_DOCUMENTATION = """
refs AS (SELECT e.event_id AS change_id, '/u' || (e.user_id % 97) || '.md' AS file, e.event_type AS section, CASE WHEN e.event_id % 3 = 0 THEN 'recommendation' ELSE 'direct-reference' END AS tier FROM events e WHERE e.event_id % 4 <> 0)
"""


def _documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes, each mapped to a file by its user; every fourth is mapped nowhere."""
    e = table(spark, sf_dir, "events")
    ref = F.array(F.struct(F.concat(F.lit("/u"), (F.col("user_id") % 97).cast("string"), F.lit(".md")).alias("file"), F.col("event_type").alias("section"), F.col("event_type").alias("slug"), F.lit("heading").alias("reason")))
    none = F.array().cast("array<struct<file:string,section:string,slug:string,reason:string>>")
    mapped, advised = F.col("event_id") % 4 != 0, F.col("event_id") % 3 == 0
    return e.select(
        F.col("event_id").alias("change_id"), F.when(mapped & ~advised, ref).otherwise(none).alias("direct_references"), F.when(mapped & advised, ref).otherwise(none).alias("recommendations"), (~mapped).alias("unmapped")
    )


@twin(f"""WITH {_DOCUMENTATION} SELECT file AS path, string_agg(DISTINCT tier, ',' ORDER BY tier) AS reasons, string_agg(DISTINCT section, ',' ORDER BY section) AS sections FROM refs GROUP BY file""")
def target_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.candidates(_documentation(spark, sf_dir)).select("path", F.array_join("reasons", ",").alias("reasons"), F.array_join("sections", ",").alias("sections"))


@twin(f"""WITH {_DOCUMENTATION}, mapped AS (SELECT DISTINCT file AS path, 1 AS tier FROM refs WHERE substr(file, 3, 1) = '1'), fallback AS (SELECT 'README.md' AS path, 2 AS tier WHERE EXISTS (SELECT 1 FROM events WHERE event_id % 4 = 0)),
r AS (SELECT path, rank() OVER (ORDER BY tier) AS k FROM (SELECT * FROM mapped UNION ALL SELECT * FROM fallback)) SELECT path FROM r WHERE k = 1""")
def target_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped targets that exist, or else the README."""
    docs = _documentation(spark, sf_dir)
    changes = docs.select(F.col("change_id").alias("id"), F.lit("symbol").alias("scope"))
    existing = mapping.candidates(docs).select("path").where(F.substring("path", 3, 1) == "1").union(spark.range(1).select(F.lit("README.md")))
    return mapping.resolve_targets(docs, changes, existing).select("path")


@twin(f"WITH {_DOCUMENTATION} SELECT event_id AS id, event_type AS kind FROM events WHERE EXISTS (SELECT 1 FROM refs WHERE change_id = event_id AND file = '/u7.md')")
def context_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that concern one target."""
    changes = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return mapping.project(_documentation(spark, sf_dir), changes, "/u7.md", ["direct-reference"])[1].select("id", "kind")


@twin("""WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'click')
SELECT a.user_id, a.n, a.event_id AS left_id, b.event_id AS right_id FROM a JOIN b USING (user_id, n)""")
def fifo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spandrel.operators.annotate import fifo_join

    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("left_id"))
    right = events.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("right_id"))
    return fifo_join(left, right, ["user_id"], "left_id", "right_id", "n").select("user_id", F.col("n").cast("bigint").alias("n"), "left_id", "right_id")


@twin("SELECT l_orderkey AS id, l_returnflag AS slug, l_linestatus AS reason, min(l_partkey) AS heading FROM lineitem GROUP BY ALL")
def first_wins_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("f").alias("file"), F.col("l_returnflag").alias("slug"), F.col("l_linestatus").alias("reason"), F.col("l_partkey").alias("heading"))
    return mapping.first_wins(rows).select("id", "slug", "reason", "heading")


# --- choice under a budget, intervals, placeholders ----------------------------------------------------------------


@twin("""WITH RECURSIVE o AS (SELECT o_custkey AS k, o_orderkey AS id, floor(o_totalprice)::BIGINT AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
f AS (SELECT k, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS id, NULL::VARCHAR AS form FROM (SELECT DISTINCT k FROM o)
  UNION ALL SELECT f.k, f.n + 1, f.used + CASE WHEN f.used + o.size <= 500000 THEN o.size WHEN f.used + o.size // 3 <= 500000 THEN o.size // 3 ELSE 0 END, o.id,
  CASE WHEN f.used + o.size <= 500000 THEN 'full' WHEN f.used + o.size // 3 <= 500000 THEN 'compact' END FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1)
SELECT k AS custkey, id AS orderkey, form FROM f WHERE form IS NOT NULL""")
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer in order of their keys, in full or in a third of the size, first fit."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.floor("o_totalprice").alias("full"), F.floor(F.floor("o_totalprice") / 3).alias("compact"))
    return pack.pack_groups(orders, "custkey", "o_orderkey", "full", "compact", 500_000).select("custkey", F.col("order").alias("orderkey"), "form")


@twin("""WITH RECURSIVE i AS (SELECT user_id AS k, event_id AS id, (floor(epoch(ts))::BIGINT // 60) AS s, (floor(epoch(ts))::BIGINT // 60) + 30 + event_id % 600 AS e, event_id % 4 AS p FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, p DESC, e DESC, id) AS n FROM i),
f AS (SELECT k, 0::BIGINT AS n, -1::BIGINT AS last, NULL::BIGINT AS s, NULL::BIGINT AS e FROM (SELECT DISTINCT k FROM o)
  UNION ALL SELECT f.k, f.n + 1, CASE WHEN o.s >= f.last THEN o.e ELSE f.last END, CASE WHEN o.s >= f.last THEN o.s END, CASE WHEN o.s >= f.last THEN o.e END FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1)
SELECT k AS user_id, s AS start_min, e AS end_min FROM f WHERE s IS NOT NULL""")
def greedy_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of each user that are accepted: by start, priority, length; none that overlaps an accepted one."""
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).cast("int")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", minute.cast("bigint").alias("start_min"), (minute + 30 + F.col("event_id") % 600).cast("bigint").alias("end_min"), (F.col("event_id") % 4).alias("priority"))
    kept = pack.non_overlapping(rows, "user_id", "start_min", "end_min", [F.desc("priority"), F.desc("end_min"), "event_id"])
    return kept.select("user_id", "start_min", "end_min")


@twin("""WITH f AS (SELECT user_id, event_type, value, min(event_id) AS first FROM (SELECT user_id, event_type, floor(value)::BIGINT AS value, event_id FROM events) GROUP BY ALL)
SELECT user_id, event_type, value, dense_rank() OVER (PARTITION BY user_id, event_type ORDER BY first) AS ordinal FROM f""")
def placeholder_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of distinct values within a session and kind, by first appearance."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor("value").alias("value"), "event_id")
    return secrets.number_values(rows, "user_id", "event_type", "value", "event_id").select("user_id", "event_type", "value", F.col("ordinal").cast("bigint").alias("ordinal")).distinct()


# --- secrets ----------------------------------------------------------------------------------------------------

@twin("""WITH p AS (SELECT user_id, event_type AS kind, event_id % 8 AS part, count(*) AS c, max(event_id % 3) AS a FROM events GROUP BY ALL)
SELECT kind, sum(c)::BIGINT AS count, ['allowed', 'warned', 'redacted'][max(a) + 1] AS action FROM p GROUP BY kind""")
def finding_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial counts and actions merged to one row a kind."""
    action = F.element_at(F.array(*map(F.lit, secrets.ACTIONS)), (F.col("event_id") % 3 + 1).cast("int"))
    parts = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("kind"), (F.col("event_id") % 8).alias("part")).agg(F.count(F.lit(1)).alias("count"), secrets.strongest_action(action).alias("action"))
    merged = secrets.merge_findings(parts)
    return merged.join(parts.groupBy("kind").agg(secrets.strongest_action(F.col("action")).alias("action")), "kind")


# --- freshness, paths, texts ----------------------------------------------------------------------------------------


@twin("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'click') AS sources, bool_or(event_type = 'view') AS target FROM events GROUP BY ALL)
SELECT user_id, day, CASE WHEN user_id % 5 = 0 THEN 'missing' WHEN sources > 0 AND NOT target THEN 'stale' WHEN sources = 0 THEN 'clean' ELSE 'co-changed' END AS status FROM d""")
def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as changed sources, views as changes of the target, by user and day."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("sources"), F.bool_or(F.col("event_type") == "view").alias("target"))
    return days.select("user_id", "day", freshness.verdict(F.col("user_id") % 5 != 0, F.col("sources"), F.col("target")).alias("status"))


_URL_PATH = "regexp_replace(url, '^[a-z]+://[^/]*/?', '')"


@twin(f"""WITH p AS (SELECT page_id, url, {_URL_PATH} AS path FROM pages)
SELECT page_id, path, regexp_matches(path, '^([^./][^/]*/)*[^./][^/]*$') AND NOT (regexp_matches(path, '^[^/]*1[^/]*$') AND NOT starts_with(path, '.')) AS in_scope FROM p""")
def path_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    chosen = paths.matches_any(path, ["**/*"]) & ~paths.matches_any(path, ["*1*"])
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), chosen.alias("in_scope"))


@twin(f"""WITH p AS (SELECT page_id, {_URL_PATH} AS path FROM pages), n AS (SELECT page_id, path, lower(string_split(path, '/')[-1]) AS name FROM p)
SELECT page_id, regexp_matches(name, '^(index|main)\\.[^.]+$') OR (NOT contains(path, '/') AND regexp_matches(name, '\\.([cm]?tsx?|py)$')) AS entry FROM n""")
def entrypoint_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.is_entrypoint(F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")).alias("entry"))


@twin("""WITH v AS (SELECT doc_id, text AS before, CASE WHEN doc_id % 3 = 0 THEN text ELSE replace(text, 'the', 'THE') || chr(10) || 'end' END AS after FROM documents)
SELECT doc_id, before <> after AS changed, CASE WHEN before = '' THEN 0 ELSE len(regexp_split_to_array(before, '\\r\\n|\\r|\\n')) END AS before_lines,
CASE WHEN after = '' THEN 0 ELSE len(regexp_split_to_array(after, '\\r\\n|\\r|\\n')) END AS after_lines, strlen(before) AS old_bytes, strlen(after) AS new_bytes FROM v""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and byte counts of two versions of each text."""
    after = F.when(F.col("doc_id") % 3 == 0, F.col("before")).otherwise(F.concat(F.replace(F.col("before"), F.lit("the"), F.lit("THE")), F.lit("\nend")))
    v = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("before")).withColumn("after", after)
    return v.select(
        "doc_id", (F.col("before") != F.col("after")).alias("changed"), text.line_count(F.col("before")).cast("bigint").alias("before_lines"), text.line_count(F.col("after")).cast("bigint").alias("after_lines"),
        F.octet_length("before").cast("bigint").alias("old_bytes"), F.octet_length("after").cast("bigint").alias("new_bytes"),
    )


@twin("""WITH s AS (SELECT user_id, event_id, CASE WHEN starts_with(event_type, 'p') THEN 'Added' WHEN starts_with(event_type, 'c') THEN 'Fixed' ELSE 'Changed' END AS section, event_type FROM events)
SELECT section, count(*) AS entries, min(event_id) AS first_id, sha256(string_agg('- ' || event_type || ' ' || event_id, chr(10) ORDER BY event_id)) AS digest FROM s GROUP BY section""")
def changelog_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spandrel.operators.generate import changelog_section

    rows = table(spark, sf_dir, "events").select("event_id", "event_type", changelog_section(F.col("event_type"), "p", "c").alias("section"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda r: F.concat(F.lit("- "), r["event_type"], F.lit(" "), r["event_id"].cast("string"))), "\n")
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("entries"), F.min("event_id").alias("first_id"), F.sha2(lines, 256).alias("digest"))


@twin("""WITH n AS (SELECT n_name, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
r AS (SELECT n_name, c, row_number() OVER (ORDER BY c DESC, n_name) AS k FROM n)
SELECT string_agg('  ' || n_name || ': ' || c || CASE WHEN c = 1 THEN ' change' ELSE ' changes' END, chr(10) ORDER BY c DESC, n_name) AS report FROM r WHERE k <= 10""")
def top_sections_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text report of the ten largest groups."""
    groups = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("c"))
    top = groups.orderBy(F.desc("c"), "n_name").limit(10)
    line = lambda r: F.concat(F.lit("  "), r["n_name"], F.lit(": "), r["c"].cast("string"), F.lit(" "), text.plural(r["c"], "change", "changes"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("order"), "n_name", "c")))
    return top.agg(F.array_join(F.transform(rows, line), "\n").alias("report"))


# --- streams, refresh, sets, JSON, splices ---------------------------------------------------------------------------


@twin("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 5 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS calls FROM s GROUP BY user_id, n""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events of each user with no pause of more than five minutes: one trailing call each."""
    from spandrel.streaming.watch import bursts

    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return bursts(events, "ts", "5 minutes", ["user_id"]).select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), F.col("events").alias("calls"))


@twin("""WITH held AS (SELECT doc_id AS path, n_chars AS version FROM documents WHERE doc_id % 3 <> 0), now AS (SELECT doc_id AS path, n_chars + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS version FROM documents)
SELECT path, version FROM now n WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.path = n.path AND h.version = n.version)""")
def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the parse table lacks or holds in another version."""
    from spandrel.streaming.watch import to_refresh

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "n_chars")
    held = docs.where("path % 3 <> 0").select("path", F.col("n_chars").alias("version"))
    now = docs.select("path", (F.col("n_chars") + F.when(F.col("path") % 10 == 0, 1).otherwise(0)).alias("version"))
    return to_refresh(now, held, ["path", "version"])


@twin("""SELECT o_orderkey AS k, to_json({'customer': o_custkey, 'id': o_orderkey, 'priority': o_orderpriority, 'status': o_orderstatus}) AS json,
sha256(to_json({'customer': o_custkey, 'id': o_orderkey, 'priority': o_orderpriority, 'status': o_orderstatus})) AS digest FROM orders""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.canonical_json(status=F.col("o_orderstatus"), id=F.col("o_orderkey"), customer=F.col("o_custkey"), priority=F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), out.alias("json"), F.sha2(out, 256).alias("digest"))


@twin("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
a AS (SELECT doc_id, n, 1 AS o, line FROM l UNION ALL SELECT doc_id, n, 0, '/* ' || n || ' */' FROM l WHERE n % 3 = 0)
SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY n, o)) AS digest FROM a GROUP BY doc_id""")
def line_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments put before every third line of each text."""
    from spandrel.operators.annotate import splice

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n")))).alias("line")).where("line % 3 = 0")
    notes = lines.select("doc_id", "line", F.lit("n").alias("name"), F.concat(F.lit("/* "), F.col("line").cast("string"), F.lit(" */")).alias("comment"))
    return splice(docs, notes, "doc_id", indent=False).select("doc_id", F.sha2("text", 256).alias("digest"))
