"""Queries on what works over whole tables of any size: total orders, choice under a budget, canonical JSON, documents
in fragments, keyed parse state, networks, literals and nearest settings; each with SQL on the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import canonical, literals, secrets
from spandrel.operators import diff, generate, networks, order, pack, parse, projection, score, settings
from spandrel.plans import api, sourced, twins
from spandrel.plans.twins import table, twin
from spandrel.sources import shared
from spandrel.streaming import parse_cache

# --- order and choice ---------------------------------------------------------------------------------------------


@twin(f"{twins._CHANGES} SELECT id, category, row_number() OVER (ORDER BY {twins._WEIGHT}, kind, qualified_name, category, id) AS position FROM c")
def total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each change among all."""
    return diff.ranked(twins._changes(spark, sf_dir)).select("id", "category", "position")


_BY = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


@twin(f"""SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT) OVER (ORDER BY {_BY} ROWS UNBOUNDED PRECEDING)::BIGINT AS quantity_so_far,
sum(l_quantity::BIGINT) OVER (PARTITION BY l_returnflag ORDER BY {_BY} ROWS UNBOUNDED PRECEDING)::BIGINT AS of_its_flag FROM lineitem""")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities added up in the order of shipping, in all and within the few flags, which are hot keys."""
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint")).select(*_BY.split(", "), "l_returnflag", "q")
    by = _BY.split(", ")
    out = order.running(rows, by, {"quantity_so_far": "q"})
    out = order.running(out, by, {"of_its_flag": "q"}, within=["l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", F.col("quantity_so_far").cast("bigint"), F.col("of_its_flag").cast("bigint"))


@twin("""WITH RECURSIVE o AS (SELECT o_orderkey AS id, 60 + floor(o_totalprice)::BIGINT % 5000 AS whole, 30 + o_custkey % 900 AS short, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders),
f AS (SELECT 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS id, NULL::VARCHAR AS form
  UNION ALL SELECT min(o.n), f.used + arg_min(CASE WHEN f.used + whole <= 100000 THEN whole ELSE short END, o.n), arg_min(o.id, o.n), arg_min(CASE WHEN f.used + whole <= 100000 THEN 'full' ELSE 'compact' END, o.n)
  FROM f JOIN o ON o.n > f.n AND f.used + least(whole, short) <= 100000 GROUP BY f.n, f.used)
SELECT id AS orderkey, form FROM f WHERE form IS NOT NULL""")
def budget_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one group, first fit, in full or compact."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.floor(F.col("o_orderkey") * 0).cast("int").alias("group"), (60 + F.floor("o_totalprice") % 5000).alias("full"), (30 + F.col("o_custkey") % 900).alias("compact"))
    return pack.pack_groups(orders, "group", "o_orderkey", "full", "compact", 100_000).select(F.col("order").alias("orderkey"), "form")


# --- canonical JSON -----------------------------------------------------------------------------------------------

_LINE = "l_linenumber, l_partkey, l_suppkey, l_returnflag, l_discount"
_LINES = f"""l AS (SELECT l_orderkey AS k, list({{'part': l_partkey, 'returned': l_returnflag = 'R', 'supplier': l_suppkey}} ORDER BY {_LINE}) AS ls, list(l_discount ORDER BY {_LINE}) AS ds FROM lineitem GROUP BY 1)"""


@twin(f"""WITH {_LINES}, j AS (SELECT o_orderkey AS k, to_json({{'customer': {{'key': o_custkey, 'note': CASE WHEN o_orderstatus = 'F' THEN 'a "final" \\ state' END}}, 'discounts': ds, 'lines': ls, 'status': o_orderstatus, 'total': o_totalprice}})::VARCHAR AS json
FROM orders JOIN l ON k = o_orderkey)
SELECT k, sha256(replace(json, ',"note":null', '')) AS digest FROM j""")
def canonical_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as nested canonical JSON; the columns stand in no order, and null fields go."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_LINE.split(", ")))).alias("x"))  # of one order
    note = F.when(F.col("o_orderstatus") == "F", 'a "final" \\ state')
    held = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = held.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"), F.transform("x", lambda v: F.struct(v["l_suppkey"].alias("supplier"), (v["l_returnflag"] == "R").alias("returned"), v["l_partkey"].alias("part"))).alias("lines"), F.transform("x", lambda v: v["l_discount"]).alias("discounts"), F.struct(note.alias("note"), F.col("o_custkey").alias("key")).alias("customer"))
    return rows.select("k", F.sha2(canonical.rows(rows, "total", "status", "lines", "discounts", "customer"), 256).alias("digest"))


# --- documents in fragments ---------------------------------------------------------------------------------------

_PIECES = f"""{sourced._COVERAGE}, n AS (SELECT path, split_part(path, '/', -1) AS file, regexp_replace(split_part(path, '/', -1), '[.][^.]+$', '') AS node, row_number() OVER (ORDER BY path) - 1 AS i FROM f),
own AS (SELECT path, string_agg(CASE WHEN cls THEN '### Class: `C' || k || '`' || chr(10) || chr(10) || coalesce(doc, 'No description available.') || chr(10)
  ELSE '### `f' || k || '(qty, rate)`' || chr(10) || chr(10) || coalesce(doc, 'No description available.') || chr(10) || chr(10) || '**Returns:** `' || CASE WHEN py THEN 'float' ELSE 'number' END || '`' || chr(10) END, chr(10) ORDER BY cls, k) AS body FROM s GROUP BY path),
t AS (SELECT 'diagram' AS kind, 0 AS part, '' AS path, 0 AS place, 'graph TD' AS text
  UNION ALL SELECT 'diagram', 1, path, 0, '    N' || i || '["' || node || '"]' FROM n UNION ALL SELECT 'diagram', 2, path, 0, '    N0 --> N' || i FROM n WHERE i > 0
  UNION ALL SELECT 'api', 0, '', 0, '# API Documentation' || chr(10) UNION ALL SELECT 'api', 1, n.path, 0, CASE WHEN i > 0 THEN '---' || chr(10) || chr(10) ELSE '' END || '## ' || file || chr(10) || chr(10) || body FROM n JOIN own USING (path)
  UNION ALL SELECT 'readme', 0, '', 0, '# shop' || chr(10) || chr(10) || '> A project' || chr(10) || chr(10) || '## API' || chr(10)
  UNION ALL SELECT 'readme', 1, '', 0, '### Functions' || chr(10) UNION ALL SELECT 'readme', 3, '', 0, '' UNION ALL SELECT 'readme', 4, '', 0, '### Classes' || chr(10) UNION ALL SELECT 'readme', 6, '', 0, ''
  UNION ALL SELECT 'readme', CASE WHEN cls THEN 5 ELSE 2 END, path, k, CASE WHEN cls THEN '- `C' || k || '` — ' ELSE '- `f' || k || '()` — ' END || coalesce(doc, 'No description') FROM s
  UNION ALL SELECT 'score', is_total = false, coalesce(file, ''), 0, CASE WHEN is_total THEN '# Documentation score: ' || coverage || '/100 (' || band || ')' || chr(10) || chr(10) || '| Module | Coverage | Documented |' || chr(10) || '| --- | --- | --- |'
    ELSE '| ' || file || ' | ' || coverage || '% | ' || documented || '/' || total || ' |' END FROM b
  UNION ALL SELECT 'changelog', 0, '', 0, '## [2.0.0] - 2026-01-02' UNION ALL SELECT 'changelog', 2 * r + 1, '', 0, chr(10) || '### ' || ['Added', 'Fixed', 'Changed'][r + 1] FROM range(3) g(r)
  UNION ALL SELECT 'changelog', CASE WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 3 = 1 THEN 4 ELSE 6 END, printf('%020d', p_partkey), 0, '- ' || ['feat', 'fix', 'docs'][p_partkey % 3 + 1] || ': ' || p_name FROM part)"""


@twin(f"""WITH {_PIECES} SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY part, path, place, text) AS position, sha256(text) AS digest FROM t""")
def document_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """README, API documentation, diagram, score and changelog in their fragments; no row holds a document."""
    modules = shared.written(sourced._modules(spark, sf_dir), "modules")  # parsed once for all branches
    k = F.col("p_partkey")
    message = F.concat(F.when(k % 3 == 0, "feat").when(k % 3 == 1, "fix").otherwise("docs"), F.lit(": "), "p_name")
    commits = table(spark, sf_dir, "part").select(k.alias("position"), message.alias("message"))
    made = {
        "readme": generate.readme_fragments(modules, "shop"), "api": generate.api_fragments(modules), "diagram": generate.diagram_fragments(modules),
        "score": score.report_fragments(score.score_modules(modules), "markdown"), "changelog": generate.changelog_fragments(commits, "2.0.0", "2026-01-02"),
    }
    rows = [generate.placed(df).select(F.lit(kind).alias("kind"), "position", F.sha2("text", 256).alias("digest")) for kind, df in made.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


# --- members of all kinds -----------------------------------------------------------------------------------------

_MEMBERS = """p AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS py, 'lib/' || lower(replace(p_brand, '#', '_')) || '/m' || p_size % 4 || CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.ts' END AS path FROM part),
c AS (SELECT path, 'method' AS kind, 'P' || k || '.v' AS name, 'contract-changed' AS category, 'parameters' AS facets FROM p WHERE py AND k % 7 = 1
  UNION ALL SELECT path, 'method', 'P' || k || '.s', 'implementation-changed', '' FROM p WHERE py AND k % 11 = 2
  UNION ALL SELECT path, 'class', 'P' || k, CASE WHEN k % 7 = 1 THEN 'contract-changed' ELSE 'implementation-changed' END, CASE WHEN k % 7 = 1 THEN 'members' ELSE '' END FROM p WHERE py AND (k % 7 = 1 OR k % 11 = 2)
  UNION ALL SELECT path, 'function', 'f' || k, 'contract-changed', 'return' FROM p WHERE py AND k % 13 = 3
  UNION ALL SELECT path, 'method', 'I' || k || '.get', 'contract-changed', 'parameters' FROM p WHERE NOT py AND k % 7 = 1
  UNION ALL SELECT path, 'interface', 'I' || k, 'contract-changed', 'members' FROM p WHERE NOT py AND (k % 7 = 1 OR k % 17 = 5)
  UNION ALL SELECT path, 'type', 'A' || k, 'contract-changed', 'members' FROM p WHERE NOT py AND k % 11 = 2
  UNION ALL SELECT path, 'enum', 'E' || k, 'contract-changed', 'members' FROM p WHERE NOT py AND k % 13 = 3
  UNION ALL SELECT path, 'method', 'C' || k || '.[computed]', 'contract-changed', 'return' FROM p WHERE NOT py AND k % 19 = 4
  UNION ALL SELECT path, 'class', 'C' || k, 'contract-changed', 'members' FROM p WHERE NOT py AND k % 19 = 4)"""

_PYTHON = """class P{k}:
    @property
    def v(self) -> int:
        return self._v
    @v.setter
    def v(self, x: {value}) -> None:
        self._v = x
    @staticmethod
    def s(a: int) -> int:
        return a {sign} 1
    def r({receiver}, a: int) -> int:
        return a
    def w(self):
        return {lost}
    def w(self, b: int):
        return 2
@overload
def f{k}(a: int) -> int: ...
@overload
def f{k}(a: str) -> {result}: ...
def f{k}(a):
    return a
"""
_SCRIPT = """export interface I{k} {{ a: string; get(n: {value}): string }}
export interface I{k} {{ b?: {merged} }}
export type A{k} = {{ x: {sign} }} | null;
export enum E{k} {{ One = {result}, Two }}
export class C{k} {{ ["run" + 1](n: number): {computed} {{ return undefined as never }} }}
"""


def _member_files(spark: SparkSession, sf_dir: str, after: bool) -> DataFrame:
    """Files of both languages with a property, a static, a rebound and an overloaded function, or a merged interface,
    an alias, an enum and a computed method for each part; what is changed later goes by the key."""
    k = F.col("k")
    turned = lambda when, new, old: F.when(when & F.lit(after), new).otherwise(old)

    def filled(template: str, **fields) -> Column:
        pieces = template.replace("{{", "\0").replace("}}", "\1")
        out = []
        for i, piece in enumerate(pieces.replace("}", "{").split("{")):
            out.append(fields[piece] if i % 2 else F.lit(piece.replace("\0", "{").replace("\1", "}")))
        return F.concat(*out)

    own = k.cast("string")
    python = filled(_PYTHON, k=own, value=turned(k % 7 == 1, "str", "int"), sign=turned(k % 11 == 2, "-", "+"), receiver=turned(k % 5 == 0, "this", "self"), lost=turned(k % 3 == 0, "3", "1"), result=turned(k % 13 == 3, "bytes", "str"))
    script = filled(_SCRIPT, k=own, value=turned(k % 7 == 1, "bigint", "number"), merged=turned(k % 17 == 5, "boolean", "number"), sign=turned(k % 11 == 2, "string", "number"), result=turned(k % 13 == 3, "10", "1"), computed=turned(k % 19 == 4, "string", "void"))
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("lib/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/m"), (F.col("p_size") % 4).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".py").otherwise(".ts")).alias("path"))
    # dealt out by file before they become text
    texts = parts.repartition(dealt, "path").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", F.when(k % 2 == 0, python).otherwise(script).alias("t")))).alias("xs"))  # of one file
    return texts.select("path", F.array_join(F.transform("xs", lambda x: x["t"]), "").alias("content"))


@twin(f"WITH {_MEMBERS} SELECT path, kind, name, category, facets FROM c")
def member_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of properties, overloads, merged interfaces, aliases, enums and computed methods; a receiver's name
    and a definition that is bound again change nothing."""
    parsed = lambda n: shared.written(parse.require_parsed(parse.parse_symbols(_member_files(spark, sf_dir, n == "after"))), n)
    sides = {n: parsed(n) for n in ("before", "after")}
    paths = {n: df.select(F.col("path").alias("file_id")).distinct().select("file_id", F.col("file_id").alias(f"{n}_path")) for n, df in sides.items()}
    found = api.compare_versions(paths["before"].join(paths["after"], "file_id").withColumn("status", F.lit("modified")), sides)
    name = F.regexp_replace("qualified_name", r"\[computed:[0-9a-f]+\]", "[computed]")
    return found.select("path", "kind", name.alias("name"), "category", F.coalesce(F.array_join("changed_facets", ","), F.lit("")).alias("facets"))


@twin(f"WITH {_MEMBERS} SELECT path, 'I' || k AS name, 'interface' AS kind, 'a:string' AS properties FROM p WHERE NOT py UNION ALL SELECT path, 'I' || k, 'interface', 'b?:number' FROM p WHERE NOT py UNION ALL SELECT path, 'A' || k, 'type', '' FROM p WHERE NOT py UNION ALL SELECT path, 'E' || k, 'enum', 'One:1,Two:' FROM p WHERE NOT py")
def parsed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces, aliases and enums of all files with their properties."""
    types = parse.require_parsed(parse.parse_modules(_member_files(spark, sf_dir, False))).select("path", F.explode("types").alias("t")).select("path", "t.name", "t.kind", "t.properties")
    one = lambda p: F.concat(p["name"], F.when(p["optional"], "?").otherwise(""), F.lit(":"), F.coalesce(p["type"], F.lit("")))
    return types.withColumn("properties", F.array_join(F.transform("properties", one), ","))


# --- what may leave -----------------------------------------------------------------------------------------------


@twin("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CASE o_orderkey % 10 WHEN 0 THEN '/abs/o.py' WHEN 1 THEN 'src/../../o.py' ELSE 'src/o.py' END AS path,
  CASE o_orderkey % 12 WHEN 5 THEN 'ghp_' || repeat('A1b2', 9) WHEN 6 THEN 'see /home/me/x' ELSE 'f' || o_orderkey END AS name, o_orderkey % 4 = 0 AS undigested, CASE WHEN o_orderkey % 9 = 8 THEN 'macro' ELSE 'function' END AS kind FROM orders),
p AS (SELECT k, starts_with(path, 'src/o') AND starts_with(name, 'f') AS whole, NOT undigested AS short FROM o WHERE kind <> 'macro'),
d AS (SELECT l_orderkey AS k, count(DISTINCT l_partkey % 3) AS n FROM lineitem GROUP BY 1)
SELECT k, whole AS has_full, short AS has_compact, coalesce(n, 0) AS docs FROM p LEFT JOIN d USING (k) WHERE whole OR short""")
def projected_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes made from orders, some with unsafe identities, bad digests or unknown kinds: which forms may leave, and how
    many mappings go with each."""
    k = F.col("o_orderkey")
    path = F.when(k % 10 == 0, "/abs/o.py").when(k % 10 == 1, "src/../../o.py").otherwise("src/o.py")
    name = F.when(k % 12 == 5, F.concat(F.lit("ghp_"), F.repeat(F.lit("A1b2"), F.lit(9)))).when(k % 12 == 6, "see /home/me/x").otherwise(F.concat(F.lit("f"), k.cast("string")))
    changes = table(spark, sf_dir, "orders").select(k.alias("k"), k.cast("string").alias("id"), path.alias("path"), name.alias("qualified_name"), F.when(k % 4 == 0, "none").otherwise(F.sha2(k.cast("string"), 256)).alias("digest"), F.when(k % 9 == 8, "macro").otherwise("function").alias("kind"), F.lit("added").alias("category"), F.lit("informational").alias("risk"))
    mapped = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("change_id"), (F.col("l_partkey") % 3).alias("section")).distinct()
    out = projection.with_documentation(projection.candidates(changes), mapped)
    return out.select("k", F.col("full").isNotNull().alias("has_full"), F.col("compact").isNotNull().alias("has_compact"), F.size("docs").cast("bigint").alias("docs"))


@twin("""SELECT o_orderkey AS k, sha256('at ' || CASE o_orderkey % 3 WHEN 0 THEN '<REDACTED:SENSITIVE_PATH:1>/x' WHEN 1 THEN '<REDACTED:SENSITIVE_PATH:2> and <REDACTED:SENSITIVE_PATH:1>' ELSE '/srv/other' END || ', token: ' || 'ghp_' || repeat('A1b2', 9)) AS digest, 'warned' AS action FROM orders""")
def protected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two places that no policy lets out, and a token that the policy only warns of."""
    k = F.col("o_orderkey")
    where = F.when(k % 3 == 0, "/srv/clone/x").when(k % 3 == 1, "/srv/clone/deep and /srv/clone").otherwise("/srv/other")
    dealt = table(spark, sf_dir, "orders").select("o_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")  # a search costs more than a key's bytes say
    rows = dealt.select(k.alias("k"), F.concat(F.lit("at "), where, F.lit(", token: "), F.lit("ghp_"), F.repeat(F.lit("A1b2"), F.lit(9))).alias("t"))
    out = secrets.apply_policy(secrets.protect_paths(rows, "t", ("/srv/clone", "/srv/clone/deep")), "t", "warn")
    return out.select("k", F.sha2("t", 256).alias("digest"), "action")


# --- state, networks, literals, settings --------------------------------------------------------------------------


@twin("""WITH v AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderstatus AS version, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS held FROM orders)
SELECT 'src/c' || k || '.py' AS path, count(*) FILTER (version = held) AS hits, count(*) FILTER (version IS DISTINCT FROM held) AS misses, string_agg(DISTINCT 'f_' || lower(version), ',' ORDER BY 'f_' || lower(version)) AS functions FROM v GROUP BY k""")
def parse_cache_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as saves of their customer's file, whose version is the status: parsed when it is another than the last."""
    orders = table(spark, sf_dir, "orders")
    saves = orders.select(F.concat(F.lit("src/c"), F.col("o_custkey").cast("string"), F.lit(".py")).alias("path"), F.lit("changed").alias("event"), F.col("o_orderstatus").alias("version"), F.col("o_orderkey").alias("order"), F.concat(F.lit("def f_"), F.lower("o_orderstatus"), F.lit("():\n    pass\n")).alias("content"))
    found = parse_cache.outcomes(saves, shards=256, capacity=256 * 100_000)
    names = F.from_json("module", "functions array<struct<name:string>>")["functions"]
    rows = found.select("path", "outcome", F.transform(names, lambda f: f["name"]).alias("names"))
    n = lambda o: F.count_if(F.col("outcome") == o)
    return rows.groupBy("path").agg(n("hit").alias("hits"), n("miss").alias("misses"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), ",").alias("functions"))  # of one file


_NETWORKS = """n AS (SELECT p_partkey AS k, (p_partkey * 7919) % 200 AS a, (p_partkey * 104729) % 256 AS b, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 256 WHEN 2 THEN 65536 ELSE 77 END AS size FROM part),
r AS (SELECT k, a * 16777216 + b * 65536 + CASE WHEN size = 65536 THEN 0 ELSE (k % 250) * 256 END AS low, low + size - 1 AS high, 'net' || k AS label FROM n),
q AS (SELECT event_id, user_id, ((user_id * 7919) % 200) * 16777216 + ((user_id * 104729) % 256) * 65536 + (event_id % 250) * 256 + event_id % 100 AS v FROM events)"""


@twin(f"""WITH {_NETWORKS} SELECT event_id, arg_min(label, (high - low, label)) FILTER (label IS NOT NULL) AS label FROM q LEFT JOIN r ON v BETWEEN low AND high GROUP BY event_id""")
def event_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest range of each event's address; half of the addresses and ranges are written as IPv6."""
    p, size = F.col("p_partkey"), F.when(F.col("p_partkey") % 4 == 0, 1).when(F.col("p_partkey") % 4 == 1, 256).when(F.col("p_partkey") % 4 == 2, 65536).otherwise(77)
    low = ((p * 7919) % 200) * 16777216 + ((p * 104729) % 256) * 65536 + F.when(size == 65536, 0).otherwise((p % 250) * 256)
    byte = lambda v, k: F.pmod(F.shiftright(v, 8 * k), F.lit(256)).cast("string")
    dotted = lambda v: F.concat_ws(".", *(byte(v, k) for k in (3, 2, 1, 0)))
    written = lambda v, odd: F.when(odd, F.concat(F.lit("::ffff:"), dotted(v))).otherwise(dotted(v))
    rows = table(spark, sf_dir, "part").select(p.alias("k"), low.cast("bigint").alias("low"), (low + size - 1).cast("bigint").alias("high"))
    ranges = rows.select(written(F.col("low"), F.col("k") % 2 == 1).alias("low"), written(F.col("high"), F.col("k") % 2 == 1).alias("high"), F.concat(F.lit("net"), F.col("k").cast("string")).alias("label"))
    u, e = F.col("user_id"), F.col("event_id")
    v = ((u * 7919) % 200) * 16777216 + ((u * 104729) % 256) * 65536 + (e % 250) * 256 + e % 100
    events = table(spark, sf_dir, "events").select("event_id", v.cast("bigint").alias("v"))
    asked = events.select("event_id", written(F.col("v"), F.col("event_id") % 2 == 0).alias("address"))
    return networks.locate(asked, ranges).select("event_id", "label")


@twin("""WITH w AS (SELECT DISTINCT substr(text, (20 * i + 1)::BIGINT, 9) AS literal FROM documents, range(10) g(i) WHERE doc_id % 2 = 0 AND length(text) >= 20 * i + 9)
SELECT doc_id, count(*) AS n_literals, sum((length(text) - length(replace(text, literal, ''))) // 9)::BIGINT AS n FROM documents JOIN w ON contains(text, literal) GROUP BY doc_id""")
def literals_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often literals, ten pieces of each second document, stand in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = docs.where("doc_id % 2 = 0").select("text", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).where(F.char_length("text") >= 20 * F.col("i") + 9)
    words = pieces.select(F.substr("text", 20 * F.col("i") + 1, F.lit(9)).alias("literal"))
    return literals.counts(docs, words, "doc_id", "text").groupBy("doc_id").agg(F.sum("n_literals").alias("n_literals"), F.sum("n").alias("n"))


_TREE = """f AS (SELECT DISTINCT o_orderkey % 3 || '/' || o_orderkey % 7 || '/' || o_orderkey % 11 || '/' || o_orderkey % 13 AS folder, o_orderkey AS k FROM orders),
c AS (SELECT DISTINCT array_to_string(list_slice(string_split(folder, '/'), 1, (k % 4)::BIGINT), '/') AS folder, max(k) OVER (PARTITION BY array_to_string(list_slice(string_split(folder, '/'), 1, (k % 4)::BIGINT), '/')) AS v FROM f WHERE k % 17 = 0),
a AS (SELECT folder AS own, d, array_to_string(list_slice(string_split(folder, '/'), 1, d), '/') AS folder FROM (SELECT DISTINCT folder FROM f), range(5) g(d))"""


@twin(f"""WITH {_TREE} SELECT own || '/m.py' AS path, arg_max(c.folder, d) AS folder, CASE WHEN arg_max(v, d) % 5 = 0 THEN NULL ELSE '{{"budget":' || arg_max(v, d) || '}}' END AS settings, coalesce(arg_max(v, d) % 5 = 0, false) AS unsafe
FROM a LEFT JOIN c USING (folder) WHERE v IS NOT NULL GROUP BY own
UNION ALL SELECT folder || '/m.py', NULL, NULL, false FROM (SELECT DISTINCT folder FROM f) WHERE folder NOT IN (SELECT own FROM a JOIN c USING (folder))""")
def nearest_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders made from orders, some with settings, of which every fifth holds a credential: what each file gets."""
    k = F.col("o_orderkey")
    folders = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat_ws("/", *((k % n).cast("string") for n in (3, 7, 11, 13))).alias("folder"))
    holder = F.array_join(F.slice(F.split("folder", "/"), F.lit(1), (F.col("k") % 4).cast("int")), "/")
    held = folders.where("k % 17 = 0").select(holder.alias("folder"), "k").groupBy("folder").agg(F.max("k").alias("v"))
    value = F.concat(F.lit('{"budget":'), F.col("v").cast("string"), F.when(F.col("v") % 5 == 0, ',"apiKey":"x"}').otherwise("}"))
    files = held.select(F.concat(F.when(F.col("folder") == "", "").otherwise(F.concat("folder", F.lit("/"))), F.lit("spandrel.json")).alias("path"), value.alias("content"))
    asked = folders.select(F.concat("folder", F.lit("/m.py")).alias("path")).distinct()
    out = settings.nearest(asked, settings.folder_settings(files))
    return out.select("path", "folder", "settings", F.coalesce("unsafe", F.lit(False)).alias("unsafe"))


QUERIES, SQL = twins.QUERIES, twins.SQL
