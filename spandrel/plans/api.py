"""What users call: plan, prepare, update, check, score and the generators, from folders, revisions or tables."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import logging
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spandrel.functions import canonical, paths, secrets, text
from spandrel.operators import diff, freshness, gateway, generate, mapping, order, pack, parse, projection, reports, score, sections
from spandrel.sources import documents, files, git, lines, shared


@dataclass(frozen=True)
class Config:
    """Settings; the environment and arguments override a file, a file overrides these defaults."""

    include: tuple[str, ...] = ("**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.py")
    exclude: tuple[str, ...] = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/*.test.*", "**/*.spec.*")
    output_dir: str = "docs"
    budget: int = pack.USUAL_BUDGET
    policy: str = "redact"

    @classmethod
    def load(cls, root: str, **overrides) -> Config:
        """spandrel.json in root, then SPANDREL_* of the environment, then overrides; a bad file is as none."""
        values: dict = {}
        try:
            with open(os.path.join(root, "spandrel.json"), encoding="utf-8") as f:
                read = json.load(f)
            values = {k: tuple(v) if isinstance(v, list) else v for k, v in read.items() if k in cls.__dataclass_fields__}
        except (OSError, ValueError, AttributeError):
            pass
        for name in ("output_dir", "policy"):
            if found := os.environ.get(f"SPANDREL_{name.upper()}"):
                values[name] = found
        config = cls(**{**values, **{k: v for k, v in overrides.items() if v is not None}})
        pack.check_budget(config.budget)
        if paths.normalize(config.output_dir) is None:
            raise ValueError("the output folder leaves the repository")
        for globs in (config.include, config.exclude):
            if error := paths.glob_list_error(list(globs)):
                raise ValueError(error)
        return config


class PlanError(Exception):
    """A plan that could not be made; code is one of a fixed list, the text holds nothing of the repository."""

    CODES = ("PLAN_INVALID_BUDGET", "PLAN_INVALID_REVISION", "PLAN_SHALLOW_HISTORY", "PLAN_PARSE_FAILED", "PLAN_FAILED")

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code if code in self.CODES else "PLAN_FAILED"


@dataclass
class Plan:
    """Tables of the plan, written to the shared folder, and what of them has a bound: summary, context and digest."""

    changes: DataFrame
    documentation: DataFrame
    summary: dict
    context: dict
    report: dict
    digest: str
    ignored: dict = field(default_factory=dict)

    def release(self) -> None:
        """Delete the tables of the plan."""
        shared.drop(self.changes, self.documentation)

    def head(self) -> dict:
        return {"summary": self.summary, "context": self.report, "digest": self.digest, "ignored": self.ignored}

    def save(self, path: str, overwrite: bool = False) -> None:
        """Changes, in their order, and documentation, by change, as ordered canonical JSON lines in a folder, written by
        the executors; for plans of any size."""
        for name, df, by in (("changes", self.changes, diff.order_of()), ("documentation", self.documentation, ["change_id"])):
            lines.write(df.withColumn("line", canonical.rows(df)), "line", by, f"{path}/{name}", overwrite)

    def json_parts(self) -> Iterator[str]:
        """The whole plan as pieces of one canonical JSON text; the driver holds a partition of lines at a time."""

        def array(df: DataFrame) -> Iterator[str]:
            yield "["
            for k, row in enumerate(df.select(canonical.rows(df).alias("json")).toLocalIterator()):
                yield ("," if k else "") + row.json
            yield "]"

        head = pack.canonical(self.head())[1:-1]
        at = head.index('"digest":')
        cut = head.index(',"ignored":', at)
        yield '{"ok":true,"plan":{"changes":'
        yield from array(diff.ordered(self.changes))
        yield "," + head[:cut] + ',"documentation":'
        yield from array(self.documentation.orderBy("change_id"))
        yield head[cut:] + "}}"

    def to_json(self) -> str:
        """json_parts() in one; for large plans there is save()."""
        return "".join(self.json_parts())


def plan_tables(pairs: DataFrame, documentation_files: DataFrame, budget: int = pack.USUAL_BUDGET, strict: bool = True, ignored: dict | None = None) -> Plan:
    """The plan for file changes (FILE_CHANGE) and documentation files (path, content).

    Both versions are parsed in parallel; if one cannot be, the plan fails (strict) or the file is left out.
    The report's size does not grow with the changes, and only the records that may fit the budget come to the
    driver.
    """
    try:
        pack.check_budget(budget)
    except ValueError as error:
        raise PlanError("PLAN_INVALID_BUDGET", str(error)) from None
    sides: dict[str, DataFrame] = {}
    try:
        for side in ("before", "after"):
            source = pairs.where(F.col(f"{side}_path").isNotNull()).select(F.col(f"{side}_path").alias("path"), F.col(f"{side}_content").alias("content"))
            sides[side] = shared.written(parse.parse_snapshots(source), side)  # each version is parsed once
        if strict:
            bad = sides["before"].union(sides["after"]).where("error is not null").select("path").orderBy("path").first()
            if bad:
                raise PlanError("PLAN_PARSE_FAILED", f"a source file cannot be parsed: {bad.path}")
        changes = shared.written(compare_versions(pairs, {n: df.where("error is null") for n, df in sides.items()}), "changes")
    finally:
        shared.drop(*sides.values())
    found = shared.written(sections.sections(documentation_files), "sections")
    documentation = shared.written(mapping.safe_references(mapping.map_documentation(changes, found), _redact), "documentation")
    shared.drop(found)
    summary = projection.summary(diff.summarize(changes, documentation)).first().asDict()
    digest = diff.payload_digest(changes).first().digest
    context, report = pack.build_context(digest, summary, _records(changes, documentation, budget), budget, int(summary["total_changes"]))
    return Plan(changes, documentation, summary, context, report, digest, ignored or {})


def compare_versions(pairs: DataFrame, sides: dict[str, DataFrame]) -> DataFrame:
    """Changes of symbols and modules between two sides of parsed snapshots, each file in one row or in those of
    parse_symbols()."""
    keys = {side: pairs.select("file_id", F.col(f"{side}_path").alias("path")) for side in sides}
    rows = {side: keys[side].join(parse.symbols(df), "path").drop("path") for side, df in sides.items()}
    modules = {side: keys[side].join(df.where("dependency_fp is not null"), "path").select("file_id", F.col("language").alias(f"{side}_language"), F.col("dependency_fp").alias(f"{side}_dependency_fp")) for side, df in sides.items()}
    status = pairs.select("file_id", "status", "before_path", "after_path").join(modules["before"], "file_id", "left").join(modules["after"], "file_id", "left")
    status = status.withColumn("language", F.coalesce("after_language", "before_language"))
    return diff.compare_symbols(pairs, rows["before"], rows["after"]).unionByName(diff.compare_modules(status))


def _redact(value: str) -> str:
    return secrets.redact(value)[0]


def _records(changes: DataFrame, documentation: DataFrame, budget: int) -> list[dict]:
    """Changes in order of weight with full and compact forms: those that first fit may take, whatever their number.

    Forms are written, measured and checked by the executors; pack.contenders() bounds what comes here.
    """
    rows = projection.with_documentation(diff.ranked(projection.candidates(changes)), documentation)
    whole = F.octet_length("full") + F.aggregate("docs", F.lit(0), lambda n, d: n + F.octet_length(d))
    held = pack.contenders(rows, [], "position", F.least(whole, F.octet_length("compact")), budget).select("position", "full", "compact", "docs")
    load = lambda x: None if x is None else json.loads(x)
    return [{"full": load(r.full), "full_docs": [load(d) for d in r.docs] if r.full else [], "compact": load(r.compact), "compact_docs": []} for r in held.orderBy("position").collect()]


def is_safe_identity(value: str) -> bool:
    """No control characters, secrets, absolute paths or file URLs."""
    return not (re.search(r"[\x00-\x1f\x7f]|(?i:file://)|^(?:/|[A-Za-z]:[\\/])|\s[/\\](?:Users|home)[/\\]", value) or secrets.find(value, user_paths=True))


def plan(spark: SparkSession, root: str, base: str | None = None, head: str | None = "HEAD", config: Config | None = None) -> Plan:
    """The plan for two revisions of a repository; head None is the work tree."""
    config = config or Config.load(root)
    try:
        start = git.resolve(root, base) if base else git.discover_base(root, head or "HEAD")
        if start is None or (head and git.resolve(root, head) is None):
            raise PlanError("PLAN_INVALID_REVISION", "a revision cannot be resolved")
        pairs, ignored = git.snapshot_pairs(spark, root, start, head, list(config.include), list(config.exclude))
        pairs = pairs.cache()
    except git.ShallowHistory as error:
        raise PlanError("PLAN_SHALLOW_HISTORY", str(error)) from None
    except (RuntimeError, ValueError):
        raise PlanError("PLAN_INVALID_REVISION", "the revisions cannot be compared") from None
    docs = files.read_documentation(spark, root, config.output_dir, list(config.exclude))
    try:
        return plan_tables(pairs, docs, config.budget, ignored=ignored)
    finally:
        pairs.unpersist()


def targets(p: Plan, existing: DataFrame, explicit: list[str] | None = None) -> DataFrame:
    return mapping.resolve_targets(p.documentation, p.changes, existing, explicit)


def describe(p: Plan, existing: DataFrame) -> str:
    row = reports.plan_report(p.documentation, p.documentation.sparkSession.createDataFrame([p.summary]), targets(p, existing), p.report["usedBytes"], p.report["maxBytes"]).first()
    return row.report


def target_context(p: Plan, path: str, reasons: list[str], budget: int) -> tuple[dict, dict]:
    """The envelope of the changes that concern one target, and its report, within the budget."""
    documentation, changes = mapping.project(p.documentation, p.changes, path, reasons)
    return pack.build_context(p.digest, p.summary, _records(changes, documentation, budget), budget, changes.count())


def update_envelope(p: Plan, existing: str, path: str, reasons: list[str], budget: int) -> tuple[str, str, int]:
    """(system, prompt, changes named) for one target: its document, and of each change that the budget holds its
    category, risk, facets and the sections that it concerns."""
    context, report = target_context(p, path, reasons, budget)
    held = [c["id"] for c in context["changes"] if "id" in c]
    documentation, changes = mapping.project(p.documentation, p.changes, path, reasons)
    rows = mapping.template_changes(documentation, changes.where(F.col("id").isin(held)) if held else changes.limit(0)).collect()  # as many as the budget holds
    order = {k: i for i, k in enumerate(held)}
    named = sorted((r.asDict(True) for r in rows), key=lambda r: order[r["id"]])
    plan = {"changes": named, "omitted": report["totalRecords"] - len(named), "summary": p.summary}
    return *generate.envelope("update", existing=existing, plan=pack.canonical(plan)), report["includedRecords"]


def chosen(candidates: list, explicit: bool, every: bool, choose: Callable[[list], list[str]] | None) -> list:
    """Of several targets those that are named, all if asked for, or what choose() says of (path, reasons)."""
    if explicit and every:
        raise ValueError("one target and all targets exclude each other")
    rows = sorted(candidates, key=lambda r: r.path)
    if explicit or every or len(rows) <= 1:
        return rows
    if choose is None:
        raise ValueError("there are several targets: name one, or ask for all")
    picked = set(choose([(r.path, list(r.reasons)) for r in rows]))
    return [r for r in rows if r.path in picked]


def update(spark: SparkSession, root: str, base: str | None = None, head: str | None = "HEAD", target: str | None = None, model: Callable[[str], str] | None = None, write: bool = False, config: Config | None = None, strict: bool = False, on_event: Callable[[DataFrame], None] | None = None, every: bool = False, choose: Callable[[list], list[str]] | None = None) -> dict[str, str]:
    """New contents of the target documents by path; written in place if asked to.

    Of several targets one has to be named, or every one asked for, or choose() picks.

    model maps a prompt to a text; what it is given and what it says pass the gate, whose policy is never weaker than
    redaction here. Without a model the deterministic note is appended. Strict refuses blank or malformed Markdown
    before anything is written.
    """
    config = config or Config.load(root)
    p = plan(spark, root, base, head, config)
    try:
        out, held = _drafts(spark, root, p, target, model, config, on_event, every, choose)
    finally:
        p.release()
    for path, content in out.items():
        write_document(spark, root, path, content, held[path], strict=strict, dry_run=not write)
    return out


def _drafts(spark: SparkSession, root: str, p: Plan, target: str | None, model, config: Config, on_event, every: bool, choose) -> tuple[dict[str, str], dict[str, str]]:
    """New and present contents by path of the targets of update()."""
    if not mapping.has_impact(p.documentation, p.changes):
        return {}, {}
    docs = files.read_documentation(spark, root, config.output_dir)
    gate = gateway.Gate(secrets.privacy_floor(config.policy), on_event)
    out, held = {}, {}
    for row in chosen(targets(p, docs.select("path"), [target] if target else None).collect(), target is not None, every, choose):
        held[row.path] = existing = documents.read(root, row.path)[0] or ""
        if model:
            system, prompt, _ = update_envelope(p, existing, row.path, list(row.reasons), config.budget)
            asked = spark.createDataFrame([(row.path, system, prompt)], "key string, system string, prompt string")
            out[row.path] = gate.generate(asked, model).first().content
        else:
            _, report = target_context(p, row.path, list(row.reasons), config.budget)
            out[row.path] = generate.update_note(existing, report["includedRecords"], spark.range(1).select(F.current_date().cast("string")).first()[0])
    return out, held


def markdown_problems(spark: SparkSession, content: str) -> list[str]:
    return spark.createDataFrame([(content,)], "content string").select(text.markdown_warnings(F.col("content")).alias("w")).first().w


def write_document(spark: SparkSession, root: str, path: str, content: str, existing: str | None = None, strict: bool = False, dry_run: bool = False) -> dict:
    """Check a document, show its difference, and replace it unless dry_run: {warnings, diff, written}.

    Strict raises where the text is blank or has warnings; otherwise they are only told.
    """
    warnings = markdown_problems(spark, content) if content.strip() else ["the document is blank"]
    if strict and warnings:
        raise ValueError("the document is refused: " + "; ".join(warnings))
    difference = reports.unified_diff(path, existing or "", content)
    if not dry_run:
        replace_text(root, path, content, existing)
    return {"warnings": warnings, "diff": difference, "written": not dry_run}


def replace_text(root: str, path: str, content: str, expected: str | None = None) -> None:
    """Replace one document in a single step, if it is inside root, no link, and still what was read."""
    text, identity = documents.read(root, path)
    if expected is not None and text is not None and text != expected:
        raise ValueError("the target changed meanwhile")
    documents.replace(root, path, content, identity)


def check(spark: SparkSession, root: str, target: str, since: str, to: str = "HEAD", prove: bool = False, directory: str = "") -> tuple[dict, int]:
    """The freshness of a document and its exit code; unknown where the revisions cannot be compared.

    directory: only what changed below it counts. prove: parse each changed source as it is in the work tree; one that is gone or broken makes the answer unknown.
    """
    try:
        changed = git.changed_files(spark, root, since, to, directory=directory).select(F.explode(F.array_distinct(F.array("before_path", "after_path"))).alias("path")).where("path is not null")
        if prove:
            held = git.contents(changed.distinct(), root, None, "path", "content")
            freshness.parsed_sources(changed, held).collect()
        row = freshness.assess(changed, target, os.path.exists(os.path.join(root, target))).first().asDict()
    except (RuntimeError, ValueError, PySparkException):
        row = {"status": "unknown", "target": target, "target_changed": False, "source_files": [], "message": "the revisions cannot be compared"}
    return row, freshness.EXIT_CODES[row["status"]]


def output_problems(spark: SparkSession, kind: str, content: str, version: str = "") -> list[str]:
    """Warnings of the gate for a kind of document: a blank answer, a diagram that is none, a changelog of another version."""
    c = F.col("content")
    rules = {"changelog": text.changelog_warnings(c, F.lit(version)), "diagram": text.mermaid_warnings(c)}
    blank = F.when(text.is_blank(c), F.array(F.lit("Generated provider output is blank"))).otherwise(text.markdown_warnings(c))
    return spark.createDataFrame([(content,)], "content string").select(rules.get(kind, blank).alias("w")).first().w


def module_facts(modules: DataFrame, budget: int) -> str:
    """A line for each module, by path, as many whole lines as the budget of bytes holds, and how many it does not."""
    line = F.concat(F.lit("- "), "path", F.lit(": "), F.array_join(F.transform("functions", lambda f: f["signature"]), "; "))
    rows = modules.select("path", line.alias("line")).withColumn("size", F.octet_length("line") + 1)
    summed = order.running(rows, ["path", "line"], {"upto": "size"})
    held = [r.line for r in summed.where(F.col("upto") <= budget).orderBy("path", "line").collect()]
    lost = summed.where(F.col("upto") > budget).count()
    return "\n".join([*held, f"({lost} more modules)"] if lost else held)


def generate_document(spark: SparkSession, root: str, kind: str, model: Callable[[str], str] | None = None, name: str = "project", version: str = "", since: str = "", strict: bool = False, config: Config | None = None, deliver: Callable[[str], None] | None = None) -> str:
    """A readme, api document, diagram or changelog of a folder: from the model through the gate, or deterministic.

    With deliver the model gives its answer in pieces, and it is delivered once, whole and approved. Strict refuses an
    answer that has warnings; otherwise they are logged.
    """
    config = config or Config.load(root)
    if model is None:
        made = {"readme": lambda m: generate.readme_fragments(m, name), "api": generate.api_fragments, "diagram": generate.diagram_fragments}
        fragments = generate.changelog_fragments(git.commits(spark, root, since), version) if kind == "changelog" else made[kind](analyze_folder(spark, root, config))
        return "\n".join(r.text for r in generate.placed(fragments).orderBy("position").toLocalIterator())
    if kind == "changelog":
        rows = order.running(git.commits(spark, root, since).withColumn("size", F.octet_length("message") + 3), ["position"], {"upto": "size"})
        fields = {"version": version, "commits": "\n".join(f"- {r.message}" for r in rows.where(F.col("upto") <= config.budget).orderBy("position").collect())}
    else:
        fields = {"modules": module_facts(analyze_folder(spark, root, config), config.budget)}
        if kind == "readme":
            info = files.project_info(files.read_sources(spark, root, ["package.json"])).first()
            fields |= {"name": name, "description": info.description if info else "", "dependencies": ", ".join(info.dependencies) if info else ""}
    system, prompt = generate.envelope(kind, **fields)
    gate = gateway.Gate(secrets.privacy_floor(config.policy))
    pieces: list[str] = []
    answer = gate.stream(system, prompt, model if deliver else lambda p: [model(p)], pieces.append)
    if kind == "diagram":
        answer = spark.createDataFrame([(answer,)], "c string").select(text.strip_fence(F.col("c"))).first()[0]
    warnings = output_problems(spark, kind, answer, version)
    if warnings and strict:
        raise ValueError("the answer is refused: " + "; ".join(warnings))
    for w in warnings:
        logging.getLogger("spandrel").warning("%s: %s", kind, w)
    if deliver:
        deliver(answer)
    return answer


def generate_comments(spark: SparkSession, root: str, model: Callable[[str], str] | None = None, config: Config | None = None) -> DataFrame:
    """path, ordinal, name and comment of each function without one; a model is asked on the executors, row by row."""
    lost = parse.undocumented_functions(analyze_folder(spark, root, config))
    plain = generate.jsdoc(lost)
    if model is None:
        return plain
    at = F.element_at("line_range", 1)
    asked = lost.select(F.to_json(F.struct("path", at.alias("ordinal"), "name")).alias("key"), F.lit(generate.SYSTEM).alias("system"), F.replace(F.lit(generate.PROMPTS["jsdoc"]), F.lit("{signature}"), F.col("signature")).alias("prompt"))
    out = gateway.Gate(secrets.privacy_floor((config or Config.load(root)).policy)).generate(asked, model)
    return out.select(F.from_json("key", "path string, ordinal int, name string").alias("k"), "content").select("k.*", F.col("content").alias("jsdoc"))


def regenerate_readme(spark: SparkSession, root: str, target: str = "README.md", name: str = "project", config: Config | None = None) -> str:
    """Write the deterministic README of a folder's sources."""
    content = generate.readme(analyze_folder(spark, root, config), name).first().content
    full = os.path.join(root, target)
    existing = None
    if os.path.exists(full):
        with open(full, encoding="utf-8", errors="replace") as f:
            existing = f.read()
    write_document(spark, root, target, content, existing)
    return content


def score_folder(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    config = config or Config.load(root)
    return score.score_modules(parse.analyze(files.read_sources(spark, root, list(config.include), list(config.exclude))))


def analyze_folder(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    config = config or Config.load(root)
    return parse.analyze(files.read_sources(spark, root, list(config.include), list(config.exclude)))


class Tokens:
    """Signed claims: v1.<claims>.<HMAC-SHA256>, both in base64url; at most 4096 characters."""

    def __init__(self, key: bytes):
        self.key = key

    def _sign(self, body: str) -> str:
        return base64.urlsafe_b64encode(hmac.new(self.key, body.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()

    def issue(self, claims: dict) -> str:
        body = "v1." + base64.urlsafe_b64encode(pack.canonical(claims).encode()).rstrip(b"=").decode()
        token = f"{body}.{self._sign(body)}"
        if len(token) > 4096:
            raise ValueError("the claims are too large")
        return token

    def verify(self, token: str) -> dict:
        body, _, signature = token.rpartition(".")
        if len(token) > 4096 or not body.startswith("v1.") or not hmac.compare_digest(signature.encode(), self._sign(body).encode()):
            raise ValueError("the token is not valid")
        text = base64.urlsafe_b64decode(body[3:] + "=" * (-len(body[3:]) % 4)).decode()
        claims = json.loads(text)
        if pack.canonical(claims) != text:
            raise ValueError("the token is not canonical")
        return claims


def prepare(spark: SparkSession, root: str, tokens: Tokens, base: str | None = None, head: str | None = "HEAD", target: str | None = None) -> dict:
    """The prompt for exactly one target, what was found in it, and a token that validate() checks a draft against.

    The prompt has passed the gate, whose policy is never weaker than redaction here.
    """
    config = Config.load(root)
    p = plan(spark, root, base, head, config)
    try:
        docs = files.read_documentation(spark, root, config.output_dir)
        rows = targets(p, docs.select("path"), [target] if target else None).collect()
        if len(rows) != 1:
            raise PlanError("PLAN_FAILED", "exactly one target is needed")
        existing, _ = documents.read(root, rows[0].path)
        existing = existing or ""
        prompt, found = inspected(update_envelope(p, existing, rows[0].path, list(rows[0].reasons), config.budget)[1], config.policy)
    finally:
        p.release()
    claims = {"base": base, "head": head, "target": rows[0].path, "digest": p.digest, "document": hashlib.sha256(existing.encode()).hexdigest()}
    return {"target": rows[0].path, "prompt": prompt, "findings": found, "token": tokens.issue(claims)}


def inspected(value: str, policy: str) -> tuple[str, dict]:
    """A text after the policy, which is redaction at least, and what was found: {action, kinds}."""
    new, kinds = secrets.redact(value)
    if kinds and secrets.privacy_floor(policy) == "strict":
        raise ValueError("a secret was found")
    return new, {"action": "redacted" if kinds else "allowed", "kinds": dict(sorted(kinds.items()))}


def validate(spark: SparkSession, root: str, tokens: Tokens, token: str, draft: str) -> dict:
    """Whether a draft still fits: the plan and the document are made anew and must be as the token says."""
    claims = tokens.verify(token)
    config = Config.load(root)
    p = plan(spark, root, claims.get("base"), claims.get("head"), config)
    p.release()
    document = hashlib.sha256((documents.read(root, claims["target"])[0] or "").encode()).hexdigest()
    if p.digest != claims["digest"] or document != claims["document"]:
        raise ValueError("the repository changed since the draft was prepared")
    _, found = inspected(draft, config.policy)
    return {"target": claims["target"], "warnings": markdown_problems(spark, draft), "findings": sorted(found["kinds"]), "action": found["action"]}
