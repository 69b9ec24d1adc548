"""Source files to parsed modules and symbol snapshots, in parallel over files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spandrel.functions import paths
from spandrel.operators import python_source, typescript_source
from spandrel.schemas import MODULE, SNAPSHOT

#: Rows leave a task when their sources come to so many characters, where they are sent as pandas rows.
BATCH_CHARS = 1 << 20

_MODULE: dict[str, Callable[[str], dict]] = {"python": python_source.module, "typescript": typescript_source.module}
#: The same, piece by piece, for languages whose files are read so.
_PIECES: dict[str, Callable[[str], Iterator[dict]]] = {"python": python_source.module_pieces, "typescript": typescript_source.module_pieces}
_SNAPSHOT: dict[str, Callable[[str], tuple[str, list[dict]]]] = {"python": python_source.snapshot, "typescript": typescript_source.snapshot}
#: The same, piece by piece, as (symbols, imports).
_SNAPSHOT_PIECES: dict[str, Callable[[str], Iterator[tuple[list[dict], list[str]]]]] = {"python": python_source.snapshot_pieces, "typescript": typescript_source.snapshot_pieces}


def register_parser(language: str, suffixes: tuple[str, ...], module: Callable[[str], dict], snapshot: Callable | None = None) -> None:
    """Add a language: module(source) gives functions, classes, types and imports; snapshot is optional."""
    paths.LANGUAGES.update(dict.fromkeys(suffixes, language))
    _MODULE[language] = module
    _PIECES[language] = lambda source: iter([module(source)])
    if snapshot:
        _SNAPSHOT[language] = snapshot
        _SNAPSHOT_PIECES.pop(language, None)


def supported_suffixes() -> list[str]:
    return sorted(f".{s}" for s in paths.LANGUAGES)


#: What a parser raises on a text that is none of its language.
_FAILURES = (SyntaxError, ValueError, RecursionError)


def _attempt(parse, source: str | None, language: str | None):
    if language not in parse:
        return None, "unsupported"
    if source is None:
        return None, "unreadable"
    try:
        return parse[language](source), None
    except _FAILURES:
        return None, "syntax"


def attempt_module(source: str | None, language: str | None) -> tuple[dict | None, str | None]:
    """(what the file declares, None), or (None, why it could not be parsed)."""
    return _attempt(_MODULE, source, language)


def _supported(files: DataFrame) -> DataFrame:
    """path, language and content of the files that have a parser, dealt to tasks by path: parsing costs far more than
    the bytes say by which Spark would put many files into one task. The key is a hash, so that a table that was grouped
    by path is dealt out again."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = files.select("path", paths.language_of(F.col("path")).alias("language"), "content").where("language is not null")
    return held.repartition(parts, F.xxhash64("path"))


def _in_batches(one: Callable[[str, str, str | None], dict], names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for mapInPandas: one(path, language, source) gives a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size = [], 0
            for path, language, source in zip(b["path"], b["language"], b["content"], strict=True):
                rows.append(one(path, language, source))
                size += len(source or "")
                if size >= BATCH_CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return run


#: So many entries of a list become Arrow's at a time.
_ENTRIES = 1000


def _arrow(values: list, kind: pa.DataType) -> list[pa.Array]:
    return [pa.array(values[k : k + _ENTRIES], kind) for k in range(0, len(values), _ENTRIES)]


def _list(arrays: list[pa.Array], kind: pa.ListType) -> pa.Array:
    """One value, the list of all entries of arrays."""
    entries = pa.concat_arrays(arrays) if arrays else pa.array([], kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries, type=kind)


def _module_row(pieces: Iterator[dict] | list[dict], schema: pa.Schema) -> dict[str, pa.Array]:
    """The lists of a module from its pieces; what a piece says is Arrow's before the next one is read."""
    kinds = ("functions", "classes", "types", "imports")
    held: dict[str, list[pa.Array]] = {k: [] for k in kinds}
    unsaid: dict[str, list] = {k: [] for k in kinds}
    later: set[str] = set()
    for piece in pieces:
        for k in kinds:
            held[k] += _arrow(piece[k], schema.field(k).type.value_type)
            unsaid[k] += piece.get("unsaid", {}).get(k) or [None] * len(piece[k])
        later |= piece.get("later", set())
    out = {}
    for k in kinds:
        whole, kind = _list(held[k], schema.field(k).type), schema.field(k).type
        if any(unsaid[k]):
            whole = _list([whole.flatten().filter(pa.array([n is None or n in later for n in unsaid[k]], pa.bool_()))], kind)
        out[k] = whole
    return out


def _symbols_of(symbols: list[dict], kind: pa.ListType) -> list[pa.Array]:
    return _arrow([s | {"contract_facets": list(s["contract_facets"].items())} for s in symbols], kind.value_type)


def _snapshot_row(found: tuple[str | None, list[dict]] | Iterator[tuple[list[dict], list[str]]], schema: pa.Schema) -> dict[str, pa.Array]:
    """The row of a whole snapshot, or of its pieces; what a piece says is Arrow's before the next one is read."""
    kind = schema.field("symbols").type
    if isinstance(found, tuple):
        return {"dependency_fp": pa.array([found[0]], pa.string()), "symbols": _list(_symbols_of(found[1], kind), kind)}
    arrays, keys, imports = [], [], []
    for symbols, names in found:
        arrays += _symbols_of(symbols, kind)
        keys += [(s["kind"], s["qualified_name"]) for s in symbols]
        imports += names
    order = pa.array(sorted(range(len(keys)), key=keys.__getitem__), pa.int64())
    return {"dependency_fp": pa.array([python_source.digest(sorted(imports))], pa.string()), "symbols": _list([_list(arrays, kind).flatten().take(order)], kind)}


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str | None]]:
    for b in batches:
        at = [b.column(name) for name in ("path", "language", "content")]
        for k in range(b.num_rows):
            yield tuple(c[k].as_py() for c in at)


def _file_by_file(parsers: dict[str, Callable], row: Callable, none, schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: a batch of one row for each (path, language, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = to_arrow_schema(schema)
        columns = {language: lambda source, parser=parser: row(parser(source), made) for language, parser in parsers.items()}
        for path, language, source in _sources(batches):
            found, error = _attempt(columns, source, language)
            out = (row(none, made) if found is None else found) | {"path": pa.array([path], pa.string()), "language": pa.array([language], pa.string()), "error": pa.array([error], pa.string())}
            yield pa.RecordBatch.from_arrays([out[name] for name in made.names], schema=made)

    return run


def parse_modules(files: DataFrame) -> DataFrame:
    """Rows of MODULE for the supported rows of files (path, content); error is set where parsing failed."""
    none = [{"functions": [], "classes": [], "types": [], "imports": []}]
    return _supported(files).mapInArrow(_file_by_file(dict(_PIECES), _module_row, none, MODULE), MODULE)


def parse_snapshots(files: DataFrame) -> DataFrame:
    """Rows of SNAPSHOT for the supported rows of files (path, content)."""
    return _supported(files).mapInArrow(_file_by_file(_SNAPSHOT | _SNAPSHOT_PIECES, _snapshot_row, (None, []), SNAPSHOT), SNAPSHOT)


#: So many symbols of a file, or a few more, leave a task in one row.
_PART = 2000


def parse_symbols(files: DataFrame) -> DataFrame:
    """parse_snapshots() with the symbols of a file in rows of a bounded size, in no order; only the last row of a file has
    its dependency_fp. A row with an error can follow others of its file, so these are not to be used alone."""
    parsers = _SNAPSHOT | _SNAPSHOT_PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = to_arrow_schema(SNAPSHOT)

        def part(path: str, language: str, found: tuple[str | None, list[dict]], error: str | None = None) -> pa.RecordBatch:
            out = _snapshot_row(found, made) | {"path": pa.array([path], pa.string()), "language": pa.array([language], pa.string()), "error": pa.array([error], pa.string())}
            return pa.RecordBatch.from_arrays([out[name] for name in made.names], schema=made)

        for path, language, source in _sources(batches):
            found, error = _attempt(parsers, source, language)
            if error or isinstance(found, tuple):
                yield part(path, language, found or (None, []), error)
                continue
            held, imports = [], []
            try:
                for symbols, names in found:
                    held += symbols
                    imports += names
                    if len(held) >= _PART:
                        yield part(path, language, (None, held))
                        held = []
                yield part(path, language, (python_source.digest(sorted(imports)), held))
            except _FAILURES:
                yield part(path, language, (None, []), "syntax")

    return _supported(files).mapInArrow(run, SNAPSHOT)


def analyze(files: DataFrame) -> DataFrame:
    """Modules that could be parsed; the others are left out."""
    return parse_modules(files).where("error is null").drop("error")


def _must(rows: DataFrame, good: Column, problem: Column) -> DataFrame:
    """The same rows; the job fails on one that is not good. It is a filter, as a column that nothing reads is not made."""
    return rows.where(F.when(good, F.lit(True)).otherwise(F.raise_error(problem).cast("boolean")))


def require_parsed(parsed: DataFrame) -> DataFrame:
    """The same rows; the job fails, naming the path, where one could not be parsed."""
    return _must(parsed, F.col("error").isNull(), F.concat(F.lit("cannot parse "), "path"))


def symbols(snapshots: DataFrame) -> DataFrame:
    """One row for each symbol, with its file and its place in it."""
    return snapshots.select("path", F.posexplode("symbols").alias("ordinal", "symbol")).select("path", "ordinal", "symbol.*")


def check_snapshots(snapshots: DataFrame) -> DataFrame:
    """The same rows; the job fails on a malformed digest or symbols that are not in strictly rising order."""
    digests = F.transform("symbols", lambda s: F.concat_ws(",", s["contract_fp"], s["implementation_fp"], F.coalesce(s["documentation_fp"], s["contract_fp"])))
    good = F.forall(digests, lambda d: d.rlike(r"^[0-9a-f]{64},[0-9a-f]{64},[0-9a-f]{64}\z"))
    keys = F.transform("symbols", lambda s: F.struct(s["kind"], s["qualified_name"]))
    n = F.greatest(F.size("symbols") - 1, F.lit(0))
    rising = F.forall(F.zip_with(F.slice(keys, F.lit(1), n), F.slice(keys, F.lit(2), n), lambda a, b: F.coalesce(a < b, F.lit(True))), lambda x: x)
    return _must(snapshots, good & rising, F.lit("a snapshot is malformed"))


def undocumented_functions(modules: DataFrame) -> DataFrame:
    """path and function of each function without a doc comment."""
    return modules.select("path", F.explode("functions").alias("f")).where(F.coalesce("f.existing_doc", F.lit("")) == "").select("path", "f.*")


def summary(modules: DataFrame) -> DataFrame:
    """One row of totals over modules."""
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c)
    return modules.agg(F.count(F.lit(1)).alias("modules"), n("functions"), n("classes"), n("types"), n("imports"))


def outline(modules: DataFrame) -> DataFrame:
    """Each module with the names of what it has, whether documented, and numbers of methods."""
    doc = lambda x: (F.coalesce(x["existing_doc"], F.lit("")) != "").alias("has_doc")
    return modules.select(
        "path", "language",
        F.transform("functions", lambda f: F.struct(f["name"].alias("name"), f["is_async"].alias("is_async"), doc(f))).alias("functions"),
        F.transform("classes", lambda c: F.struct(c["name"].alias("name"), F.size(c["methods"]).alias("method_count"), doc(c))).alias("classes"),
        F.transform("types", lambda t: F.struct(t["name"].alias("name"), t["kind"].alias("kind"))).alias("types"),
    )


def import_edges(modules: DataFrame) -> DataFrame:
    """source module, imported module, and names."""
    return modules.select("path", F.explode("imports").alias("i")).select(F.col("path").alias("src"), F.col("i.source").alias("dst"), "i.names", "i.is_default")
