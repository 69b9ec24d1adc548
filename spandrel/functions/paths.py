"""Paths and globs: tests as Column expressions, and their Python counterparts for drivers and parsers."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes by language. Fixed values.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "py": "python"}
_TEST_DIR = r"(^|/)(tests?|__tests__)/"
_TEST_NAME = r"\.(test|spec)\.[^.]+\z"


def language(path: str) -> str | None:
    """What language_of() says, of one path."""
    name = path.rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def language_of(path: Column) -> Column:
    """typescript, python, or null: by the last suffix, without regard to case."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))
    out = F.lit(None).cast("string")
    for s, language in LANGUAGES.items():
        out = F.when(suffix == s, language).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression of both Java and Python; * and ** do not enter names that begin with a dot."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        at_start = i == 0 or pattern[i - 1] == "/"
        if pattern.startswith("**/", i) and at_start:
            out += r"(?:(?!\.)[^/]+/)*"
            i += 3
        elif pattern.startswith("**", i):
            out += r"(?:(?!\.)[^/]+/)*(?!\.)[^/]+" if at_start else "[^/]*"
            i += 2
        elif c == "*":
            alone = at_start and pattern[i + 1 : i + 2] in ("", "/")
            out += (r"(?!\.)" if at_start else "") + ("[^/]+" if alone else "[^/]*")
            i += 1
        elif c == "?":
            out += "[^/]"
            i += 1
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out += "(?:" + "|".join(glob_regex(p)[1:-2] for p in pattern[i + 1 : end].split(",")) + ")"
            i = end + 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end + 1
        else:
            out += re.escape(c) if not c.isalnum() and c not in "/_" else c
            i += 1
    return f"^{out}\\z"


def _python_regex(pattern: str) -> re.Pattern:
    return re.compile(glob_regex(pattern)[:-2] + r"\Z")


def matches_any(path: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def match(path: str, patterns) -> bool:
    return any(_python_regex(p).match(path) for p in patterns)


def in_scope(path: Column, include, exclude=()) -> Column:
    """A supported suffix, an include pattern, no exclude pattern; without includes nothing is in scope."""
    return language_of(path).isNotNull() & matches_any(path, include) & ~matches_any(path, exclude)


def normal(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def is_test(path: Column) -> Column:
    return path.rlike(_TEST_DIR) | path.rlike(_TEST_NAME)


def is_documentation_source(path: Column) -> Column:
    return ~is_test(normal(path)) & language_of(path).isNotNull()


def is_watched(path: Column) -> Column:
    noise = path.contains(".test.") | path.contains(".spec.") | path.contains("node_modules/") | path.contains("dist/") | path.contains("build/")
    return path.rlike(r"\.(ts|tsx|js|jsx|py)\z") & ~noise


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_entrypoint(path: Column) -> Column:
    """index.* or main.* anywhere, or a TypeScript or Python file at the root."""
    name = F.lower(basename(path))
    return F.coalesce(name.rlike(r"^(?:index|main)\.[^.]+\z") | (~path.contains("/") & name.rlike(r"\.(?:[cm]?tsx?|py)\z")), F.lit(False))


def is_within(directory: Column, path: Column) -> Column:
    return (directory == "") | (path == directory) | path.startswith(F.concat(directory, F.lit("/")))


def is_markdown(path: Column) -> Column:
    return F.lower(path).endswith(".md")


def is_repository_relative(path: Column) -> Column:
    """Not empty, no control characters, not absolute, no drive or scheme, not above the root."""
    slashed = F.regexp_replace(path, r"\\", "/")
    bad = slashed.rlike(r"^/|^[A-Za-z]:/|^[A-Za-z][A-Za-z0-9+.-]*:|[\x00-\x1f\x7f]|(^|/)\.\.(/|\z)")
    return (path != "") & ~bad


#: Device names that no file can have on some systems. Fixed values.
RESERVED = r"(?i)(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|\z)"


def is_safe_target(path: Column) -> Column:
    """A relative path that can be written anywhere: no device names, no name that ends in a dot or space."""
    slashed = F.regexp_replace(path, r"\\", "/")
    return is_repository_relative(path) & ~slashed.rlike(RESERVED) & ~slashed.rlike(r"[. ](/|\z)") & ~path.rlike(r"^\\\\[?.]")


def normalize(path: str) -> str | None:
    """A repository path in its shortest form; None if it is absolute, has a scheme, or leaves the root."""
    if not path or re.search(r"[\x00-\x1f\x7f]", path):
        return None
    slashed = path.replace("\\", "/")
    if re.match(r"/|[A-Za-z][A-Za-z0-9+.-]*:", slashed):
        return None
    out = posixpath.normpath(slashed)
    if out in (".", "..") or out.startswith("../"):
        return None
    return out + "/" if slashed.endswith("/") else out


def failure_path(path: str | None) -> str | None:
    """A path that an error message may name: relative and inside the root, in its shortest form, else None."""
    if not path or re.search(r"[\x00-\x1f\x7f]", path):
        return None
    slashed = path.replace("\\", "/")
    if slashed.startswith("/") or re.match(r"[A-Za-z]:/", slashed):
        return None
    out = posixpath.normpath(slashed)
    return None if out in (".", "..") or out.startswith("../") else out


def link_target(file: str, target: str) -> str | None:
    """What a link in a file points at, as a repository path, without its fragment."""
    bare = target.split("#", 1)[0]
    if not bare or bare.startswith("/"):
        return None
    return normalize(posixpath.join(posixpath.dirname(file), bare))


def glob_list_error(patterns: list[str]) -> str | None:
    """Why a list of globs is refused: 64 patterns, 1024 bytes each, 16 KiB in all, relative and inside."""
    if len(patterns) > 64:
        return "too many patterns"
    if sum(len(p.encode()) for p in patterns) > 16 << 10:
        return "patterns are too long"
    for p in patterns:
        if not p or len(p.encode()) > 1024:
            return "a pattern is empty or too long"
        if "\\" in p or p.startswith("/") or ".." in p.split("/") or re.search(r"[\x00-\x1f\x7f]", p):
            return "a pattern is not relative"
    return None


def ref_error(ref: str) -> str | None:
    if not ref or ref.startswith("-") or len(ref.encode()) > 1024 or re.search(r"[\x00-\x1f\x7f]", ref):
        return "not a safe revision name"
    return None
