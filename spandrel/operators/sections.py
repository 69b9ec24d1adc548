"""Markdown documents as rows of sections with what they point at."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions import paths
from spandrel.schemas import SECTION

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)\Z", re.S)
_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]+|\Z)(.*)\Z", re.S)
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)\s*\Z")
_EDGE = "﻿ \t\n\r\v\f\xa0                　"


class Fences:
    """Follows fenced blocks: feed() says whether a line opens, closes or lies in one."""

    def __init__(self):
        self.open: tuple[str, int] | None = None

    def feed(self, line: str) -> str | None:
        m = _FENCE.match(line)
        if self.open:
            mark, n = self.open
            if m and m[1][0] == mark and len(m[1]) >= n and not m[2].strip(_EDGE):
                self.open = None
                return "close"
            return "inside"
        if m:
            self.open = (m[1][0], len(m[1]))
            return "open"
        return None


def make_slug(heading: str) -> str:
    import regex

    return regex.sub(r"[^\p{L}\p{M}\p{N}_ -]", "", heading.strip(_EDGE).lower()).replace(" ", "-")


def split(file: str, content: str) -> Iterator[tuple[str, str, str]]:
    """(heading, slug, body) of each section, in order; what stands before the first heading is left out.

    A repeated slug gets the first number that makes a new one.
    """
    lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    used: set[str] = set()
    tried: dict[str, int] = {}  # by base: all numbers up to it are used
    fences, now, i = Fences(), None, 0
    out: list[tuple[str, str, list[str]]] = []
    while i < len(lines):
        line = lines[i]
        heading = None
        if fences.feed(line) is None:
            m = _ATX.match(line)
            if m:
                heading = re.sub(r"[ \t]+#+[ \t]*\Z", "", m[1]).strip(_EDGE)
            elif line.strip(_EDGE) and i + 1 < len(lines) and _UNDERLINE.match(lines[i + 1]):
                heading = line.strip(_EDGE)
                i += 1
        if heading is None:
            if now:
                now[2].append(line)
        else:
            base = slug = make_slug(heading)
            n = tried.get(base, 0)
            while slug in used:
                n += 1
                slug = f"{base}-{n}"
            tried[base] = n
            used.add(slug)
            now = (heading, slug, [])
            out.append(now)
        i += 1
    for heading, slug, own in out:
        yield heading, slug, "\n".join(own).strip(_EDGE)


def _ticks(line: str) -> tuple[list[str], str]:
    """The code spans of a line, and the line with them blanked; an unmatched run of ticks ends the search."""
    runs = [(m.start(), m.end()) for m in re.finditer("`+", line)]
    spans, rest, i = [], list(line), 0
    while i < len(runs):
        a, b = runs[i]
        j = next((k for k in range(i + 1, len(runs)) if runs[k][1] - runs[k][0] == b - a), None)
        if j is None:
            break
        spans.append(line[b : runs[j][0]])
        rest[a : runs[j][1]] = " " * (runs[j][1] - a)
        i = j + 1
    return spans, "".join(rest)


def destinations(line: str) -> Iterator[str]:
    """Targets of the inline links of a line, images left out."""
    at = line.find("](")
    while at >= 0:
        label = line.rfind("[", 0, at)
        i = at + 2
        if label > 0 and line[label - 1] == "!":
            at = line.find("](", i)
            continue
        i += len(line[i:]) - len(line[i:].lstrip(" \t"))
        if line[i : i + 1] == "<":
            end = line.find(">", i)
            if end >= 0:
                yield line[i + 1 : end]
            at = line.find("](", (end if end >= 0 else i) + 1)
            continue
        depth, end = 0, i
        while end < len(line):
            c = line[end]
            if c == "\\":
                end += 1
            elif c == "(":
                depth += 1
            elif c == ")" and depth:
                depth -= 1
            elif c == ")" or (c in " \t" and not depth):
                break
            end += 1
        if end > i:
            yield line[i:end]
        at = line.find("](", max(end + 1, at + 2))


def evidence(file: str, body: str, heading: str = "") -> tuple[list[str], list[str]]:
    """Code spans and linked repository paths of a section, its heading first; a line in a fence is a code span."""
    own, rest = _ticks(heading)
    spans, links, fences = own, [t for t in (paths.link_target(file, d) for d in destinations(rest)) if t is not None], Fences()
    for line in body.split("\n"):
        state = fences.feed(line)
        if state == "inside":
            spans.append(line)
        elif state is None:
            own, rest = _ticks(line)
            spans += own
            links += [t for t in (paths.link_target(file, d) for d in destinations(rest)) if t is not None]
    return spans, links


def sections(files: DataFrame) -> DataFrame:
    """Rows of SECTION for the rows of files (path, content); unusable paths and null contents give none."""
    names = SECTION.names

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = paths.normalize(path or "")
                if file is not None and content is not None:
                    for i, (heading, slug, body) in enumerate(split(file, content)):
                        rows.append((file, i, heading, slug, body, *evidence(file, body, heading)))
            c = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, SECTION)


def index(files: DataFrame) -> DataFrame:
    return sections(files).select("file", "heading", "slug", "body").orderBy("file", F.col("ordinal"))
