"""TypeScript and JavaScript source text as rows, by a tokenizer and a scanner of declarations.

There is no type checker here: a type that is not written down is null. Everything rests on tokens, so two texts
that differ only in white space, comments, semicolons or trailing commas have the same fingerprints.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

from spandrel.operators.python_source import digest

_TOKEN = re.compile(
    r"(?P<comment>/\*[\s\S]*?\*/|//[^\n]*)|(?P<space>\s+)"
    r"|(?P<string>\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*')"
    r"|(?P<name>[#@]?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<number>\d[\w.]*)"
    r"|(?P<mark>=>|\.\.\.|\?\.|\*\*=?|[<>=!]==?|&&|\|\||\?\?|[{}()\[\];,<>+\-*/%&|^!~?:=.@#\\])"
)
_PAIRS = {"(": ")", "[": "]", "{": "}"}
MODIFIERS = ("export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override", "accessor")


class SyntaxProblem(ValueError):
    """The text has an unclosed bracket, string or template, or a character that begins no token."""


@dataclass(slots=True)
class Token:
    text: str
    start: int
    end: int
    doc: list[str] = field(default_factory=list)  # doc comments just before it

    @property
    def is_name(self) -> bool:
        return bool(re.match(r"[#A-Za-z_$\u0080-￿]", self.text))


#: Words after which an expression begins, so that a slash opens a pattern and "<" an element.
_BEFORE_VALUE = frozenset("return typeof case in of instanceof new delete void throw do else yield await default extends".split())
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_TAG = re.compile(r"<([A-Za-z_$][\w$.:-]*)?")
_ATTRIBUTE = re.compile(r"\s+|/\*[\s\S]*?\*/|//[^\n]*|[A-Za-z_$][\w$:.-]*|=")


def _value_begins(out: list[Token], opened: list[int]) -> bool:
    """Whether an expression, not an operator, comes after the tokens. opened: places whose brackets closed last."""
    if not out:
        return True
    last = out[-1]
    before = out[-2].text if len(out) > 1 else ""
    if last.is_name:
        return last.text in _BEFORE_VALUE and before not in (".", "?.")
    if last.text[0] in "\"'`" or last.text[0].isdigit() or last.text[0] == "<" and len(last.text) > 1 and last.text[-1] == ">":
        return False
    if last.text == ")":  # of if (...) and the like, or of a call
        head = opened[-1] - 1 if opened else -1
        return head >= 0 and out[head].text in ("if", "while", "for", "with") and (head == 0 or out[head - 1].text not in (".", "?."))
    if last.text in ("]", "}"):
        return False
    if last.text in "+-" and before == last.text and out[-2].end == last.start:  # i++ and i--
        return False
    if last.text == "!" and len(out) > 1 and out[-2].end == last.start:  # a value that is said not to be null
        return not (out[-2].is_name and before not in _BEFORE_VALUE or before in (")", "]"))
    return True


def tokenize(source: str) -> list[Token]:
    return _scan(source, 0, False)[0]


#: A piece of a file ends between two statements, after so many characters.
PIECE = 1 << 16


def _ends_piece(source: str, out: list[Token], at: int, angles: int) -> bool:
    """Whether what comes at a place outside all brackets begins a statement that takes nothing from the one before."""
    return not angles and out[-1].text in (";", "}") and source.startswith(("export ", "import "), at) and source[at - 1] == "\n"


def _scan(source: str, at: int, nested: bool, most: int | None = None) -> tuple[list[Token], int]:
    """Tokens from a place on, and where they end: at the end of the text, after the brace that closes a nested part, or
    after a statement when they come to `most` characters."""
    begun, angles = at, 0  # angles: how many "<" outside brackets have no ">"
    out: list[Token] = []
    docs: list[str] = []
    stack: list[int] = []
    closed: list[int] = []  # where the bracket that closed last was opened
    while at < len(source):
        c = source[at]
        if nested and c == "}" and not any(out[k].text == "{" for k in stack):
            return out, at + 1
        if most is not None and at - begun >= most and out and not stack and _ends_piece(source, out, at, angles):
            return out, out[-1].end  # what stands between, comments too, belongs to the next
        text = None
        if c == "`":
            end = _template_end(source, at)
        elif c == "/" and source[at + 1 : at + 2] not in ("/", "*") and (_value_begins(out, closed) or out[-1].text == "}" and _on_new_line(source, out[-1].end, at)):
            m = _PATTERN.match(source, at)
            if not m:
                raise SyntaxProblem("a pattern is not closed")
            end = m.end()
        elif c == "<" and source[at + 1 : at + 2] not in ("", "<", "=", " ", "\n") and (_value_begins(out, closed) or out[-1].text == "}" and _on_new_line(source, out[-1].end, at)) and (end := _element_or_none(source, at)):
            text = re.sub(r"\s+", " ", source[at:end])  # an element is one token, with its white space as one
        else:
            m = _TOKEN.match(source, at)
            if not m or source.startswith("/*", at) and m.lastgroup != "comment":
                raise SyntaxProblem("a character begins no token")
            end = m.end()
            if m.lastgroup == "comment":
                if m[0].startswith("/**") and len(m[0]) > 4:
                    docs.append(m[0])
                at = end
                continue
            if m.lastgroup == "space":
                at = end
                continue
            if m[0] in _PAIRS:
                stack.append(len(out))
            elif m[0] in _PAIRS.values() and stack:
                closed = [stack.pop()]
            elif not stack and m[0] in "<>":
                angles = max(angles + (1 if m[0] == "<" else -1), 0)
        out.append(Token(source[at:end] if text is None else text, at, end, docs))
        docs, at = [], end
    if nested:
        raise SyntaxProblem("a brace is not closed")
    return out, at


def _on_new_line(source: str, end: int, at: int) -> bool:
    return "\n" in source[end:at]


def _template_end(source: str, at: int) -> int:
    i = at + 1
    while i < len(source):
        if source[i] == "\\":
            i += 2
        elif source[i] == "`":
            return i + 1
        elif source.startswith("${", i):
            i = _scan(source, i + 2, True)[1]
        else:
            i += 1
    raise SyntaxProblem("a template is not closed")


def _element_or_none(source: str, at: int) -> int | None:
    """The end of an element (<a>...</a>, <a/>, <>...</>), or None if there is none, as in <T>(x: T) => x."""
    try:
        return _element_end(source, at)
    except (SyntaxProblem, RecursionError):
        return None


def _element_end(source: str, at: int) -> int:
    m = _TAG.match(source, at)
    name, i = m[1] or "", m.end()
    while True:  # the opening tag
        if source.startswith("/>", i) and name:
            return i + 2
        c = source[i : i + 1]
        if c == ">":
            i += 1
            break
        if not name or not c:
            raise SyntaxProblem("a tag is not closed")
        if c == "{":
            i = _scan(source, i + 1, True)[1]
        elif c in "\"'":
            i = source.find(c, i + 1) + 1
            if not i:
                raise SyntaxProblem("an attribute is not closed")
        elif c == "<":
            i = _element_end(source, i) if source[i - 1] == "=" else _type_arguments_end(source, i)
        elif found := _ATTRIBUTE.match(source, i):
            i = found.end()
        else:
            raise SyntaxProblem("not a tag")
    while True:  # text, elements and values in braces
        while i < len(source) and source[i] not in "<{":
            i += 1
        if source.startswith("{", i):
            i = _scan(source, i + 1, True)[1]
        elif found := re.compile(rf"</\s*{re.escape(name)}\s*>").match(source, i):
            return found.end()
        elif source.startswith("<", i) and not source.startswith("</", i):
            i = _element_end(source, i)
        else:
            raise SyntaxProblem("an element is not closed")


def _type_arguments_end(source: str, at: int) -> int:
    m = re.compile(r"<[\w$.,\s|&\[\]<\"']*>").match(source, at)
    if not m or m[0].count("<") != 1:
        raise SyntaxProblem("not a tag")
    return m.end()


def doc_text(comment: str) -> str:
    lines = [re.sub(r"^\s*\* ?", "", line).rstrip() for line in comment[3:-2].split("\n")]
    return "\n".join(lines).strip()


class Cursor:
    """Tokens with a place, and the matching ends of brackets."""

    def __init__(self, source: str, tokens: list[Token] | None = None, breaks: list[int] | None = None):
        self.source, self.tokens, self.at = source, tokenize(source) if tokens is None else tokens, 0
        self.breaks = [m.start() for m in re.finditer("\n", source)] if breaks is None else breaks
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.text in _PAIRS:
                stack.append(i)
            elif t.text in _PAIRS.values():
                if not stack or _PAIRS[self.tokens[stack[-1]].text] != t.text:
                    raise SyntaxProblem("brackets do not match")
                self.close[stack.pop()] = i
        if stack:
            raise SyntaxProblem("a bracket is not closed")
        self.angle = {i: k for i, t in enumerate(self.tokens) if t.text == "<" and (k := self._angle(i)) is not None}

    def _angle(self, i: int) -> int | None:
        """The ">" that closes the "<" at i if both hold type parameters or arguments, else None."""
        before = self.text(i - 1) if i else ""
        after_name = bool(before) and (self.tokens[i - 1].is_name or before in ("]", ")")) and before not in _BEFORE_VALUE - {"extends", "new"}
        depth, k = 0, i
        while k < len(self.tokens):
            t = self.text(k)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    after = self.text(k + 1)
                    if after == "(" or not after:
                        return k
                    apart = "\n" in self.source[self.tokens[k].end : self.tokens[k + 1].start]
                    ends = after in (")", "]", "}", ",", ";", ":", "=", "{", "[", ">", "|", "&", "?", ".", "?.", "=>", "extends", "implements", "is", "as", "satisfies", "in") or after[0] == "`"
                    return k if after_name and (ends or apart) else None
            elif t in _PAIRS:
                k = self.close[k]
            elif t in (";", ")", "]", "}") or t in ("&&", "||", "??", "==", "===", "!=", "!==", "+", "*", "/", "%", "^", "!", "**", "<=", ">=") or len(t) > 1 and t[0] == "<":
                return None
            k += 1
        return None

    def after(self, i: int) -> int:
        """The place after the token at i, or after what it opens."""
        return self.close.get(i, self.angle.get(i, i)) + 1

    def text(self, i: int | None = None) -> str:
        i = self.at if i is None else i
        return self.tokens[i].text if i < len(self.tokens) else ""

    def line(self, i: int) -> int:
        return bisect_left(self.breaks, self.tokens[i].start) + 1

    def words(self, a: int, z: int) -> list[str]:
        """Tokens from a to z as they count for a fingerprint: no semicolons, no trailing commas."""
        out = []
        for i in range(a, z):
            t = self.text(i)
            if t == ";" and not (self.text(i - 1) == "(" or "for" in (self.text(i - 2), self.text(i - 3))):
                continue
            if t == "," and self.text(i + 1) in ")]}":
                continue
            out.append(t)
        return out

    def slice(self, a: int, z: int) -> str | None:
        return self.source[self.tokens[a].start : self.tokens[z - 1].end] if z > a else None

    def find(self, stops: str | tuple, i: int, end: int) -> int:
        """The first token of stops outside brackets and type arguments, or end."""
        while i < end:
            if self.text(i) in stops:
                return i
            i = self.after(i)
        return end


def _parameters(c: Cursor, a: int, z: int) -> list[dict]:
    out, i = [], a
    while i < z:
        end = c.find((",",), i, z)
        start = i
        while c.text(start) in (*MODIFIERS, "...") or c.text(start).startswith("@"):
            start += 1
        colon = c.find((":",), start, end)
        equal = c.find(("=",), start, end)
        head = min(colon, equal)
        optional = c.text(head - 1) == "?"
        name = c.slice(start, head - optional)
        if name:
            kind = c.slice(colon + 1, equal) if colon < equal else None
            default = c.slice(equal + 1, end) if equal < end else None
            out.append({"name": name, "type": kind, "optional": optional or default is not None, "default": default, "words": c.words(i, head), "default_words": c.words(equal, end), "type_words": c.words(colon, equal) if colon < equal else []})
        i = end + 1
    return out


@dataclass
class Callable_:
    """A function or method declaration."""

    name: str
    modifiers: list[str]
    type_parameters: list[str]
    parameters: list[dict]
    returns: tuple[str | None, list[str]]
    body: list[str] | None
    lines: list[int]
    docs: list[str]
    signature: str

    def facets(self) -> dict:
        params = [[p["words"], p["type_words"], p["optional"]] for p in self.parameters]
        out = {"parameters": [self.type_parameters, params], "modifiers": sorted(m for m in self.modifiers if m not in ("export", "default", "declare"))}
        if self.returns[0] is not None:
            out["return"] = self.returns[1]
        return out

    def runtime(self) -> list:
        return [["async" in self.modifiers, "*" in self.modifiers], [p["default_words"] for p in self.parameters], self.body]


def _callable(c: Cursor, first: int, name_at: int, modifiers: list[str], end: int, name: str | None = None) -> tuple[Callable_, int]:
    """The callable whose name is at name_at, and the place after it."""
    i = name_at + 1 if name is None else name_at
    name = c.text(name_at) if name is None else name
    generics: list[str] = []
    while c.text(i) in ("?", "!"):
        modifiers = [*modifiers, c.text(i)]
        i += 1
    if c.text(i) == "<":
        generics = c.words(i, c.after(i))
        i = c.after(i)
    if c.text(i) != "(":
        raise SyntaxProblem("a parameter list is missing")
    params, i = _parameters(c, i + 1, c.close[i]), c.close[i] + 1
    returns: tuple[str | None, list[str]] = (None, [])
    if c.text(i) == ":":
        start = i + 1
        i = start + 1 if c.text(start) != "{" else c.close[start] + 1
        stop = i
        while stop < end and not (c.text(stop) in ("{", ";", "}") and c.text(stop - 1) not in ("|", "&", "=>", ":")):
            line_break = "\n" in c.source[c.tokens[stop - 1].end : c.tokens[stop].start]
            if line_break and c.text(stop) not in ("|", "&", ".", "[", "=>") and c.text(stop - 1) not in ("|", "&", "=>", ".", ","):
                break
            stop = c.after(stop)
        returns, i = (c.slice(start, stop), c.words(start, stop)), stop
    body, last = None, i - 1
    if c.text(i) == "{":
        last = c.close[i]
        body, i = c.words(i + 1, last), last + 1
    elif c.text(i) == ";":
        last, i = i, i + 1
    whole = c.source[c.tokens[first].start : c.tokens[last].end]
    docs = [d for k in range(first, name_at + 1) for d in c.tokens[min(k, len(c.tokens) - 1)].doc]
    return Callable_(name, modifiers, generics, params, returns, body, [c.line(first), c.line(last)], docs, whole.split("{", 1)[0].strip()), i


@dataclass
class Member:
    """A property, accessor, constructor or index of a class or interface."""

    name: str
    modifiers: list[str]
    words: list[str]
    value: list[str]
    type: str | None
    optional: bool
    docs: list[str]
    line: int


@dataclass
class Container:
    kind: str
    name: str
    modifiers: list[str]
    heritage: list[str]
    extends: list[str]
    implements: list[str]
    methods: list[Callable_]
    members: list[Member]
    words: list[str]
    lines: list[int]
    docs: list[str]


def is_hidden(modifiers: list[str], name: str) -> bool:
    return name.startswith("#") or "private" in modifiers or "protected" in modifiers


def _members(c: Cursor, a: int, z: int) -> tuple[list[Callable_], list[Member]]:
    methods, members, i = [], [], a
    while i < z:
        first, modifiers = i, []
        while c.text(i) in (";", ","):
            i += 1
            first = i
        if i >= z:
            break
        while True:
            t, after = c.text(i), c.text(i + 1)
            if t.startswith("@"):
                modifiers.append(t)
                i += 1
                if c.text(i) == "(":
                    modifiers += c.words(i, c.close[i] + 1)
                    i = c.close[i] + 1
            elif t in (*MODIFIERS, "*", "get", "set") and after not in ("(", ":", "=", ";", "?", "!", "<", "}", ","):
                modifiers.append(t)
                i += 1
            else:
                break
        name_at, name = i, c.text(i)
        if name == "[":
            inner = c.words(i + 1, c.close[i])
            name = inner[0] if len(inner) == 1 and c.tokens[i + 1].is_name else f"[computed:{digest(inner)}]"
            i = c.close[i] + 1
        elif name in ("(", "<", "{"):
            name = "()"
        else:
            name = name.strip("\"'")
            i += 1
        look = i
        while c.text(look) in ("?", "!"):
            look += 1
        if c.text(look) in ("(", "<") and name != "()":
            own, i = _callable(c, first, i, modifiers, z, name=name)
            if name == "constructor" or "get" in modifiers or "set" in modifiers:
                words = [name, *modifiers, *[w for p in own.parameters for w in (*p["words"], *p["type_words"])], "->", *own.returns[1]]
                members.append(Member(name, modifiers, words, [*(own.body or []), *[w for p in own.parameters for w in p["default_words"]]], own.returns[0], False, own.docs, own.lines[0]))
            else:
                methods.append(own)
            continue
        equal = c.find(("=", ";", ","), i, z)
        stop = i
        while stop < z and c.text(stop) not in (";", ","):
            if stop > i and "\n" in c.source[c.tokens[stop - 1].end : c.tokens[stop].start] and c.text(stop) not in ("|", "&", "?", ":", ".", "=>", "=") and c.text(stop - 1) not in ("|", "&", "=", "=>", ":", "?", "+", "-", "*", "/"):
                break
            stop = c.after(stop)
        equal = min(equal, stop) if c.text(equal) == "=" else stop
        colon = c.find((":",), i, equal)
        docs = [d for k in range(first, name_at + 1) for d in c.tokens[k].doc]
        members.append(Member(name, modifiers, c.words(first, equal), c.words(equal, stop), c.slice(colon + 1, equal) if colon < equal else None, c.text(i) == "?", docs, c.line(first)))
        i = max(stop, i + 1)
    return methods, members


@dataclass
class Source:
    functions: list[Callable_] = field(default_factory=list)
    containers: list[Container] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    dependencies: list[str] = field(default_factory=list)


def scan(source: str) -> Source:
    """Exported declarations and all imports of a module."""
    out, later, held = _declared(Cursor(source))
    for exported, own in held:
        if exported or own.name in later:
            (out.functions if isinstance(own, Callable_) else out.containers).append(own)
    return out


def _declared(c: Cursor) -> tuple[Source, set[str], list[tuple[bool, Callable_ | Container]]]:
    """Imports, the names that are exported by themselves, and all declarations with whether they say that they are."""
    out, i = Source(), 0
    n = len(c.tokens)
    later: set[str] = set()
    held: list[tuple[bool, object]] = []
    while i < n:
        first, modifiers = i, []
        while c.text(i).startswith("@") and len(c.text(i)) > 1:
            modifiers.append(c.text(i))
            i += 1
            while c.text(i) in (".", "("):
                i = (c.close[i] + 1) if c.text(i) == "(" else i + 2
        while c.text(i) in MODIFIERS and c.text(i + 1) not in ("(", "=", ".", ":", ";"):
            modifiers.append(c.text(i))
            i += 1
        t = c.text(i)
        exported = "export" in modifiers
        if t == "import" and c.text(i + 1) not in ("(", "."):
            i = _import(c, i, out)
        elif exported and t in ("{", "*"):
            if t == "{":
                later |= {c.text(k) for k in range(i + 1, c.close[i]) if c.text(k - 1) in ("{", ",", "type")}
                end = c.close[i] + 1
            else:
                end = i + 1 if c.text(i + 1) != "as" else i + 3
            if c.text(end) == "from":
                out.dependencies.append(c.text(end + 1).strip("\"'"))
                end += 2
            i = end
        elif t == "function":
            star = c.text(i + 1) == "*"
            name_at = i + 1 + star
            name = None if c.text(name_at) != "(" else "default"
            own, i = _callable(c, first, name_at, [*modifiers, *["*"] * star], n, name=name)
            held.append((exported, own))
        elif t in ("class", "interface", "enum") or t == "const" and c.text(i + 1) == "enum":
            i += t == "const"
            own, i = _container(c, first, i, modifiers)
            held.append((exported, own))
        elif t == "type" and i + 1 < n and c.tokens[i + 1].is_name and c.text(i + 2) in ("=", "<"):
            end, k = n, i + 2
            while k < n:
                if c.text(k) == ";" or k > i + 3 and "\n" in c.source[c.tokens[k - 1].end : c.tokens[k].start] and c.text(k) not in ("|", "&", "?", ":", "=", "=>") and c.text(k - 1) not in ("|", "&", "=", "=>", "?", ":", "<", ","):
                    end = k
                    break
                k = c.after(k)
            end = min(end, n)
            docs = [d for k in range(first, i + 1) for d in c.tokens[k].doc]
            held.append((exported, Container("type", c.text(i + 1), modifiers, [], [], [], [], [], c.words(i + 2, end), [c.line(first), c.line(max(first, end - 1))], docs)))
            i = end
        else:
            if t == "require" and c.text(i + 1) == "(":
                pass
            i = c.after(i)
    return out, later, held


def _import(c: Cursor, i: int, out: Source) -> int:
    end = i + 1
    names, default = [], False
    while end < len(c.tokens) and c.text(end)[:1] not in "\"'":
        if c.text(end) == "{":
            k = end + 1
            while k < c.close[end]:
                stop = c.find((",",), k, c.close[end])
                names.append(next(w for w in c.words(k, stop) if w != "type" or stop == k + 1))
                k = stop + 1
            end = c.close[end]
        elif c.text(end) not in ("*", "as", "from", ",", "type", "=", "require", "(") and c.text(end - 1) in ("import", "type"):
            default = True
        end += 1
    if end < len(c.tokens):
        module = c.text(end).strip("\"'")
        out.imports.append({"source": module, "names": names, "is_default": default})
        out.dependencies.append(module)
    return end + 1


def _container(c: Cursor, first: int, i: int, modifiers: list[str]) -> tuple[Container, int]:
    kind, name = c.text(i), c.text(i + 1)
    opening = i
    while c.text(opening) != "{":
        opening = c.after(opening)
        if opening >= len(c.tokens):
            raise SyntaxProblem("a declaration has no body")
    if name in ("{", "extends", "implements"):
        name = "default"
    heads: dict[str, list[str]] = {"extends": [], "implements": []}
    k = i + 1
    while k < opening:
        if c.text(k) in heads:
            word, k = c.text(k), k + 1
            while k < opening and c.text(k) not in heads:
                stop = c.find((",", "extends", "implements"), k, opening)
                heads[word].append(c.slice(k, stop) or "")
                k = stop + (c.text(stop) == ",")
        else:
            k += 1
    close = c.close[opening]
    docs = [d for k in range(first, i + 1) for d in c.tokens[k].doc]
    methods, members = ([], []) if kind == "enum" else _members(c, opening + 1, close)
    if kind == "enum":
        k = opening + 1
        while k < close:
            stop = c.find((",",), k, close)
            equal = c.find(("=",), k, stop)
            members.append(Member(c.text(k).strip("\"'"), [], c.words(k, stop), [], c.slice(equal + 1, stop) if equal < stop else None, False, c.tokens[k].doc, c.line(k)))
            k = stop + 1
    return Container(kind, name, modifiers, c.words(i + 2, opening), heads["extends"], heads["implements"], methods, members, c.words(opening, close + 1), [c.line(first), c.line(close)], docs), close + 1


def _doc(docs: list[str]) -> str | None:
    return (doc_text(docs[0]) or None) if docs else None


def _function_row(f: Callable_) -> dict:
    params = [{k: p[k] for k in ("name", "type", "optional", "default")} for p in f.parameters]
    return {"name": f.name, "parameters": params, "return_type": f.returns[0], "is_async": "async" in f.modifiers, "is_exported": True, "line_range": f.lines, "existing_doc": _doc(f.docs), "signature": f.signature}


def _container_row(x: Container) -> dict:
    properties = [{"name": m.name, "type": m.type, "optional": m.optional, "visibility": _visibility(m.modifiers, m.name), "existing_doc": _doc(m.docs)} for m in x.members if m.name != "constructor" and not {"get", "set"} & set(m.modifiers)]
    if x.kind == "class":
        methods = [_function_row(m) | {"visibility": _visibility(m.modifiers, m.name), "is_static": "static" in m.modifiers} for m in x.methods]
        return {"name": x.name, "extends": x.extends[0] if x.extends else None, "implements": x.implements, "methods": methods, "properties": properties, "is_exported": True, "line_range": x.lines, "existing_doc": _doc(x.docs)}
    return {"name": x.name, "kind": x.kind, "properties": properties, "line_range": x.lines, "existing_doc": _doc(x.docs)}


def module_pieces(source: str, size: int = PIECE) -> Iterator[dict]:
    """module() piece by piece, so that the tokens of a whole file are not held.

    `unsaid` has, for each row of functions, classes and types, None or the name of what is in the module only if some
    piece exports it by itself; `later` has the names that a piece so exports.
    """
    breaks, at = [m.start() for m in re.finditer("\n", source)], 0
    while True:
        tokens, at = _scan(source, at, False, size)
        found, later, held = _declared(Cursor(source, tokens, breaks))
        rows: dict[str, list] = {"functions": [], "classes": [], "types": []}
        unsaid: dict[str, list] = {kind: [] for kind in rows}
        for exported, own in held:
            kind = "functions" if isinstance(own, Callable_) else "classes" if own.kind == "class" else "types"
            rows[kind].append(_function_row(own) if kind == "functions" else _container_row(own))
            unsaid[kind].append(None if exported else own.name)
        yield {**rows, "imports": found.imports, "unsaid": unsaid, "later": later}
        if at >= len(source):
            return


def module(source: str) -> dict:
    pieces = list(module_pieces(source))
    later = {name for p in pieces for name in p["later"]}
    out: dict[str, list] = {kind: [row for p in pieces for row, name in zip(p[kind], p["unsaid"][kind], strict=True) if name is None or name in later] for kind in ("functions", "classes", "types")}
    return {**out, "imports": [row for p in pieces for row in p["imports"]]}


def _visibility(modifiers: list[str], name: str) -> str:
    return next((m for m in ("private", "protected") if m in modifiers), "private" if name.startswith("#") else "public")


def _symbol(kind: str, name: str, contract: dict, implementation, docs: list[str]) -> dict:
    facets = {k: digest(v) for k, v in sorted(contract.items())}
    return {
        "kind": kind, "qualified_name": name, "language": "typescript", "contract_facets": facets, "contract_fp": digest([kind, sorted(facets.items())]),
        "implementation_fp": digest(implementation), "documentation_fp": digest(sorted(docs)) if docs else None,
    }


def _merged(parts: list[dict]) -> dict:
    """Facets of declarations that are one symbol: equal ones as they are, else the sorted set of their digests."""
    out = {}
    for name in sorted({k for p in parts for k in p}):
        seen = sorted({digest(p[name]) for p in parts if name in p})
        out[name] = seen[0] if len(seen) == 1 else seen
    return out


def _group_symbol(kind: str, name: str, group: list[Callable_]) -> dict:
    overloads = [f for f in group if f.body is None] if any(f.body is not None for f in group) else group
    bodies = [f for f in group if f.body is not None]
    seen = (overloads or group) if len(group) > 1 else group
    return _symbol(kind, name, _merged([f.facets() for f in seen]), [f.runtime() for f in bodies], [d for f in group for d in f.docs])


def _symbols(declared: list[Callable_ | Container]) -> list[dict]:
    """The symbols of declarations; those of other names have no part in them."""
    out: list[dict] = []
    by: dict[str, list[Callable_]] = {}
    containers = [x for x in declared if isinstance(x, Container)]
    for f in declared:
        if isinstance(f, Callable_):
            by.setdefault(f.name, []).append(f)
    out += [_group_symbol("function", name, group) for name, group in by.items()]
    merged: dict[tuple[str, str], list[Container]] = {}
    for x in containers:
        key = (x.kind, x.name) if x.kind in ("interface", "enum") else (x.kind, f"{x.name}\0{len(merged)}")
        merged.setdefault(key, []).append(x)
    methods: dict[str, list[tuple[str, Callable_]]] = {}
    for (kind, _), group in merged.items():
        docs = [d for x in group for d in x.docs]
        if kind == "class":
            x = group[0]
            public = [["method", m.name, m.facets()] for m in x.methods if not is_hidden(m.modifiers, m.name)]
            public += [["member", m.words] for m in x.members if not is_hidden(m.modifiers, m.name)]
            contract = {"inheritance": x.heritage, "members": sorted(map(digest, public)), "modifiers": sorted(m for m in x.modifiers if m not in ("export", "default", "declare"))}
            body = [[m.name, m.runtime()] for m in x.methods] + [[m.name, m.words, m.value] for m in x.members]
            out.append(_symbol("class", x.name, contract, body, docs))
        elif kind == "interface":
            shapes = [["method", m.name, m.facets()] for x in group for m in x.methods] + [["member", m.words] for x in group for m in x.members]
            out.append(_symbol("interface", group[0].name, {"inheritance": sorted({digest(x.heritage) for x in group}), "members": sorted(set(map(digest, shapes)))}, [], docs))
        else:
            contract = {"members": sorted(digest(x.words) for x in group), "modifiers": sorted({m for x in group for m in x.modifiers if m not in ("export", "default", "declare")})}
            out.append(_symbol(kind, group[0].name, contract, [], docs))
        if kind in ("class", "interface"):
            for x in group:
                for m in x.methods:
                    if not is_hidden(m.modifiers, m.name):
                        methods.setdefault(f"{x.name}.{m.name}", []).append((kind, m))
    for name, group in methods.items():
        calls = [m for _, m in group]
        symbol = _group_symbol("method", name, calls)
        own = [m for kind, m in group if kind == "class"]
        out.append(symbol | {"implementation_fp": digest([m.runtime() for m in own if m.body is not None])})
    last = {(s["kind"], s["qualified_name"]): s for s in out}
    return [last[k] for k in sorted(last)]


_WORD = re.compile(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*")


def snapshot_pieces(source: str, size: int = PIECE) -> Iterator[tuple[list[dict], list[str]]]:
    """The symbols and dependencies of a module, piece by piece.

    The declarations of a name wait until the piece in which the text has the name for the last time. What does not say
    that it is exported waits for the end.
    """
    odd = re.search(r"[^\S\x00-\x7f]", source)  # white space that is also a character of names
    last = {} if odd else {m[0]: m.start() for m in _WORD.finditer(source)}
    waiting: dict[str, list[tuple[bool, Callable_ | Container]]] = {}
    settled: set[str] = set()
    later: set[str] = set()
    at = 0
    while True:
        tokens, at = _scan(source, at, False, size)
        found, more, held = _declared(Cursor(source, tokens, []))
        later |= more
        for exported, own in held:
            if own.name in settled:
                raise RuntimeError(f"{own.name} is declared after its last word")
            waiting.setdefault(own.name, []).append((exported, own))
        ended = at >= len(source)
        done = [n for n, own in waiting.items() if ended or last.get(n, len(source)) < at and all(exported for exported, _ in own)]
        settled.update(done)
        yield [s for n in done for s in _symbols([own for exported, own in waiting.pop(n) if exported or n in later])], found.dependencies
        if ended:
            return


def snapshot(source: str) -> tuple[str, list[dict]]:
    symbols, dependencies = [], []
    for some, names in snapshot_pieces(source):
        symbols += some
        dependencies += names
    return digest(sorted(dependencies)), sorted(symbols, key=lambda s: (s["kind"], s["qualified_name"]))
