"""Shapes of TypeScript that a scanner takes for something else: slashes, angles and elements."""

import itertools

import pytest

from spandrel.operators import typescript_source as ts


def texts(source):
    return [t.text for t in ts.tokenize(source)]


#: Expressions, and whether they hold a pattern.
VALUES = {
    "n / 2": False, "a.return / 2 / b": False, "x++ / 2": False, "list[0] / 2": False, "f(a) / g(b)": False, "value! / 2": False, "3 / 4 / 5": False, "'a' / 2": False, "`a` / 2": False,
    "/a'b/.test(s)": True, "typeof /x/g": True, "!/[/'\"]/.test(s)": True, "s.replace(/\\//g, '`')": True, "a ? /b'/ : /c\"/": True, "[/`/, /'/]": True, "void /'/.lastIndex": True, "f(1) || /}/.exec(s)": True,
}
BODIES = ["return {};", "const v = {};", "if (ok) { use({}); }", "let r; r = {};", "for (const k of [{}]) { use(k); }"]


@pytest.mark.parametrize(("value", "pattern"), VALUES.items())
def test_slashes(value, pattern):
    for name, body in itertools.product(("n", "t", "re", "turn", "result"), BODIES):
        source = f"export function {name}(a: number, s: string): unknown {{ {body.replace('{}', value)} }}\nexport class After {{ m(): void {{}} }}"
        found = ts.scan(source)
        assert [f.name for f in found.functions] == [name] and [c.name for c in found.containers] == ["After"]
        marks = [t for t in found.functions[0].body if t.startswith("/") and len(t) > 1]
        assert bool(marks) == pattern


def test_patterns_after_conditions_and_blocks():
    source = "export function f(s: string) {\n if (s) /a'b/.test(s);\n while (g(s)) /\"/.exec(s);\n { h(); }\n /'/.test(s);\n return (s.length) / 2;\n}"
    body = ts.scan(source).functions[0].body
    assert [t for t in body if t.startswith("/") and len(t) > 1] == ["/a'b/", '/"/', "/'/"] and "/" in body


TYPES = ["Map<string, Map<string, number>>", "Array<{ a: string, b: Set<Map<string, string[]>> }>", "Record<string, (x: Array<number>, y?: Map<string, A>) => Promise<void>>", "[Map<string, A>, A]", "Partial<Pick<A, 'x' | 'y'>>"]


@pytest.mark.parametrize("kind", TYPES)
def test_nested_type_arguments(kind):
    source = f"""
export class Holder<K extends string, V = {kind}> extends Base<K, {kind}> implements One<{kind}>, Two {{
  private made = new Map<string, {kind}>()
  held: {kind} = make<string, {kind}>(1, 2);
  constructor(private readonly first: {kind}, second: number) {{ super() }}
  method<T extends {kind}>(x: {kind}, y: T): {kind} {{ return a < b ? x : y; }}
}}
export function make<A, B>(one: {kind}, two: B): {kind} {{ return cast<{kind}>(one) }}
export interface Shape {{ a: {kind}; b(x: {kind}): {kind} }}
export type Alias<T> = T extends {kind} ? {kind} : never
"""
    m = ts.module(source)
    (holder,) = m["classes"]
    assert [x["name"] for x in holder["methods"]] == ["method"] and holder["implements"][1] == "Two" and len(holder["implements"]) == 2
    assert [x["name"] for x in holder["properties"]] == ["made", "held"] and holder["properties"][1]["type"] == kind
    method = holder["methods"][0]
    assert [p["type"] for p in method["parameters"]] == [kind, "T"] and method["return_type"] == kind
    (made,) = m["functions"]
    assert [p["name"] for p in made["parameters"]] == ["one", "two"] and made["return_type"] == kind
    assert [(t["name"], t["kind"]) for t in m["types"]] == [("Shape", "interface"), ("Alias", "type")]


def test_comparisons_are_not_type_arguments():
    source = "export function f(a: number, b = a < 3, c = 4 > 2): boolean { return a < b && c > a }\nexport const k = 1 < 2;\nexport class C { x = a < b; y = c > d; m() { for (let i = 0; i < n; i++) use(i, n > i) } }"
    m = ts.module(source)
    assert [(p["name"], p["default"]) for p in m["functions"][0]["parameters"]] == [("a", None), ("b", "a < 3"), ("c", "4 > 2")]
    assert [p["name"] for p in m["classes"][0]["properties"]] == ["x", "y"] and [x["name"] for x in m["classes"][0]["methods"]] == ["m"]


ELEMENTS = [
    "<p>It's here</p>", "<a href='x/y' title=\"don't\">{it} isn't / </a>", "<><B.C d={{ e: '}' }} {...rest} />can't</>", "<li key={k}>{list.map((x) => <i>{x ? 'a' : <b>won't</b>}</i>)}</li>",
    "<input disabled value={`${a}'`} />", "<T prop=<i>it's</i> />", "<p>{/* it's a remark */}</p>",
]


@pytest.mark.parametrize("element", ELEMENTS)
def test_elements(element):
    for body in ("return {};", "return ({});", "const x = ok && {};", "const x = ok ? {} : null;", "render({}, a / b);", "const f = () => {};"):
        source = f"import R from 'r';\nexport function View(p: Props): JSX {{ {body.replace('{}', element)} }}\nexport default function Next() {{ return a / b / c }}"
        found = ts.scan(source)
        assert [f.name for f in found.functions] == ["View", "Next"] and found.dependencies == ["r"]
        assert [t for t in found.functions[0].body if t.startswith("<") and len(t) > 1] == [element]
    one = ts.snapshot(f"export function V() {{ return {element} }}")
    spaced = ts.snapshot(f"export  function V( )\n{{\n  return {element.replace(' ', '  ')};\n}}")
    assert one == spaced
    assert one != ts.snapshot(f"export function V() {{ return <b>{element}</b> }}")


@pytest.mark.parametrize("source", ["export const id = <T>(x: T): T => x", "export const id = <T,>(x: T) => x;", "export const id = <T extends A<B>>(x: T) => x", "export const v = <any>other;", "export const ok = a <b && c> d"])
def test_angles_that_open_no_element(source):
    found = ts.scan(source + "\nexport function after(x: string) { return x }")
    assert [f.name for f in found.functions] == ["after"]


@pytest.mark.parametrize("source", ["export const a = /x", "export const a = `${b", "export function f( {", "const a = 'x"])
def test_what_is_not_closed_is_refused(source):
    with pytest.raises(ts.SyntaxProblem):
        ts.scan(source)
