"""Changing one thing in a source text changes just the fingerprints that it should."""

import pytest

from spandrel.operators import python_source, typescript_source
from tests import samples

PRINTS = ("contract_fp", "implementation_fp", "documentation_fp")


def changes(parser, before, after):
    sides = []
    for text in (before, after):
        dependency, symbols = parser.snapshot(text)
        sides.append((dependency, {(s["kind"], s["qualified_name"]): s for s in symbols}))
    (d1, x), (d2, y) = sides
    out = {}
    for key in x.keys() | y.keys():
        if key not in x or key not in y:
            out[key[1]] = "removed" if key in x else "added"
        elif diff := [p.split("_")[0] for p in PRINTS if x[key][p] != y[key][p]]:
            out[key[1]] = ",".join(diff)
    return d1 != d2, out


PYTHON_CASES = [
    ("return sum(items) * rate", "return sum(items) + rate", False, {"total": "implementation"}),
    ("rate: float = 1.0", "rate: float = 2.0", False, {"total": "contract"}),
    ("-> float", "-> int", False, {"total": "contract"}),
    ("The sum of items", "A sum of items", False, {"total": "documentation"}),
    ("async def fetch", "def fetch", False, {"fetch": "contract"}),
    ("import math\n", "import cmath\n", True, {}),
    ("from .net import get", "from .web import get", True, {"fetch": "implementation"}),
    ("def _hidden():\n    return None", "def _hidden():\n    return 1", False, {}),
    ("(self, owner: str)", "(this, owner: str)", False, {"Basket": "implementation"}),
    ("limit: int = 10", "limit: int = 11", False, {"Basket": "contract,implementation"}),
    ("value: int) -> None", "value: float) -> None", False, {"Basket": "contract", "Basket.size": "contract"}),
    ("class Basket(dict)", "class Basket(list)", False, {"Basket": "contract"}),
    ('"""Goods by name."""', '"""Goods."""', False, {"Basket": "documentation"}),
    ("    @staticmethod\n", "", False, {"Basket": "contract", "Basket.empty": "contract"}),
    ("return len(self)", "return 1", False, {"Basket": "implementation", "Basket.size": "implementation"}),
    ("# nothing", "# nothing", False, {}),
]


@pytest.mark.parametrize(("old", "new", "dependency", "expected"), PYTHON_CASES)
def test_python_change(old, new, dependency, expected):
    assert changes(python_source, samples.PYTHON, samples.PYTHON.replace(old, new)) == (dependency, expected)


def test_python_private_bodies_do_not_leak():
    assert "_hidden" not in {s["qualified_name"] for s in python_source.snapshot(samples.PYTHON)[1]}


def test_python_layout_is_ignored():
    assert changes(python_source, "def f(a,b):\n  return a", "def f(a, b):\n\n    return (a)")[1] == {}


def test_python_overloads_hide_the_implementation():
    base = "from typing import overload\n@overload\ndef f(a: int) -> int: ...\n@overload\ndef f(a: str) -> str: ...\ndef f(a): return a\n"
    swapped = "from typing import overload\n@overload\ndef f(a: str) -> str: ...\n@overload\ndef f(a: int) -> int: ...\ndef f(a): return a\n"
    assert changes(python_source, base, swapped)[1] == {}
    assert changes(python_source, base, base.replace("def f(a): return a", "def f(a, b=1): return a"))[1] == {"f": "implementation"}


def test_python_last_binding_wins():
    first = "class A:\n  def f(self): return 1\n  def f(self, x): return 2\n"
    assert changes(python_source, first, "class A:\n  def f(self): return 9\n  def f(self, x): return 2\n")[1] == {}
    assert {s["qualified_name"] for s in python_source.snapshot("class A:\n  def f(self): return 1\n  f = 3\n")[1]} == {"A"}
    assert {s["qualified_name"] for s in python_source.snapshot("class A:\n  (f, *g) = 1, 2\n")[1]} == {"A"}


def test_python_module_rows():
    m = python_source.module(samples.PYTHON)
    total = m["functions"][0]
    assert [p["name"] for p in total["parameters"]] == ["items", "rate"]
    assert total["parameters"][1] == {"name": "rate", "type": "float", "optional": True, "default": "1.0"}
    assert total["return_type"] == "float" and total["existing_doc"] == "The sum of items at a rate."
    basket = m["classes"][0]
    assert basket["extends"] == "dict" and [x["name"] for x in basket["methods"]] == ["__init__", "size", "size", "empty", "_check"]
    assert [x["is_static"] for x in basket["methods"]] == [False, False, False, True, False]
    assert [i["source"] for i in m["imports"]] == ["math", "typing", ""]


TYPESCRIPT_CASES = [
    ("`${near(price)} ${unit}`", "`${near(price)}${unit}`", False, {"format": "implementation"}),
    ('unit: string = "EUR"', 'unit: string = "USD"', False, {"format": "implementation"}),
    ("price: number, unit", "price: bigint, unit", False, {"format": "contract"}),
    ("Formats a price", "Prints a price", False, {"format": "documentation"}),
    ("sell(item: T): boolean", "sell(item: T): number", False, {"Shop": "contract", "Shop.sell": "contract"}),
    ("this.stock > 0", "this.stock > 1", False, {"Shop": "implementation", "Shop.sell": "implementation"}),
    ("private stock = 1", "private stock = 2", False, {"Shop": "implementation"}),
    ("protected restock(): void {}", "protected restock(): void { return }", False, {"Shop": "implementation"}),
    ("extends Base<T>", "extends Other<T>", False, {"Shop": "contract"}),
    ("rename(to: string): void", "rename(to: string, at?: number): void", False, {"Named": "contract", "Named.rename": "contract"}),
    ("number | bigint", "number", False, {"Money": "contract"}),
    ("USD }", "USD, GBP }", False, {"Unit": "contract"}),
    ('"./math"', '"./maths"', True, {}),
    ("return defaults;", "return 1;", False, {}),
    (";\n", "\n", False, {}),
    ("EUR = \"eur\", USD }", "EUR = \"eur\", USD, }", False, {}),
]


@pytest.mark.parametrize(("old", "new", "dependency", "expected"), TYPESCRIPT_CASES)
def test_typescript_change(old, new, dependency, expected):
    assert old in samples.TYPESCRIPT
    assert changes(typescript_source, samples.TYPESCRIPT, samples.TYPESCRIPT.replace(old, new)) == (dependency, expected)


def test_typescript_module_rows():
    m = typescript_source.module(samples.TYPESCRIPT)
    assert [f["name"] for f in m["functions"]] == ["format"]
    assert m["functions"][0]["parameters"][1] == {"name": "unit", "type": "string", "optional": True, "default": '"EUR"'}
    shop = m["classes"][0]
    assert (shop["extends"], shop["implements"]) == ("Base<T>", ["Named", "Open"])
    assert [(x["name"], x["visibility"], x["is_static"]) for x in shop["methods"]] == [("sell", "public", False), ("restock", "protected", False), ("of", "public", True)]
    assert [(t["kind"], t["name"]) for t in m["types"]] == [("interface", "Named"), ("type", "Money"), ("enum", "Unit")]
    assert m["imports"] == [{"source": "./math", "names": ["round"], "is_default": True}, {"source": "io", "names": [], "is_default": False}]


def test_typescript_merges_interfaces():
    text = "export interface A { x: number }\nexport interface A { y: number }\n"
    swapped = "export interface A { y: number }\nexport interface A { x: number }\n"
    assert changes(typescript_source, text, swapped)[1] == {}


@pytest.mark.parametrize("text", ["export function f( {", "const a = `x", "export class A { m( }", "let s = 'x"])
def test_typescript_refuses_broken_text(text):
    with pytest.raises(ValueError):
        typescript_source.scan(text)


PROPERTY = """class A:
    @property
    def v(self) -> int:
        "Of v."
        return self._v
    @v.setter
    def v(self, x: int) -> None:
        self._v = x
    @staticmethod
    def s(a, b=1):
        return a
    def m(self, /, a, *rest, k=2, **more):
        return a
"""
MEMBER_CASES = [
    ("x: int", "x: str", {"A": "contract", "A.v": "contract"}),  # any accessor of the property
    ("self._v = x", "self._v = x + 1", {"A": "implementation", "A.v": "implementation"}),
    ("Of v.", "Of w.", {"A.v": "documentation"}),
    ("    @staticmethod", "    @v.deleter\n    def v(self): del self._v\n    @staticmethod", {"A": "contract,implementation", "A.v": "contract,implementation"}),
    ("    @staticmethod", "    def v(self): return 0\n    @staticmethod", {"A": "contract,implementation", "A.v": "contract,implementation,documentation"}),  # no longer a property
    ("@v.setter", "@w.setter", {"A": "contract,implementation", "A.v": "contract,implementation,documentation"}),  # of another: the last definition alone is in force
    ("def s(a,", "def s(c,", {"A": "contract", "A.s": "contract"}),  # no receiver
    ("def m(self, /, a,", "def m(this, /, a,", {}),
    ("def m(self, /, a,", "def m(self, a, /,", {"A": "contract", "A.m": "contract"}),
    ("*rest", "*others", {"A": "contract", "A.m": "contract"}),
    ("k=2", "k=3", {"A": "contract", "A.m": "contract"}),
    ("**more", "**most", {"A": "contract", "A.m": "contract"}),
    ("@property", "@abc.property", {"A": "contract", "A.v": "contract"}),  # still a property, by its last name
    ("@staticmethod", "@staticmethod_like", {"A": "contract", "A.s": "contract"}),
]


@pytest.mark.parametrize(("old", "new", "expected"), MEMBER_CASES)
def test_python_members(old, new, expected):
    assert old in PROPERTY
    assert changes(python_source, PROPERTY, PROPERTY.replace(old, new))[1] == expected


def test_python_overloads_within_classes():
    base = "class A:\n  @overload\n  def f(self, a: int): ...\n  @typing.overload\n  def f(self, a: str): ...\n  def f(self, a): return a\n"
    one = lambda text: {s["qualified_name"]: s for s in python_source.snapshot(text)[1]}
    assert changes(python_source, base, base.replace("a: str", "a: bytes"))[1] == {"A": "contract", "A.f": "contract"}
    assert changes(python_source, base, base.replace("return a", "return 1"))[1] == {"A": "implementation", "A.f": "implementation"}
    replaced = base + "  def f(self): return 2\n"  # a finished callable that is defined again
    plain = "class A:\n  def f(self): return 2\n"
    assert one(replaced)["A.f"] == one(plain)["A.f"]
    fresh = plain + "  @overload\n  def f(self, a: int): ...\n"
    assert one(fresh)["A.f"] != one(plain)["A.f"] and one(fresh)["A.f"]["implementation_fp"] == python_source.digest([])
