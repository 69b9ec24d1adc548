"""Small repositories of our own, for queries and tests that need source code and Markdown."""

from __future__ import annotations

PYTHON = '''"""Prices of goods."""
import math
from typing import overload
from . import rates

RATE = 3


def total(items: list[int], rate: float = 1.0) -> float:
    """The sum of items at a rate."""
    return sum(items) * rate


def _hidden():
    return None


async def fetch(url, *, retries=2):
    from .net import get

    return await get(url, retries)


class Basket(dict):
    """Goods by name."""

    limit: int = 10

    def __init__(self, owner: str):
        self.owner = owner

    @property
    def size(self) -> int:
        """How many."""
        return len(self)

    @size.setter
    def size(self, value: int) -> None:
        raise AttributeError

    @staticmethod
    def empty() -> "Basket":
        return Basket("")

    def _check(self):
        return True
'''

TYPESCRIPT = """import defaults, { round as near } from "./math";
import * as io from "io";

/** Formats a price. */
export function format(price: number, unit: string = "EUR"): string {
  return `${near(price)} ${unit}`;
}

export abstract class Shop<T> extends Base<T> implements Named, Open {
  private stock = 1;
  readonly name: string;
  /** Sells one. */
  sell(item: T): boolean { return this.stock > 0; }
  protected restock(): void {}
  static of<U>(u: U): Shop<U> { return new Plain(u); }
}

/** Has a name. */
export interface Named { name: string; rename(to: string): void }
export type Money = number | bigint;
export enum Unit { EUR = "eur", USD }
function internal() { return defaults; }
"""

README = """# Shop

Intro about `total` and [prices](src/prices.py).

## API
Call `format(price)`; see ![image](src/x.png).

```python
total([1, 2])
```

## Basket usage

Setext heading
---
More `text`.

## API
"""

CHANGELOG = "# Changelog\n\n## [1.0.0]\n- start\n"

FILES = [("src/prices.py", PYTHON), ("src/shop.ts", TYPESCRIPT)]
DOCUMENTS = [("README.md", README), ("CHANGELOG.md", CHANGELOG), ("docs/architecture.md", "# Architecture\n\nThe parts.\n"), ("docs/api.md", "# Reference\n\n`Shop` sells.\n")]


def changed(name: str, old: str, new: str) -> tuple[str, str, str, str, str, str]:
    """A row of FILE_CHANGE that replaces one piece of a sample file."""
    text = dict(FILES)[name]
    if old not in text:
        raise ValueError(old)
    return (name, "modified", name, name, text, text.replace(old, new))
