"""Selector rules as data: rows (outlet, role, ord, selector) compiled to bits that a parse carries along.

A selector is a comma list of chains; a chain is compounds joined by a blank (below) or ``>`` (directly
below); a compound is a tag, classes and attribute tests (``[a]``, ``[a='v']``, ``[a*='v']``).  Every
compound of every chain has one bit.  While a page is read, each open element keeps which beginnings
of chains end at it and which end at it or above it; a new element's bits follow from its own tests and
its parent's two numbers, so a selector of any depth costs the same few operations, and an element
knows its own rules and those of everything around it when it opens.

Rules of one (outlet, role, ord) share a bit of the result; there are at most 63.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"([a-zA-Z0-9]+|\*)|\.([A-Za-z0-9_-]+)|\[([a-zA-Z-]+)(?:(\*?=)(?:'([^']*)'|\"([^\"]*)\"|([^\]]*)))?\]")
ATTRS = ("href", "property", "content", "itemprop")     # attributes that a rule may test
KEPT = 200_000                                          # kinds of elements whose tests are remembered


def _chains(selector: str) -> list[list[tuple[str, str]]]:
    """Chains of (how it hangs on the one before: '', ' ' or '>', compound)."""
    out, quote, depth, word = [[]], "", 0, ""
    hang = ""

    def end() -> None:
        nonlocal word, hang
        if word:
            out[-1].append((hang if out[-1] else "", word))
            word, hang = "", " "

    for c in selector.strip() + ",":
        if quote or depth:
            word += c
            quote = "" if c == quote else quote or (c if c in "'\"" else "")
            depth -= c == "]" and not quote
        elif c == "[":
            word, depth = word + c, 1
        elif c == ",":
            end()
            out.append([])
            hang = ""
        elif c == ">":
            end()
            hang = ">"
        elif c.isspace():
            end()
        else:
            word += c
    chains = out[:-1]
    if depth or quote or any(not x for x in chains):
        raise ValueError(f"unsupported selector {selector!r}")
    return chains


def _compound(text: str) -> tuple[str, tuple[str, ...], tuple[tuple[str, str, str], ...]]:
    """(tag or '', classes, attribute tests (name, operator, value))."""
    tag, classes, attrs, at = "", [], [], 0
    for m in _PART.finditer(text):
        if m.start() != at or (m[1] and at):
            break
        at = m.end()
        if m[1]:
            tag = "" if m[1] == "*" else m[1].lower()
        elif m[2]:
            classes.append(m[2])
        else:
            attrs.append((m[3].lower(), m[4] or "", next((v for v in m.group(5, 6, 7) if v is not None), "")))
    if at != len(text) or any(a not in ATTRS for a, _, _ in attrs):
        raise ValueError(f"unsupported selector {text!r}")
    return tag, tuple(classes), tuple(attrs)


class RuleSet:
    """Compiled rules; ``rows`` are (outlet, role, ord, selector)."""

    def __init__(self, rows: Iterable[tuple[str, str, int, str]]):
        self.names: list[tuple[str, str, int]] = []
        self.tests: list[tuple[int, tuple]] = []            # bit of a compound, its tests
        self.begin = self.below = self.child = self.last = 0
        self.rule_of: dict[int, int] = {}                   # last bit of a chain -> result bit
        at = 0
        for outlet, role, ord_, selector in rows:
            name = (outlet, role, int(ord_))
            if name not in self.names:
                self.names.append(name)
            rule = 1 << self.names.index(name)
            for chain in _chains(selector):
                for hang, compound in chain:
                    self.tests.append((at, _compound(compound)))
                    self.begin |= (hang == "") << at
                    self.below |= (hang == " ") << at
                    self.child |= (hang == ">") << at
                    at += 1
                self.last |= 1 << (at - 1)
                self.rule_of[at - 1] = rule
        if len(self.names) > 63:
            raise ValueError("at most 63 different (outlet, role, ord)")
        self.kinds: dict = {}
        self.hits: dict[int, int] = {0: 0}

    def __getstate__(self):
        return {**self.__dict__, "kinds": {}, "hits": {0: 0}}

    def step(self, tag: str, classes: list[str], attrs: dict, own_above: int, above: int) -> tuple[int, int]:
        """(bits of this element, bits of the rules it meets) from its parent's bits and those at or above it."""
        key = (tag, tuple(classes), *(attrs.get(a) for a in ATTRS))
        can = self.kinds.get(key)
        if can is None:
            if len(self.kinds) >= KEPT:
                self.kinds.clear()
            can = 0
            for bit, (t, cs, tests) in self.tests:
                if (not t or t == tag) and all(c in classes for c in cs) and all(
                        a in attrs and (not op or (v == (attrs[a] or "") if op == "=" else bool(v) and v in (attrs[a] or ""))) for a, op, v in tests):
                    can |= 1 << bit
            self.kinds[key] = can
        own = can & (self.begin | ((above << 1) & self.below) | ((own_above << 1) & self.child))
        ended = own & self.last
        rules = self.hits.get(ended)
        if rules is None:
            rules = 0
            for bit, rule in self.rule_of.items():
                if ended >> bit & 1:
                    rules |= rule
            self.hits[ended] = rules
        return own, rules

    def bit(self, outlet: str, role: str, ord_: int | None = None) -> int:
        """The result bit of a rule; without ``ord_`` those of all its ords."""
        return sum(1 << i for i, (o, r, n) in enumerate(self.names) if (o, r) == (outlet, role) and (ord_ is None or n == ord_))

    def ords(self, outlet: str, role: str) -> list[int]:
        return sorted(n for o, r, n in self.names if (o, r) == (outlet, role))

    def meets(self, x: Column, outlet: str, role: str, ord_: int | None = None) -> Column:
        """Element ``x`` itself meets the rule."""
        return x["rules"].bitwiseAND(F.lit(self.bit(outlet, role, ord_)).cast("long")) != 0

    def within(self, x: Column, outlet: str, role: str) -> Column:
        """Element ``x`` or one around it meets the rule."""
        return x["under"].bitwiseAND(F.lit(self.bit(outlet, role)).cast("long")) != 0


def rules_from_df(rules: DataFrame) -> RuleSet:
    """A rule table (outlet, role, ord, selector), configuration of a few rows an outlet."""
    rows = rules.select("outlet", "role", "ord", "selector").distinct().orderBy("outlet", "role", "ord", "selector").collect()
    return RuleSet([tuple(r) for r in rows])
