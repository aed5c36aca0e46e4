"""A small language of filter rules: tokens on properties, combined by & | !, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def token(column: Column, text: str, numeric: bool = False) -> Column:
    """`!x` not, `<x` `<=x` `>x` `>=x` compare, `*x*` contains, `x*` starts with, `*x` ends with, else equals."""
    text = text.strip()
    if text.startswith("!"):
        return ~token(column, text[1:], numeric)
    m = re.match(r"(<=|>=|<|>)(.*)", text)
    if m or numeric:
        op, value = m.groups() if m else ("=", text)
        x = F.lit(float(value)) if numeric or re.fullmatch(r"\s*-?\d+(\.\d+)?\s*", value) else F.lit(value.strip())
        return {"<": column < x, "<=": column <= x, ">": column > x, ">=": column >= x, "=": column == x}[op]
    if text.startswith("*") and text.endswith("*") and len(text) > 1:
        return column.contains(text[1:-1])
    if text.startswith("*"):
        return column.endswith(text[1:])
    if text.endswith("*"):
        return column.startswith(text[:-1])
    return column == F.lit(text)


def combine(rule: str | None, filters: dict[str, Column]) -> Column:
    """A rule like `(a & !b) | c` over named filters; no rule: any of them.  & binds closer than |, ! closest."""
    if not filters:
        return F.lit(True)
    words = re.findall(r"[()&|!]|[^\s()&|!]+", rule or " | ".join(filters))
    at = 0

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(words) and words[at] == "|":
            at += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        out = one()
        while at < len(words) and words[at] == "&":
            at += 1
            out = out & one()
        return out

    def one() -> Column:
        nonlocal at
        if at >= len(words):
            raise ValueError(f"rule ends early: {rule}")
        word = words[at]
        at += 1
        if word == "!":
            return ~one()
        if word == "(":
            out = either()
            if at >= len(words) or words[at] != ")":
                raise ValueError(f"missing ) in rule: {rule}")
            at += 1
            return out
        if word not in filters:
            raise ValueError(f"no filter named {word}")
        return filters[word]

    out = either()
    if at < len(words):
        raise ValueError(f"unexpected {words[at]} in rule: {rule}")
    return out
