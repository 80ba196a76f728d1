"""A declarative rule DSL compiled to column expressions, and ordered rule application.

A predicate is data: {"all": [...]}, {"any": [...]}, {"not": p}, or {"field": name, op: value} with op one of
eq ne gt gte lt lte in contains exists. A comparison with a missing field is false; numeric order
comparisons take a missing number as 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def compile_predicate(p: dict) -> Column:
    if "all" in p:
        return reduce(lambda a, b: a & b, map(compile_predicate, p["all"]), F.lit(True))
    if "any" in p:
        return reduce(lambda a, b: a | b, map(compile_predicate, p["any"]), F.lit(False))
    if "not" in p:
        return ~compile_predicate(p["not"])
    c = F.col(p["field"])
    op, v = next((k, x) for k, x in p.items() if k != "field")
    number = F.coalesce(c, F.lit(0))
    out = {
        "eq": lambda: c == v, "ne": lambda: c != v, "in": lambda: c.isin(list(v)), "contains": lambda: F.array_contains(c, v) if p.get("array") else c.contains(v),
        "gt": lambda: number > v, "gte": lambda: number >= v, "lt": lambda: number < v, "lte": lambda: number <= v, "exists": lambda: c.isNotNull() if v else c.isNull(),
    }[op]()
    return F.coalesce(out, F.lit(False))


def matched(rules: list[dict]) -> Column:
    """Sorted ids of the rules whose predicate holds."""
    return F.array_sort(F.array_compact(F.array(*[F.when(compile_predicate(r["when"]), F.lit(r["id"])) for r in rules if r.get("enabled", True)])))


def apply_in_order(codes: Column, rules: list[dict]) -> Column:
    """Codes after the rules by priority; each sees what those before it left: `add`, `drop`, `needs` (codes), `when`."""
    for r in sorted((r for r in rules if r.get("enabled", True)), key=lambda r: (r["priority"], r["id"])):
        fires = compile_predicate(r["when"]) if "when" in r else F.lit(True)
        for needed in r.get("needs", []):
            fires &= F.array_contains(codes, needed)
        after = F.array_union(F.array_except(codes, F.array(*map(F.lit, r.get("drop", []))).cast("array<string>")), F.array(*map(F.lit, r.get("add", []))).cast("array<string>"))
        codes = F.when(fires, after).otherwise(codes)
    return F.array_sort(codes)
