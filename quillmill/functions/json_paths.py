"""JSON records as maps from leaf paths ("/a/b", scalars as text) to values: get, set, patch and merge as column expressions.

All of these are narrow: a record is changed in its row, by built-in map functions. A path names itself and
all below it. Null maps stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.json_docs import json_leaves


def leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value) of all leaves of a JSON column, at any depth; keys in paths are escaped as in JSON pointers.

    Text that isn't JSON and null have no leaves; empty objects and arrays have none either.
    """
    return df.select(key, F.inline(json_leaves(F.col(json))))


def under(path: Column, top: str) -> Column:
    return (path == top) | path.startswith(f"{top}/")


def get(record: Column, path: str) -> Column:
    return F.try_element_at(record, F.lit(path))


def has(record: Column, path: str) -> Column:
    return F.exists(F.map_keys(record), lambda k: under(k, path))


def remove(record: Column, path: str) -> Column:
    return F.map_filter(record, lambda k, _: ~under(k, path))


def _clear(record: Column, path: str) -> Column:
    """The record without what is at and below a path, and without leaves above it."""
    above = [path[:i] for i in range(1, len(path)) if path[i] == "/"]
    return F.map_filter(record, lambda k, _: ~under(k, path) & ~k.isin(above) if above else ~under(k, path))


def put(record: Column, path: str, value: Column) -> Column:
    """The record with one leaf there, instead of all below it and of leaves above it."""
    return F.map_concat(_clear(record, path), F.create_map(F.lit(path), value.cast("string")))


def copy(record: Column, source: str, target: str) -> Column:
    part = F.map_filter(record, lambda k, _: under(k, source))
    moved = F.transform_keys(part, lambda k, _: F.concat(F.lit(target), F.substring(k, len(source) + 1, 1 << 30)))
    return F.when(has(record, source), F.map_concat(_clear(record, target), moved)).otherwise(record)


def patch(record: Column, steps: list[dict]) -> Column:
    """Applies JSON Patch steps (op, path, value, from) in order.

    Where a `test` fails or a replaced, removed, moved or copied path is missing, the whole patch is void and the record stays.
    """
    state, good = record, F.lit(True)
    for s in steps:
        op, path = s["op"], s["path"]
        if op == "test":
            good = good & get(state, path).eqNullSafe(F.lit(s["value"]).cast("string"))
        elif op == "add":
            state = put(state, path, F.lit(s["value"]))
        elif op == "replace":
            good, state = good & has(state, path), put(state, path, F.lit(s["value"]))
        elif op == "remove":
            good, state = good & has(state, path), remove(state, path)
        elif op == "copy":
            good, state = good & has(state, s["from"]), copy(state, s["from"], path)
        elif op == "move":
            # To a path below itself nothing can move: there it would be removed with its source.
            if path.startswith(s["from"] + "/"):
                raise ValueError(f"{s['from']} can't move below itself")
            good, state = good & has(state, s["from"]), copy(state, s["from"], path)
            state = remove(state, s["from"]) if path != s["from"] else state
        else:
            raise ValueError(f"unknown op {op}")
    return F.when(good, state).otherwise(record)


def merge(record: Column, other: Column) -> Column:
    """Deep merge: other's leaves win over what is at, above and below their paths; its null leaves delete."""
    clash = lambda k: F.exists(F.map_keys(other), lambda o: (o == k) | k.startswith(F.concat(o, F.lit("/"))) | o.startswith(F.concat(k, F.lit("/"))))
    return F.map_concat(F.map_filter(record, lambda k, _: ~clash(k)), F.map_filter(other, lambda _, v: v.isNotNull()))
