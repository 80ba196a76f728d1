"""JSON documents as text: leaves with pointers, patches and merge patches.

Paths are JSON pointers (RFC 6901: "~1" is "/", "~0" is "~"); patches are RFC 6902, merge patches RFC 7386. A
document is parsed once, in Arrow batches. Numbers keep the text they have in the document.

Null documents and text that isn't JSON give null; of repeated keys the last counts.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class PatchError(ValueError):
    pass


class _Number(str):
    """A number's own text."""


def _constant(name: str) -> object:
    raise ValueError(name)


def parsed(text: str | None) -> tuple[bool, object]:
    """(whether it is JSON, its value)."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_constant)
    except (ValueError, RecursionError):
        return False, None


def text_of(value: object) -> str:
    """Compact JSON, numbers as they were."""
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{text_of(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(text_of, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def escaped(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def tokens(pointer: str) -> list[str]:
    if pointer and not pointer.startswith("/"):
        raise PatchError(f"no pointer: {pointer}")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]


def leaves(value: object) -> Iterator[tuple[str, str | None]]:
    """(pointer, text) of all scalars, at any depth, in the document's order."""
    open_: list[tuple[str, object]] = [("", value)]
    while open_:
        path, v = open_.pop()
        if isinstance(v, dict):
            open_ += [(f"{path}/{escaped(k)}", x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            open_ += [(f"{path}/{i}", x) for i, x in reversed(list(enumerate(v)))]
        else:
            yield path, v if v is None or isinstance(v, str) else json.dumps(v)


def _place(items: list, token: str, new: bool) -> int:
    """A place in an array; `new`: one after the last, or "-", may be meant."""
    if new and token == "-":
        return len(items)
    if not token.isascii() or not token.isdigit() or (len(token) > 1 and token[0] == "0") or int(token) > len(items) - (not new):
        raise PatchError(f"no place {token}")
    return int(token)


def _step(value: object, token: str) -> object:
    if isinstance(value, dict) and token in value:
        return value[token]
    if isinstance(value, list):
        return value[_place(value, token, False)]
    raise PatchError(f"nothing at {token}")


def found(doc: object, path: list[str]) -> object:
    for t in path:
        doc = _step(doc, t)
    return doc


def _added(doc: object, path: list[str], value: object) -> object:
    if not path:
        return value
    above = found(doc, path[:-1])
    if isinstance(above, dict):
        above[path[-1]] = value
    elif isinstance(above, list):
        above.insert(_place(above, path[-1], True), value)
    else:
        raise PatchError(f"nothing can be below {path[-1]}")
    return doc


def _removed(doc: object, path: list[str]) -> object:
    found(doc, path)
    if not path:
        raise PatchError("the whole document")
    above = found(doc, path[:-1])
    del above[path[-1] if isinstance(above, dict) else int(path[-1])]
    return doc


def _equal(a: object, b: object) -> bool:
    if isinstance(a, _Number) or isinstance(b, _Number):
        return isinstance(a, _Number) and isinstance(b, _Number) and (str(a) == str(b) or float(a) == float(b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_equal(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    return type(a) is type(b) and a == b


def patched(doc: object, steps: list[dict]) -> object:
    """A new document; PatchError where a step can't be done."""
    doc = copy.deepcopy(doc)
    for s in steps:
        if not isinstance(s, dict) or "op" not in s or "path" not in s:
            raise PatchError("no step")
        op, path = s["op"], tokens(s["path"])
        if op in ("add", "replace", "test") and "value" not in s:
            raise PatchError(f"{op} without a value")
        if op in ("move", "copy"):
            source = tokens(s.get("from", "-"))
            value = copy.deepcopy(found(doc, source))
            if op == "move":
                if path[: len(source)] == source and path != source:
                    raise PatchError("a move below itself")
                doc = _removed(doc, source) if path != source else doc
            doc = _added(doc, path, value) if op == "copy" or path != source else doc
        elif op == "test":
            if not _equal(found(doc, path), s["value"]):
                raise PatchError(f"another value at {s['path']}")
        elif op == "add":
            doc = _added(doc, path, copy.deepcopy(s["value"]))
        elif op == "remove":
            doc = _removed(doc, path)
        elif op == "replace":
            found(doc, path)
            value = copy.deepcopy(s["value"])
            if not path:
                doc = value
            elif isinstance(above := found(doc, path[:-1]), list):
                above[int(path[-1])] = value
            else:
                above[path[-1]] = value
        else:
            raise PatchError(f"no op {op}")
    return doc


def merged(doc: object, other: object) -> object:
    """A merge patch: other's members win, its nulls delete, all else replaces."""
    if not isinstance(other, dict):
        return other
    out = dict(doc) if isinstance(doc, dict) else {}
    for k, v in other.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged(out.get(k), v)
    return out


def values_like(value: object, pattern: re.Pattern) -> set[str]:
    """Texts, whole numbers and keys, at any depth, that match a pattern wholly once trimmed and in capitals."""
    out, open_ = set(), [value]
    while open_:
        v = open_.pop()
        if isinstance(v, dict):
            open_ += [*v, *v.values()]
        elif isinstance(v, list):
            open_ += v
        elif isinstance(v, str):
            text = str(int(float(v))) if isinstance(v, _Number) and len(v) < 300 else v.strip().upper()
            if pattern.fullmatch(text):
                out.add(text)
    return out


def rewritten(value: object, change: Callable[[str], str], fields: frozenset[str] | None, least: int = 4) -> object:
    """The value with texts of `least` letters or more changed that are members named in `fields`, or any members, at any depth."""
    if isinstance(value, list):
        return [rewritten(v, change, fields, least) for v in value]
    if not isinstance(value, dict):
        return value
    text = lambda v: isinstance(v, str) and not isinstance(v, _Number)
    return {k: (change(v) if len(v) >= least and (fields is None or k in fields) else v) if text(v) else rewritten(v, change, fields, least) for k, v in value.items()}


def codes_anywhere(doc: Column, pattern: str = r"\+?(?:\d{5}|[A-Z]\d{4})") -> Column:
    """array<string>, in order, of all codes in a JSON text: as texts, numbers or keys."""

    def run(docs: pa.Array) -> pa.Array:
        own = re.compile(pattern, re.ASCII)
        return pa.array([sorted(values_like(v, own)) if ok else None for ok, v in map(parsed, docs.to_pylist())], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(doc)


def json_redacted(doc: Column, patterns: dict[str, str], fields: list[str] | None = None) -> Column:
    """A JSON text with the matches of each pattern (name: pattern) in its texts, or those named in `fields`, replaced by [name]."""

    def run(docs: pa.Array) -> pa.Array:
        own = [(re.compile(p, re.ASCII), f"[{name}]") for name, p in patterns.items()]

        def change(text: str) -> str:
            for p, mark in own:
                text = p.sub(mark, text)
            return text

        named = None if fields is None else frozenset(fields)
        return pa.array([text_of(rewritten(v, change, named)) if ok else None for ok, v in map(parsed, docs.to_pylist())], pa.string())

    return F.arrow_udf(run, "string")(doc)


LEAVES = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))


def json_leaves(doc: Column) -> Column:
    """array<struct<path, value>> of all scalars of a JSON text."""

    def run(docs: pa.Array) -> pa.Array:
        each = (parsed(d) for d in docs.to_pylist())
        return pa.array([[{"path": p, "value": v} for p, v in leaves(value)] if ok else None for ok, value in each], LEAVES)

    return F.arrow_udf(run, "array<struct<path:string,value:string>>")(doc)


def json_patched(doc: Column, steps: Column) -> Column:
    """struct<json, error>: the document after a JSON patch (a text, too); where a step fails, the document as it was and why."""

    def run(docs: pa.Array, patches: pa.Array) -> pa.Array:
        out = []
        for d, p in zip(docs.to_pylist(), patches.to_pylist(), strict=True):
            ok, value = parsed(d)
            valid, ops = parsed(p)
            if not ok:
                out.append(None)
            elif not valid or not isinstance(ops, list):
                out.append({"json": d, "error": "no patch"})
            else:
                try:
                    out.append({"json": text_of(patched(value, ops)), "error": None})
                except PatchError as e:
                    out.append({"json": d, "error": str(e)})
        return pa.array(out, pa.struct([("json", pa.string()), ("error", pa.string())]))

    return F.arrow_udf(run, "struct<json:string,error:string>")(doc, steps)


def json_merged(doc: Column, other: Column) -> Column:
    """A JSON text after a merge patch; null where either isn't JSON."""

    def run(docs: pa.Array, others: pa.Array) -> pa.Array:
        pairs = ((parsed(d), parsed(o)) for d, o in zip(docs.to_pylist(), others.to_pylist(), strict=True))
        return pa.array([text_of(merged(a, b)) if x and y else None for (x, a), (y, b) in pairs], pa.string())

    return F.arrow_udf(run, "string")(doc, other)
