"""Files of notes in formats that their content tells apart, read as one table.

json_lines: each line is an object. cases: an object with a list "cases". entries: a list, or an object with a list
under entries, records or data. object: any other object. text: all else. Files are read by Spark's binary reader, one row for
each, and parsed in the tasks; a file has to fit into a task's memory, so large JSON lines go through `tables.json_lines`.

Entries that aren't objects are left out; empty files have no entries; a file that isn't UTF-8 is text with marks for what isn't.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmill.functions.json_docs import parsed, text_of

#: Fields that may hold an entry's text and its id, in the order in which they are tried.
TEXT_FIELDS = ("note_text", "prompt", "prompt_text", "text")
ID_FIELDS = ("id", "note_id", "doc_id")
LIST_KEYS = ("entries", "records", "data")
#: Characters of entries that leave a task at once.
PART_CHARS = 4_000_000
NOTES = "path string, format string, place int, id string, text string, entry string"


def first_text(entry: dict, fields: tuple[str, ...]) -> str | None:
    """The first field that is a text with ink, trimmed; numbers count as their text."""
    return next((v.strip() for f in fields if isinstance(v := entry.get(f), str) and v.strip()), None)


def _lines(content: bytes) -> Iterator[str]:
    """The lines with ink, one at a time."""
    at = 0
    while at < len(content):
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        line = content[at:end].decode("utf-8", "replace")
        if line.strip():
            yield line
        at = end + 1


def told(content: bytes) -> tuple[str, Iterable]:
    """(format, entries) of a file's content. JSON lines are parsed as they are taken, so that a file's entries aren't held together."""
    content = content.removeprefix("\ufeff".encode())
    few = list(islice(_lines(content), 2))
    # An object with more after it is no JSON as a whole.
    if len(few) > 1 and isinstance(parsed(few[0])[1], dict):
        return "json_lines", (parsed(x)[1] for x in _lines(content))
    text = content.decode("utf-8", "replace")
    ok, value = parsed(text)
    if ok and isinstance(value, list):
        return "entries", value
    if ok and isinstance(value, dict):
        if isinstance(value.get("cases"), list):
            return "cases", value["cases"]
        return next((("entries", value[k]) for k in LIST_KEYS if isinstance(value.get(k), list)), ("json_lines" if "\n" not in text.strip() else "object", [value]))
    if few and isinstance(parsed(few[0])[1], dict):
        return "json_lines", [parsed(few[0])[1]]
    return "text", [{"text": text}] if text.strip() else []


def _parse(text_fields: tuple[str, ...], id_fields: tuple[str, ...]):
    def part(path: str, kind: str, own: list[tuple]) -> pa.RecordBatch:
        place, ids, texts, entries = zip(*own, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * len(own), pa.string()), pa.array([kind] * len(own), pa.string()), pa.array(place, pa.int32()), pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(entries, pa.string())],
            names=["path", "format", "place", "id", "text", "entry"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                kind, entries = told(content.as_py())
                own, size = [], 0
                for i, e in enumerate(entries):
                    if isinstance(e, dict):
                        entry = None if kind == "text" else text_of(e)
                        own.append((i, first_text(e, id_fields), e["text"] if kind == "text" else first_text(e, text_fields), entry))
                        size += len(entry or "")
                    if size > PART_CHARS or len(own) == 10_000:
                        yield part(path, kind, own)
                        own, size = [], 0
                if own:
                    yield part(path, kind, own)

    return run


def note_files(spark: SparkSession, path: str | list[str], text_fields: tuple[str, ...] = TEXT_FIELDS, id_fields: tuple[str, ...] = ID_FIELDS) -> DataFrame:
    """path, format, place in the file, id, text, entry (its JSON; null for plain texts)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(_parse(text_fields, id_fields), NOTES)


def write_list_files(df: DataFrame, path: str, key: str | None) -> None:
    """Rows of one array of structs each as a JSON file each: the list itself, or under a key."""
    column = df.columns[0]
    body = f"to_json(`{column}`)" if key is None else f"to_json(named_struct({json.dumps(key)}, `{column}`))"
    df.selectExpr(f"{body} AS value").write.option("maxRecordsPerFile", 1).text(path)
