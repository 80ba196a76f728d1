"""Periodic runs of words by Main-Lorentz divide and conquer.

Words are interned as numbers, in each text anew. A stretch of words is halved; the repetitions that cross
its middle are those whose longer side holds two periods or more, so they show in one of two Z-functions:
of the words after the middle, and of the words before it read backwards. Each such period is extended to
both sides, multiples of a smaller period are left out, and a repetition that goes on beyond its stretch
is left to the stretch above, which holds more of it. Both halves are searched likewise.

Only a stretch with words that stand in a repeated window of four words can hold a run (of at least six
words and four periods), so the search starts from those stretches, with a margin; no run is lost.

Every text is handled whole in the task that reads it; nothing is shuffled. Time is n log n for n words.

Defined results: a null text has no words; an empty one neither; a null id is kept; repeated rows give a
row each; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import load

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of a window; a run of LEAST_WORDS and LEAST_PERIODS repeats at least one such window.
WINDOW = 4
#: Texts are handed on in batches of about so many characters.
BATCH = 4_000_000


def z_function(w: list[int], count: int) -> list[int]:
    """How long the words from each of the places 1 to `count` - 1 agree with the words from the start; 0 at place 0."""
    n, z, left, right = len(w), [0] * count, 0, 0
    first = w[0] if w else None
    for i in range(1, count):
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        elif w[i] != first:
            continue
        else:
            k = 0
        j = i + k
        while j < n and w[k] == w[j]:
            k += 1
            j += 1
        z[i] = k
        left, right = i, j
    return z


def _crossing(after: list[int], before: list[int]) -> Iterator[tuple[int, int, int]]:
    """(period, words to the right of the middle, words to its left) of the repetitions of which `after` has two periods or more."""
    most = (len(after) + len(before)) // LEAST_PERIODS
    z = z_function(after, min(most, len(after) // 2) + 1)
    covered = 0
    for q in range(1, len(z)):
        k = z[q]
        # Where a smaller period p reaches q + p words or more, q is a multiple of the smallest period.
        if k < q or q <= covered:
            continue
        covered = k
        j, n = 0, len(before)
        while j < n and before[j] == (before[j - q] if j >= q else after[q - 1 - j]):
            j += 1
        yield q, q + k, j


def _stretches(ids: list[int]) -> list[tuple[int, int]]:
    """Disjoint stretches, in order, that hold every run: windows of words that repeat, with what may stand before and after them."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    a = np.array(ids, np.uint64)
    h = a[: n - WINDOW + 1].copy()
    for k in range(1, WINDOW):  # unequal windows may meet in one number, which only costs time
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[k : n - WINDOW + 1 + k]
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h) + 2, np.int8)
    again[1 + order[1:][h[order[1:]] == h[order[:-1]]]] = 1  # equal to an earlier window
    edges = np.flatnonzero(np.diff(again))
    out: list[tuple[int, int]] = []
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        # A run's windows after its first period all repeat: length - period - 3 of them, and length >= 4 * period.
        margin = (end - start + WINDOW - 1) // (LEAST_PERIODS - 1)
        low, high = max(0, start - margin), end + WINDOW - 1
        if high - low >= LEAST_WORDS:
            if out and low <= out[-1][1]:
                low = min(low, out.pop()[0])
                while out and low <= out[-1][1]:
                    low = min(low, out.pop()[0])
            out.append((low, high))
    return out


def runs(ids: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbers, by start and then period."""
    n, found = len(ids), set()
    halves = _stretches(ids)
    while halves:
        low, high = halves.pop()
        if high - low < LEAST_WORDS:
            continue
        middle = (low + high) // 2
        after, before = ids[middle:high], ids[low:middle][::-1]
        for q, right, left in _crossing(after, before):
            found.add((middle - left, middle + right, q))
        for q, left, right in _crossing(before, after):
            found.add((middle - left, middle + right, q))
        halves += [(low, middle), (middle, high)]
    best: dict[tuple[int, int], int] = {}
    for start, end, q in found:
        if end - start < max(LEAST_WORDS, LEAST_PERIODS * q):
            continue
        if (start and ids[start - 1] == ids[start - 1 + q]) or (end < n and ids[end] == ids[end - q]):
            continue
        best[start, end] = min(q, best.get((start, end), q))
    return sorted(((start, end - start, q) for (start, end), q in best.items()), key=lambda r: (r[0], r[2]))


def interned(words: list) -> list[int]:
    numbers: dict = {}
    return [numbers.setdefault(w, len(numbers)) for w in words]


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that stand in a run after its first period."""
    if not found:
        return words
    keep = bytearray(b"\1" * len(words))
    for start, length, q in found:
        keep[start + q : start + length] = bytes(length - q)
    return [w for w, k in zip(words, keep, strict=True) if k]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of `docs`: the id, n_words, runs (array of start, length, period, by start) and collapsed (the text of the words that stay).

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0; `prepare` (id, words as UTF-8) may change them before the search.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def searched(key: object, text: str | None) -> tuple:
        words = (text or "").encode().split()
        if prepare is not None:
            words = prepare(key, words)
        found = runs(interned(words))
        return key, len(words), [{"start": s, "length": k, "period": q} for s, k, q in found], b" ".join(collapsed(words, found)).decode()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([(id_col, batch.schema.field(0).type), ("n_words", pa.int64()), ("runs", run_type), ("collapsed", pa.string())])
            rows, held = [], 0
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                rows.append(searched(key.as_py(), text.as_py()))
                held += len(rows[-1][-1])
                if held > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(search, f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting: every tenth id's text, by crc32, repeats from a word on with a period of its own."""
    if doc_id is None or not words:
        return words
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a : a + p] * (-(-(n - a) // p)))[: n - a]]


def run_digests(found: Column, collapsed_text: Column) -> dict[str, Column]:
    """The contract's columns from the operator's runs and collapsed text."""
    best = F.array_max(F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform(found, lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    return {
        "n_runs": F.size(found).cast("long"), "start": -best["s"], "length": best["length"], "period": -best["p"], "exponent_milli": F.floor(best["length"] * 1000 / -best["p"]),
        "runs_sha256": F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256), "collapsed_sha256": F.sha2(collapsed_text, 256),
    }


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's runs and digests of every whole text of `documents`."""
    found = periodic_runs(load(spark, sf_dir, "documents"), prepare=planted_period)
    return found.select("doc_id", *[c.alias(name) for name, c in run_digests(F.col("runs"), F.col("collapsed")).items()])
