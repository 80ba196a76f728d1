"""Spans of text: finding with offsets, merging, overlap resolution, redaction, negation scope.

Offsets are zero-based code points, half open. Finding is one pass of each pattern over a text, and each fold
one pass over its ordered spans, in Arrow batches: both linear, where arrays that grow by one inside an
expression would be copied for each span.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Personal data that a pattern alone finds, with the confidence of each. Fixed values.
PII = {
    "EMAIL": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.95),
    "PHONE": (r"\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}", 0.85),
    "IPV4": (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0.75),
}


@dataclass(frozen=True)
class Detector:
    type: str
    pattern: str
    confidence: float
    #: The span is that of this group.
    group: int = 0
    #: A text without this needn't be searched.
    holds: str = ""


#: How a pattern of addresses starts: [class]+@, maybe at a word's edge.
_BEFORE_AT = re.compile(r"(?P<flags>\(\?i\))?(?P<edge>\\b)?\[(?P<own>[^\]]+)\]\+@")


@lru_cache(1000)
def _compiled(pattern: str) -> tuple[re.Pattern, re.Pattern | None, str]:
    m = _BEFORE_AT.match(pattern)
    if m is None:
        return re.compile(pattern, re.ASCII), None, ""
    flags = m["flags"] or ""
    return re.compile(flags + pattern[m.end() - 1 :], re.ASCII), re.compile(f"{flags}[{m['own']}]", re.ASCII), m["edge"] or ""


def _addresses(text: str, rest: re.Pattern, own: re.Pattern, edge: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, but from each "@" to the left: the run before it isn't tried from each of its places."""
    upto, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and own.match(text, start - 1):
            start -= 1
        if edge:
            word = lambda i: 0 <= i < len(text) and (text[i] == "_" or (text[i].isascii() and text[i].isalnum()))
            while start < at and word(start - 1) == word(start):
                start += 1
        found = rest.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            upto = found.end()
        at = text.find("@", max(at + 1, upto))


def spans_in(text: str, d: Detector) -> Iterator[tuple[int, int]]:
    """(start, end) of the pattern's matches, \\b and \\w being of ASCII."""
    if d.holds and d.holds not in text:
        return
    rest, own, edge = _compiled(d.pattern)
    if own is not None:
        yield from _addresses(text, rest, own, edge)
        return
    for m in rest.finditer(text):
        if m.end() > m.start():
            yield m.span(d.group)


FOUND = "struct<start:int,end:int,type:string,confidence:double,text:string>"


def _lists(counts: list[int | None], columns: dict[str, tuple[list, pa.DataType]]) -> pa.Array:
    """Lists of structs from flat columns; None is a null list."""
    at, offsets = 0, []
    for n in counts:
        offsets.append(None if n is None else at)
        at += n or 0
    values = pa.StructArray.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), values)


def found(text: Column, detectors: tuple[Detector, ...]) -> Column:
    """array<FOUND> of all matches of all detectors by start, the longer first, else in the detectors' order. Null for a null text."""

    def search(texts: pa.Array) -> pa.Array:
        counts: list[int | None] = []
        rows: list[tuple] = []
        for t in texts:
            t = t.as_py()
            own = sorted(((s, e, d.type, d.confidence, t[s:e]) for d in detectors for s, e in spans_in(t, d)), key=lambda x: (x[0], -x[1])) if t else []
            counts.append(None if t is None else len(own))
            rows += own
        start, end, kind, confidence, part = zip(*rows, strict=True) if rows else ((),) * 5
        return _lists(counts, {"start": (start, pa.int32()), "end": (end, pa.int32()), "type": (kind, pa.string()), "confidence": (confidence, pa.float64()), "text": (part, pa.string())})

    return F.arrow_udf(search, f"array<{FOUND}>")(text)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of all matches."""
    return F.transform(found(text, (Detector("", pattern, 1.0),)), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text")))


def find(df: DataFrame, text: str, patterns: dict[str, tuple[str, float]], keep: list[str]) -> DataFrame:
    """One row per match: `keep`, entity, start, end, match, confidence."""
    detectors = tuple(Detector(e, p, c, holds="@" if "@" in p else "") for e, (p, c) in patterns.items())
    rows = df.select(*keep, F.inline(found(F.col(text), detectors)))
    return rows.select(*keep, F.col("type").alias("entity"), "start", "end", F.col("text").alias("match"), "confidence")


#: start, end, label, confidence, source of a span in a fold; what a span lacks is None.
Span = tuple


def folded(spans: Column, fold: Callable[[list[Span]], list[Span]], kinds: dict[str, str]) -> Column:
    """`fold` over each array of spans, whose fields are `kinds` in this order, of names and SQL types."""
    types = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}

    def run(arrays: pa.Array) -> pa.Array:
        edges, values = arrays.offsets.to_pylist(), arrays.values
        flat = list(zip(*[values.field(k).to_pylist() for k in kinds], strict=True)) if len(values) else []
        counts: list[int | None] = []
        rows: list[Span] = []
        for valid, a, b in zip(arrays.is_valid().to_pylist(), edges[:-1], edges[1:], strict=True):
            own = fold(flat[a:b]) if valid else []
            counts.append(len(own) if valid else None)
            rows += own
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return _lists(counts, {k: (c, types[t]) for (k, t), c in zip(kinds.items(), columns, strict=True)})

    kind = ",".join(f"{k}:{t}" for k, t in kinds.items())
    return F.arrow_udf(run, f"array<struct<{kind}>>")(F.transform(spans, lambda s: F.struct(*[s[k].cast(t).alias(k) for k, t in kinds.items()])))


def merge(spans: DataFrame, by: str) -> DataFrame:
    """Disjoint spans: those that overlap or touch become one (islands)."""
    upto = F.max("end").over(Window.partitionBy(by).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(F.col("start") <= upto, 0).otherwise(1))
    running = F.sum("_new").over(Window.partitionBy(by).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_island", running).groupBy(by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_spans")).drop("_island")


def redact(text: Column, patterns: dict[str, tuple[str, float]]) -> Column:
    return reduce(lambda c, x: F.regexp_replace(c, x[1][0], f"[{x[0]}]"), patterns.items(), text)


def outside(spans: DataFrame, zones: DataFrame, by: str) -> DataFrame:
    """Spans that overlap no protected zone of the same text."""
    z = zones.select(F.col(by).alias("_by"), F.col("start").alias("_zs"), F.col("end").alias("_ze"))
    return spans.join(z, (F.col(by) == F.col("_by")) & (F.col("start") < F.col("_ze")) & (F.col("_zs") < F.col("end")), "left_anti")


def _last_kept(spans: list[Span]) -> list[Span]:
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[2], s[0] - s[1])):
        if not kept or kept[-1][1] <= s[0]:
            kept.append(s)
        elif (s[2], s[1] - s[0]) > (kept[-1][2], kept[-1][1] - kept[-1][0]):
            kept[-1] = s
    return kept


def best_last_kept(spans: Column) -> Column:
    """Overlap resolution over array<struct<start, end, confidence>>: by start then confidence, each span meets
    only the one kept last; of the two the more confident stays, then the longer."""
    return folded(spans, _last_kept, {"start": "int", "end": "int", "confidence": "double"})


LABELLED = {"start": "int", "end": "int", "label": "string", "score": "double", "source": "string"}


def _by_pattern(s: Span) -> bool:
    return (s[4] or "").startswith("regex_")


def first_of_equals(spans: list[Span]) -> list[Span]:
    """One of spans equal in place, label and source: the first."""
    return list({(s[0], s[1], s[2], s[4] or ""): s for s in reversed(spans)}.values())[::-1]


def best_of_equals(spans: list[Span]) -> list[Span]:
    """One of spans equal in place and label: the highest score, then one of a pattern, then the first; in the order of the firsts."""
    best: dict[tuple, Span] = {}
    for s in spans:
        old = best.setdefault(s[:3], s)
        if (s[3] or 0, _by_pattern(s)) > (old[3] or 0, _by_pattern(old)):
            best[s[:3]] = s
    return list(best.values())


def best_of(spans: list[Span]) -> list[Span]:
    """Spans that overlap or touch, each against the one kept last, in the order of start, patterns first, then score.

    Overlaps that a pattern has part in: one label makes one span of both, with what the pattern says of it; of two
    labels the pattern's stays. Others: one label makes one span; of two labels that share 0.8 of the
    shorter the higher score stays, else both do.
    """
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0], not _by_pattern(s), -(s[3] or 0))):
        old = kept[-1] if kept else None
        if old is None or s[0] > old[1] or old[0] > s[1]:
            kept.append(s)
            continue
        shared, same = max(0, min(old[1], s[1]) - max(old[0], s[0])), old[2] == s[2]
        firm = shared > 0 and (_by_pattern(old) or _by_pattern(s))
        lead = s if firm and not _by_pattern(old) else old
        if same:
            source = lead[4] if firm else old[4] or s[4]
            kept[-1] = (min(old[0], s[0]), max(old[1], s[1]), lead[2], max(old[3] or 0, s[3] or 0), source)
        elif firm:
            kept[-1] = lead
        elif shared < 0.8 * min(max(1, old[1] - old[0]), max(1, s[1] - s[0])):
            kept.append(s)
        elif (s[3] or 0) > (old[3] or 0):
            kept[-1] = s
    return kept


def deduped(spans: Column, by_source: bool = True) -> Column:
    return folded(spans, first_of_equals if by_source else best_of_equals, LABELLED)


def merged_best_of(spans: Column) -> Column:
    """best_of over array<struct<start, end, label, score, source>>."""
    return folded(spans, best_of, LABELLED)


def negated(before: Column, cues: str = r"\b(no|not|without|never|denies)\b") -> Column:
    """Whether the text before a term, inside its scope, has a negation cue."""
    return before.rlike(cues)
