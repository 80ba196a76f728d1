"""Thousands of terms found in texts in one pass, by an Aho-Corasick automaton that tasks build once.

Terms come to the driver in blocks of a bounded number of characters and each block is sent to the tasks, so
that neither grows with the dictionary; texts never move, and more blocks are more passes over them. The time
for a text is linear in its length and hits. Offsets are code points, half open.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


class Automaton:
    """Terms by an Aho-Corasick automaton; `iter` yields (start, term).

    At each place the automaton looks at all suffixes of what it has read, so it holds SHORT characters of a
    term at most; what is longer is compared where its beginning is found.
    """

    SHORT = 48

    def __init__(self, terms: Iterable[str]):
        import ahocorasick

        starting: dict[str, list[str]] = {}
        for t in terms:
            if t:
                starting.setdefault(t[: self.SHORT], []).append(t)
        self.machine = ahocorasick.Automaton()
        for key, own in starting.items():
            self.machine.add_word(key, (len(key), own))
        self.machine.make_automaton()
        self.empty = not starting

    def iter(self, text: str) -> Iterator[tuple[int, str]]:
        if self.empty:
            return
        for last, (size, own) in self.machine.iter(text):
            start = last + 1 - size
            for t in own:
                if len(t) == size or text.startswith(t, start):
                    yield start, t


def blocks(rows: DataFrame, most_chars: int, text_at: int = 0) -> Iterator[list[Row]]:
    """The rows in blocks whose texts have `most_chars` characters together, or are a single row."""
    held, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r[text_at] or "")
        if held and size + n > most_chars:
            yield held
            held, size = [], 0
        held.append(r)
        size += n
    if held:
        yield held


def hits(machine: Automaton, text: str, overlapping: bool, words: bool) -> Iterator[tuple[str, int, int]]:
    """(term, start, end), each term's in order."""
    upto: dict[str, int] = {}
    for start, term in machine.iter(text):
        end = start + len(term)
        if words and ((start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())):
            continue
        if not overlapping:
            if start < upto.get(term, 0):
                continue
            upto[term] = end
        yield term, start, end


def find_terms(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", term_col: str = "term", fold: bool = True, overlapping: bool = False, words: bool = False, block_chars: int = 8_000_000) -> DataFrame:
    """A row for each hit: the id, term, start, end.

    `fold` disregards the case of A-Z, `words` keeps hits that no letter or digit touches, and hits of one term
    overlap only if `overlapping`. Null and empty terms and texts have no hits; repeated terms count once.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, term string, start int, end int"
    spark, out = docs.sparkSession, None
    term = F.translate(term_col, string.ascii_uppercase, string.ascii_lowercase) if fold else F.col(term_col)
    for rows in blocks(terms.select(term.alias("term")).where("term <> ''").distinct(), block_chars):
        sent = spark.sparkContext.broadcast([t for (t,) in rows])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machine = None
            for batch in batches:
                machine = machine or Automaton(sent.value)
                ids, found = [], []
                for i, text in enumerate(batch.column(1)):
                    if text := text.as_py():
                        for hit in hits(machine, text.translate(_LOWER) if fold else text, overlapping, words):
                            ids.append(i)
                            found.append(hit)
                            if len(found) >= 100_000:  # a text may have more hits than memory should hold
                                yield _batch(batch, id_col, ids, found)
                                ids, found = [], []
                if found:
                    yield _batch(batch, id_col, ids, found)

        part = docs.select(id_col, text_col).mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _batch(batch: pa.RecordBatch, id_col: str, ids: list[int], found: list[tuple[str, int, int]]) -> pa.RecordBatch:
    term, start, end = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(term), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[id_col, "term", "start", "end"])
