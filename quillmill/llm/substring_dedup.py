"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a position is the sum of its last 16 bytes' random numbers, each shifted by its age; a
chunk ends where it falls below a threshold, so ends depend on 16 bytes of content alone and an insertion
shifts no later chunk. Chunks are about `average` bytes long and repeated ones are found by digest. Chunks
that follow each other make one run where they repeat together: where an occurrence of each in another
document (of the first and last in all, and the nearest in the batch, those known) lies at the same shift.
Of each chunk the first occurrence (smallest id, then place) stays.

A passage's first 15 bytes and what lies before its first and after its last cut are in no whole chunk of
it. So a run is extended to both sides, to whole words, as far as its bytes equal those
beside the first occurrence of its outer chunk (for the first occurrence itself: beside the last), at most
`REACH` bytes (what agrees for longer has whole chunks of its own) and not into another run, and is then held against `min_words`. A passage without two cuts
has no whole chunk and isn't found: recall by length is measured in the tests and stated in the README.

Copies inside a batch are combined before the shuffle: one row for a digest leaves a batch, the others are
known to be repeats. So a passage in a third of all documents meets as one row for each batch.

Defined results: null and empty texts have no chunks; rows whose id is null take no part; rows with equal
ids are told apart by nothing and their runs are listed together; ties go to the smaller place; what repeats in one text alone is no repeat; an empty
table gives no rows; other columns are not read. Offsets are in UTF-8 bytes and may cut a line, never a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm.common import load, row_hash, stored
from quillmill.llm.shingles import BLOCK, SPACE, VALUE, U, _power, buffers, mix

_GEAR = (mix(np.arange(256, dtype=U) + U(0x6765617200)) >> U(32)).astype(np.uint32)


#: Bytes that decide on a cut.
SIGHT = 16


def gear(data: np.ndarray) -> np.ndarray:
    """The hash after each byte, modulo 2**32: by doubling the window, four steps for 16 bytes shifted by two bits each."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(2 * step)
        h = longer
    return h


def chunks(data: np.ndarray, edges: np.ndarray, average: int, shortest: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first byte in it, byte after it, digest, words begun) of all chunks, for blocks of whole documents."""
    a, n, limit = 0, len(edges) - 1, np.uint32((1 << 32) // average)
    while a < n:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + BLOCK, "right")) - 1)
        part, own = data[edges[a] : edges[b]], edges[a : b + 1] - edges[a]
        if len(part):
            # A window that reaches over a document's start would see its neighbour: no cuts in the first bytes.
            cut = gear(part) < limit
            near = np.arange(len(part)) - own[np.searchsorted(own, np.arange(len(part)), "right") - 1] < SIGHT - 1
            inside = part & 0xC0
            starts_char = np.append(inside[1:] != 0x80, True)
            ends = np.flatnonzero(cut & ~near & starts_char) + 1
            ends = np.unique(np.concatenate([ends, own[1:]]))
            ends = ends[ends > 0]
            final = np.isin(ends, own)
            keep, last = np.ones(len(ends), bool), 0
            if shortest > 1 and (np.diff(ends) < shortest).any():
                for i, (e, f) in enumerate(zip(ends.tolist(), final.tolist(), strict=True)):
                    if f or e - last >= shortest:
                        last = e
                    else:
                        keep[i] = False
                ends = ends[keep]
            begins = np.append(0, ends[:-1])
            up, down = _power(len(part) + 1)
            total = np.zeros(len(part) + 1, U)
            np.cumsum(VALUE_CASED[part] * up[: len(part)], out=total[1:])
            digest = mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(U))
            ink = ~SPACE[part]
            first = ink.copy()
            first[1:] &= ~ink[:-1]
            words = np.append(0, np.cumsum(first))
            doc = np.searchsorted(own, begins, "right") - 1
            yield a + doc, begins - own[doc], ends - own[doc], digest, words[ends] - words[begins]
        a = b


VALUE_CASED = VALUE.copy()
VALUE_CASED[65:91] = mix(np.arange(1, 27, dtype=U) + U(0xCA5ED)) | U(1)

_SCHEMA = "doc long, begin int, end int, digest long, words int, docs int, peer struct<doc: long, begin: int>, near struct<doc: long, begin: int>"
#: Bytes that are compared on each side of a run.
REACH = 512
#: Shorter repeats aren't reported; those of up to 30 words may lack a whole chunk and be missed, see the README.
MIN_WORDS = 15


def _chunked(average: int, shortest: int, holders: bool):
    """Rows of the chunks that meet others in the shuffle (`holders`), or those that are copies of one in their batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, edges = buffers(batch.column(1))
            found = list(chunks(data, edges, average, shortest))
            if not found:
                continue
            doc, begin, end, digest, words = (np.concatenate(x) for x in zip(*found, strict=True))
            doc = ids[doc]
            at = np.lexsort((begin, doc, digest))
            doc, begin, end, digest, words = (x[at] for x in (doc, begin, end, digest, words))
            new = np.append(True, digest[1:] != digest[:-1])
            other = new | np.append(True, doc[1:] != doc[:-1])  # another document with this digest
            group = np.cumsum(new) - 1
            docs_in = np.bincount(group, weights=other).astype(np.int64)
            # Of a digest that several documents here share one row meets the others; repeats inside one document all do.
            want = new | (docs_in[group] == 1)
            n = np.where(new, docs_in[group], 0)
            # For each row an occurrence in another document of the batch.
            lead = np.flatnonzero(new)
            second = np.full(len(lead), -1)
            other_at = np.flatnonzero(other & ~new)[::-1]
            second[group[other_at]] = other_at
            peer = np.where(doc == doc[lead[group]], second[group], lead[group])
            # And the nearest one: before this row, or after it where none is before.
            run_of = np.cumsum(other) - 1
            start_of = np.flatnonzero(other)
            before, after = start_of[run_of] - 1, np.append(start_of, len(doc))[run_of + 1]
            near = np.where((before >= 0) & (group[np.maximum(before, 0)] == group), before, np.where((after < len(doc)) & (group[np.minimum(after, len(doc) - 1)] == group), after, -1))
            if not holders:
                want, n = ~want, np.zeros(len(n), np.int64)
            n, peer, near = n[want], peer[want], near[want]
            for i in range(0, int(want.sum()), 100_000):
                s = slice(i, i + 100_000)
                peers, nears = (pa.StructArray.from_arrays([pa.array(doc[x]), pa.array(begin[x].astype(np.int32))], ["doc", "begin"], mask=pa.array(x < 0)) for x in (peer[s], near[s]))
                yield pa.RecordBatch.from_pydict({"doc": pa.array(doc[want][s]), "begin": pa.array(begin[want][s].astype(np.int32)), "end": pa.array(end[want][s].astype(np.int32)), "digest": pa.array(digest[want][s].view(np.int64)), "words": pa.array(words[want][s].astype(np.int32)), "docs": pa.array(n[s].astype(np.int32)), "peer": peers, "near": nears})

    return run


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (key, own bytes, other bytes, backwards?, to the text's end?): (key, bytes that agree, cut to whole words, words begun in them; -1 for a last word of the run that isn't whole).

    Forwards the bytes before are the last of the run, which counts for nothing but whether a word begins.
    """
    for batch in batches:
        size, words = [], []
        for own, other, back, whole in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            a, b = np.frombuffer(own, np.uint8), np.frombuffer(other, np.uint8)
            if back:
                a, b = a[::-1], b[::-1]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            n = int(differ[0]) if len(differ) else m
            gap = SPACE[a[:n]]
            if back:
                if not (whole and n == len(a)):
                    at = np.flatnonzero(gap)
                    n = int(at[-1]) + 1 if len(at) else 0
                ink = ~SPACE[a[:n]][::-1]
                begun = int((ink & ~np.append(False, ink[:-1])).sum()) if n else 0
            else:
                if not (whole and n == len(a)):
                    at = np.flatnonzero(gap)
                    n = int(at[-1]) if len(at) else 0
                ink = ~gap[:n]
                begun = int((ink[1:] & ~ink[:-1]).sum())
                if not n and len(a) > 1 and not SPACE[a[:2]].any():
                    begun = -1  # the run ends inside a word, which isn't whole in both
                n = max(0, n - 1)
            size.append(n)
            words.append(begun)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(words, pa.int32())], ["key", "size", "begun"])


def _extended(runs: DataFrame, rows: DataFrame, text_col: str, min_words: int) -> DataFrame:
    """The runs, extended, that have `min_words` words then."""
    texts = rows.select(F.col("doc").alias("_doc"), F.col(text_col).cast("binary").alias("_raw"))
    have = F.octet_length("_raw")
    kind = runs.schema["key"].dataType.simpleString()
    result = f"key {kind}, size int, begun int"
    room_left = F.least(F.lit(REACH), F.col("begin") - F.coalesce("before", F.lit(0)))
    room_right = F.least(F.lit(REACH), F.coalesce("after", have) - F.col("end"))
    own = runs.join(texts, F.col("key.doc") == F.col("_doc")).select(
        "key", "left", "right", F.substr("_raw", F.col("begin") - room_left + 1, room_left).alias("a"), (room_left == F.col("begin")).alias("a_whole"),
        F.substr("_raw", F.col("end"), room_right + 1).alias("b"), (F.col("end") + room_right == have).alias("b_whole"))
    size = F.least(F.octet_length("a"), F.col("left.begin"))
    lefts = own.join(texts, F.col("left.doc") == F.col("_doc")).select("key", "a", F.substr("_raw", F.col("left.begin") - size + 1, size).alias("o"), F.lit(True).alias("back"), "a_whole").mapInArrow(_agree, result)
    rights = own.join(texts, F.col("right.doc") == F.col("_doc")).select("key", "b", F.substr("_raw", F.col("right.end"), F.octet_length("b")).alias("o"), F.lit(False).alias("back"), "b_whole").mapInArrow(_agree, result)
    # Rows with equal ids: the most that any of them gives.
    best = lambda df, n: df.where("size > 0 OR begun < 0").groupBy("key").agg(F.max(F.struct("size", "begun")).alias(n))
    grown = runs.join(best(lefts, "l"), "key", "left").join(best(rights, "r"), "key", "left")
    l, r = F.coalesce("l.size", F.lit(0)), F.coalesce("r.size", F.lit(0))  # noqa: E741
    n = F.col("n_words") + F.coalesce("l.begun", F.lit(0)) + F.coalesce("r.begun", F.lit(0))
    span = lambda gone, b, e: F.when(gone & (e > b), F.array(F.struct(b.alias("begin"), e.alias("end")))).otherwise(F.expr("array()").cast("array<struct<begin:int,end:int>>"))
    b, e = F.col("begin"), F.col("end")
    removed = F.col("removed_bytes") + F.when(F.col("gone_left"), l).otherwise(0) + F.when(F.col("gone_right"), r).otherwise(0)
    return grown.where(n >= min_words).select(
        F.col("key.doc").alias("doc"), (b - l).alias("begin"), (e + r).alias("end"), n.cast("long").alias("n_words"), "n_chunks", removed.cast("long").alias("removed_bytes"),
        F.concat(span(F.col("gone_left"), b - l, b), "spans", span(F.col("gone_right"), e, e + r)).alias("spans"))


def repeated_runs(docs: DataFrame, average: int = 20, shortest: int = 8, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run of repeated chunks: the id, begin, end (bytes), n_words, n_chunks, removed_bytes, kept."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col))
    meet = Window.partitionBy("digest")
    first = F.min(F.struct("doc", "begin")).over(meet)
    held = rows.mapInArrow(_chunked(average, shortest, True), _SCHEMA).withColumn("n", F.sum("docs").over(meet)).withColumn("first", first).withColumn("last", F.max(F.struct("doc", "begin")).over(meet)).where("n > 1")
    # Where to compare: beside the first occurrence, and for those in its document beside another one.
    other = F.when(F.col("first.doc") != F.col("doc"), F.col("first")).when(F.col("last.doc") != F.col("doc"), F.col("last")).otherwise(F.col("peer"))
    held = held.select("doc", "begin", "end", "words", (F.struct("doc", "begin") != F.col("first")).alias("gone"), other.alias("at"), F.array("first", "last", "peer", "near").alias("others"))
    copies = rows.mapInArrow(_chunked(average, shortest, False), _SCHEMA).select("doc", "begin", "end", "words", F.lit(True).alias("gone"), F.col("peer").alias("at"), F.array("peer", "near").alias("others"))
    shifts = F.transform(F.filter("others", lambda o: o["doc"] != F.col("doc")), lambda o: F.struct(o["doc"].alias("doc"), (o["begin"] - F.col("begin")).alias("shift")))
    by = Window.partitionBy("doc").orderBy("begin", "end")
    chained = held.unionByName(copies).withColumn("shifts", shifts).drop("others")
    follows = (F.lag("end").over(by) == F.col("begin")) & F.arrays_overlap(F.lag("shifts").over(by), F.col("shifts"))
    linked = chained.withColumn("new", F.when(follows, 0).otherwise(1)).drop("shifts")
    ends_at = F.struct(F.col("at.doc").alias("doc"), (F.col("at.begin") + F.col("end") - F.col("begin")).alias("end"))
    runs = linked.withColumn("run", F.sum("new").over(by)).groupBy("doc", "run").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("words").cast("long").alias("n_words"), F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.when(F.col("gone"), F.col("end") - F.col("begin")).otherwise(0)).cast("long").alias("removed_bytes"), F.collect_list(F.when(F.col("gone"), F.struct("begin", "end"))).alias("spans"),
        F.min_by("at", "begin").alias("left"), F.max_by(ends_at, "begin").alias("right"), F.min_by("gone", "begin").alias("gone_left"), F.max_by("gone", "begin").alias("gone_right"))
    beside = Window.partitionBy("doc").orderBy("run")
    runs = stored(runs.withColumn("before", F.lag("end").over(beside)).withColumn("after", F.lead("begin").over(beside)))
    found = _extended(runs.withColumn("key", F.struct("doc", "run")).drop("doc", "run"), rows, text_col, min_words)
    return found.select(F.col("doc").alias(id_col), "begin", "end", "n_words", "n_chunks", "removed_bytes", (F.col("removed_bytes") == 0).alias("kept"), F.array_sort("spans").alias("spans"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` with the repeated chunks of reported runs, but their first occurrences, cut from the texts.

    Rows are told apart by a number of our own: ids may repeat and be null. What is first goes by id, null
    ids last, then by the text's hash; rows equal in both are cut alike.
    """
    # A text is known by its id and hash; these get a number in the order of ids.
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), row_hash(F.col(text_col)).alias("hash"))
    known = docs.select(key.alias("key"), F.col(text_col).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    sorted_ = known.repartitionByRange("key").sortWithinPartitions("key").withColumn("row", F.monotonically_increasing_id())
    numbered = stored(sorted_)
    spans = repeated_runs(numbered, id_col="row", text_col="text", **how).where("removed_bytes > 0")
    spans = spans.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("cut"))
    spans = numbered.select("key", "row").join(spans, "row").select("key", "cut")
    whole = docs.select(F.struct(*docs.columns).alias("all"), key.alias("key"))
    joined = whole.join(spans, "key", "left")
    raw = F.col("all")[text_col].cast("binary")
    # What lies between the cut spans, put together again.
    ends = F.concat(F.array(F.lit(0)), F.transform("cut", lambda s: s["end"]))
    begins = F.concat(F.transform("cut", lambda s: s["begin"]), F.array(F.octet_length(raw)))
    kept = F.transform(F.arrays_zip(ends.alias("e"), begins.alias("b")), lambda s: F.decode(F.substr(raw, s["e"] + 1, s["b"] - s["e"]), "UTF-8"))
    text = F.when(F.col("cut").isNull(), F.col("all")[text_col]).otherwise(F.concat_ws("", kept))
    return joined.select(F.col("all").withField(f"`{text_col}`", text).alias("all")).select("all.*")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of MIN_WORDS words or more in `documents` that occurs elsewhere too: documents without one have no row."""
    return repeated_runs(load(spark, sf_dir, "documents")).drop("spans")
