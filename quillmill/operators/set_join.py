"""Jaccard joins of a large table of sets with a small one, which is sent to tasks in blocks of a bounded size, and of the sets in one text.

A task holds an inverted index of a block and counts each row's shared tokens with every set that has one, so sizes and
intersections are exact, no candidate is verified again and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def jaccard_join(rows: DataFrame, sets: DataFrame, threshold: float, block_tokens: int = 2_000_000) -> DataFrame:
    """(id of `rows`, id of `sets`, shared, jaccard) of all pairs that reach the threshold, which is above 0.

    Both tables are (id, array of distinct texts). Null and empty sets, and null tokens, are similar to nothing; repeated rows give a row each.
    """
    spark, (a, own), (b, other) = rows.sparkSession, rows.columns, sets.columns
    types = [to_arrow_type(rows.schema[a].dataType), to_arrow_type(sets.schema[b].dataType)]
    schema = f"`{a}` {rows.schema[a].dataType.simpleString()}, `{b}` {sets.schema[b].dataType.simpleString()}, shared int, jaccard double"

    def joined(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast([(r[0], [t for t in r[1] if t is not None]) for r in block])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = [i for i, _ in sent.value]
            size = np.array([len(x) for _, x in sent.value])
            index: dict[str, list[int]] = {}
            for k, (_, tokens) in enumerate(sent.value):
                for t in tokens:
                    index.setdefault(t, []).append(k)
            posted = {t: np.array(k) for t, k in index.items()}
            for batch in batches:
                left, right, counts, scores = [], [], [], []
                for i, tokens in enumerate(batch.column(1)):
                    tokens = tokens.as_py() or ()
                    hits = [posted[t] for t in tokens if t in posted]
                    if not hits:
                        continue
                    shared = np.bincount(np.concatenate(hits), minlength=len(ids))
                    score = shared / (size + sum(t is not None for t in tokens) - shared)
                    near = np.flatnonzero((shared > 0) & (score >= threshold))
                    left += [i] * len(near)
                    right += [ids[k] for k in near]
                    counts += shared[near].tolist()
                    scores += score[near].tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(left, pa.int64())).cast(types[0]), pa.array(right, types[1]), pa.array(counts, pa.int32()), pa.array(scores, pa.float64())], names=[a, b, "shared", "jaccard"])

        return rows.select(a, own).mapInArrow(run, schema)

    out, held, tokens = None, [], 0
    for r in sets.select(b, other).toLocalIterator():
        if not r[1]:
            continue
        if held and tokens + len(r[1]) > block_tokens:
            part = joined(held)
            out, held, tokens = part if out is None else out.unionByName(part), [], 0
        held.append(r)
        tokens += len(r[1])
    if held:
        part = joined(held)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def near_in(text: str, separator: str, words: re.Pattern, least: int) -> int:
    """How many pairs of different word sets of a text's parts share 0.75 of their words or more; of sets of `least` words or more.

    Of two such sets each has one of the shared words among its rarest quarter (and one), by the parts of this text.
    """
    sets = [x for x in {frozenset(words.findall(part)) for part in text.split(separator)} if len(x) >= least]
    many = Counter(t for x in sets for t in x)
    having: dict[str, list[frozenset[str]]] = {}
    near = 0
    for x in sets:
        head = sorted(x, key=lambda t: (many[t], t))[: len(x) // 4 + 1]
        candidates = set()
        for t in head:
            if many[t] > 1:
                own = having.setdefault(t, [])
                candidates.update(own)
                own.append(x)
        for y in candidates:
            if 3 * len(x) <= 4 * len(y) and 3 * len(y) <= 4 * len(x):
                shared = len(x & y)
                near += 4 * shared >= 3 * (len(x) + len(y) - shared)
    return near


def near_parts(text: Column, separator: str, words: str, least: int) -> Column:
    """The same of a column; a null text has no pairs. Each text is a row and its parts meet in its own task, so nothing is shuffled."""

    def run(texts: pa.Array) -> pa.Array:
        own = re.compile(words)
        return pa.array([near_in(t.as_py() or "", separator, own, least) for t in texts], pa.int64())

    return F.arrow_udf(run, "bigint")(text)
