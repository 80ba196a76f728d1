"""Sharding by Karmarkar-Karp differencing (largest differencing method, k ways).

The indivisible groups are sets of equal texts. A partial partition is k sums in falling order, each with
the tree of what it holds; the two partial partitions with the largest spread are combined in opposite
order until one is left. Groups are dealt to tasks of about `per_task` groups, each of which combines its
own into one partial partition; the tasks' partitions (k numbers each) are combined the same way, `fan`
in a task, level by level, and the last `fan` at most on the driver, which never sees a group. A group's rows are summed before any
shuffle, and finding a row's shard is an equi-join that adaptive execution splits for a hot group.

Defined results: a null text has no bytes and goes with the empty texts; sizes are UTF-8 bytes plus 16; a
group larger than a fair share takes a shard and the rest stays balanced; ties go by size, then digest;
slots follow a hash of the id, then id, size and checksum; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import checkpoint, collect_bounded, gapless_rank, hash64, load


def difference(parts: list[list[tuple[int, object]]], pairs: bool = False) -> list[tuple[int, object]]:
    """Combines partial partitions, each k (sum, tree) in falling order; a tree is None, a leaf, or a pair of trees.

    With `pairs` the leaves are pairs themselves, the parts are put in order, and lists of leaves come back instead of trees.
    """
    if pairs:
        made = difference([[(size, [leaf]) for size, leaf in sorted(p, key=lambda x: -x[0])] for p in parts])
        return [(size, [x for own in leaves(tree) for x in own]) for size, tree in made]
    heap = [(p[-1][0] - p[0][0], i, p) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = [(x + y, t if u is None else u if t is None else (t, u)) for (x, t), (y, u) in zip(a, reversed(b), strict=True)]
        joined.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], n, joined))
        n += 1
    return heap[0][2]


def leaves(tree) -> Iterator:
    stack = [tree]
    while stack:
        t = stack.pop()
        if isinstance(t, tuple):
            stack += t
        elif t is not None:
            yield t


def _partial(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        table = pa.Table.from_batches(list(batches), pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("bytes", pa.int64())]))
        if not table.num_rows:
            return
        rest = [(0, None)] * (shards - 1)
        made = difference([[(b, i), *rest] for i, b in enumerate(table["bytes"].to_pylist())])
        place = [0] * table.num_rows
        for j, (_, tree) in enumerate(made):
            for i in leaves(tree):
                place[i] = j
        n = table.num_rows
        table = table.combine_chunks()
        for batch in table.append_column("slot", pa.array(place, pa.int64())).append_column("part", pa.array([part] * n, pa.int64())).to_batches(20_000):
            yield batch
        yield pa.RecordBatch.from_pydict({"k1": pa.nulls(shards, pa.int64()), "k2": pa.nulls(shards, pa.int64()), "bytes": pa.array([s for s, _ in made], pa.int64()), "slot": pa.array(range(shards), pa.int64()), "part": pa.array([part] * shards, pa.int64())})

    return run


def _combined(shards: int):
    """(part, slot, up, place, bytes): where the slots of a group's partial partitions go, and (null part) the sums of those places."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["slot"].to_pylist(), table["bytes"].to_pylist(), strict=True))
        up = table["up"][0].as_py()
        made = difference([[(size, (part, slot)) for part, slot, size in rows[i : i + shards]] for i in range(0, len(rows), shards)], pairs=True)
        out = [(part, slot, up, place, None) for place, (_, own) in enumerate(made) for part, slot in own]
        out += [(None, None, up, place, size) for place, (size, _) in enumerate(made)]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("part", "slot", "up", "place", "bytes"))})

    return run


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", per_task: int = 25_000, fan: int = 256) -> DataFrame:
    """One row per row of `docs`: the id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(text)
    half = lambda a: F.conv(F.substring(digest, a, 15), 16, 10).cast("long")
    light = checkpoint(docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), half(1).alias("k1"), half(16).alias("k2")))
    groups = light.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"))
    tasks = max(1, -(-light.count() // per_task))
    placed = checkpoint(groups.repartition(tasks, "k1", "k2").sortWithinPartitions(F.desc("bytes"), "k1", "k2").mapInArrow(_partial(shards), "k1 long, k2 long, bytes long, slot long, part long"))
    sums = placed.where("k1 IS NULL").select("part", "slot", "bytes")
    leaf = placed.where("k1 IS NOT NULL").select("k1", "k2", "part", "slot")
    while tasks > fan:
        level = checkpoint(sums.withColumn("up", F.floor(F.col("part") / fan)).groupBy("up").applyInArrow(_combined(shards), "part long, slot long, up long, place long, bytes long"))
        leaf = leaf.join(level.where("part IS NOT NULL").select("part", "slot", "up", "place"), ["part", "slot"]).select("k1", "k2", F.col("up").alias("part"), F.col("place").alias("slot"))
        sums = level.where("part IS NULL").select(F.col("up").alias("part"), F.col("place").alias("slot"), "bytes")
        tasks = -(-tasks // fan)
    found = sorted((r.part, r.slot, r.bytes) for r in collect_bounded(sums, fan * shards, "partial partitions"))
    final = difference([[(size, (part, slot)) for part, slot, size in found[i : i + shards]] for i in range(0, len(found), shards)], pairs=True) if found else []
    where = [(*own, shard) for shard, (_, held) in enumerate(final) for own in held]
    target = spark.createDataFrame(where or [(-1, -1, -1)], "part long, slot long, shard int")
    rows = light.join(leaf.join(F.broadcast(target), ["part", "slot"]).select("k1", "k2", "shard"), ["k1", "k2"])
    rows = checkpoint(rows.select("_id", "size", "text_crc32", "shard", hash64(F.col("_id")).alias("_h")))
    ranked = gapless_rank(rows, "shard", [F.col("_h"), F.col("_id"), F.col("size"), F.col("text_crc32")], "slot", total=rows.count())
    return ranked.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result over all of `documents`: 40 shards, law `bytes`."""
    out = shard_by_bytes(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
