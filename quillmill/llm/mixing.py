"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. Weights are exact integers in proportion to the targets; block k of
a source with share w of their sum has release time floor(k / w) and deadline ceil((k + 1) / w), and
of the released blocks the one with the earliest deadline takes the next slot (ties: the source's name).
Shares that sum to one make this feasible, so after every slot each source is less than one block away
from its target's share, however long the run. When a source has no blocks left the others go on with
their weights rescaled: a new phase, which counts from its own start. Nothing is dropped or repeated.

The driver makes the schedule from one count for each source, in time proportional to the blocks, of which
there are at most MOST_BLOCKS and one for each source, and writes it in parts of a bounded size; rows get their slots by an equi-join, with native functions only.

Defined results: rows whose source is null belong to the source ""; sources
without a target weight get `default_weight` of the mean; sources whose weight isn't positive follow when
the others are done, in equal shares; within a source rows follow the hash of their id, then id, then text hash;
an empty table gives no rows; columns of `docs` stay inside `row`, so no name clashes.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import collect_bounded, gapless_rank, hash64, load, shared_folder

#: A phase begins with a step for each source, so the driver's work grows with the square of their number.
#: Rows of a block, at least, and blocks, at most, by default.
LEAST_ROWS, MOST_BLOCKS = 8, 4_000_000
MOST_SOURCES = 10_000
#: Slots of the schedule that leave the driver at once.
PART = 100_000


def whole_weights(weights: dict) -> dict:
    """Integers in exactly the proportions of `weights`."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in parts.values()))
    return {s: int(x * unit) for s, x in parts.items()}


def pfair(share: dict) -> Iterator[tuple]:
    """(source, block) of slot after slot without end, earliest deadline first among the released blocks."""
    total = sum(share.values())
    waiting = sorted((0, s, 0) for s in share)
    ready: list = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // share[s]), s, k))
        deadline, s, k = heapq.heappop(ready)
        if slot >= deadline:
            raise ArithmeticError("a deadline was missed")
        yield s, k
        heapq.heappush(waiting, ((k + 1) * total // share[s], s, k + 1))
        slot += 1


def pfair_period(share: dict) -> list:
    """The sources of the slots until every source has run its share in full."""
    return [s for s, _ in islice(pfair(share), sum(share.values()))]


def schedule(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, block) of every slot; a phase ends when a source has run its last block."""
    left = {s: n for s, n in blocks.items() if n}
    while left:
        done = {s: blocks[s] - n for s, n in left.items()}
        share = {s: weights[s] for s in left if weights[s] > 0}
        for s, k in pfair(whole_weights(share or dict.fromkeys(left, 1))):
            yield s, done[s] + k
            left[s] -= 1
            if not left[s]:
                del left[s]
                break


def _table(spark: SparkSession, slots: list[tuple], start: int, period: int) -> DataFrame:
    """(_s, _k, _slot) of consecutive slots from `start`: one string literal, split by the JVM into rows of `period` slots."""
    rows = ("%d:%s" % (start + i, ";".join("%d,%d" % x for x in slots[i : i + period])) for i in range(0, len(slots), period))
    row = spark.range(1).select(F.explode(F.split(F.lit("|".join(rows)), "[|]")).alias("r")).where("r <> ''").select(F.split("r", ":").alias("r"))
    each = row.select(F.col("r")[0].cast("long").alias("first"), F.posexplode(F.split(F.col("r")[1], ";")).alias("i", "x")).select("first", "i", F.split("x", ",").alias("x"))
    return each.select(F.col("x")[0].cast("long").alias("_s"), F.col("x")[1].cast("long").alias("_k"), (F.col("first") + F.col("i")).alias("_slot"))


def _scheduled(spark: SparkSession, slots: Iterator[tuple], period: int) -> DataFrame:
    """The whole schedule as a table; one of several parts goes through the shared folder, so that the driver holds one part."""
    part, start = list(islice(slots, PART)), 0
    table = _table(spark, part, 0, period)
    if len(part) < PART:
        return table
    path = f"{shared_folder(spark)}/schedule-{uuid.uuid4().hex}"
    while part:
        _table(spark, part, start, period).write.mode("append").parquet(path)
        start += len(part)
        part = list(islice(slots, PART))
    return spark.read.schema(table.schema).parquet(path)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int | None = None, period: int = 1000, alpha: float = 0.5, default_weight: float = 1.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows of `docs` as the struct `row`, with source_no, block_no, slot (of the block) and in_block.

    Without `weights` a source's weight is its count to the power `alpha`. `period` slots make a row of the
    schedule on its way to the executors; the result doesn't depend on it. Blocks have LEAST_ROWS rows, or as many as
    make MOST_BLOCKS of them, unless `block_rows` says how many.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col(source_col), F.lit(""))
    counted = sorted((r["s"], r["n"]) for r in collect_bounded(docs.groupBy(source.alias("s")).agg(F.count(F.lit(1)).alias("n")), MOST_SOURCES, "sources"))
    if weights is None:
        target = {s: n**alpha for s, n in counted}
    else:
        mean = sum(weights.values()) / max(1, len(weights))
        target = {s: weights.get(s, default_weight * mean) for s, _ in counted}
    block_rows = block_rows or max(LEAST_ROWS, -(-sum(n for _, n in counted) // MOST_BLOCKS))
    number = {s: i for i, (s, _) in enumerate(counted)}
    blocks = {number[s]: -(-n // block_rows) for s, n in counted}
    slots = _scheduled(spark, schedule(blocks, {number[s]: w for s, w in target.items()}), period)

    names = [F.lit(s) for s, _ in counted]
    no = F.array_position(F.array(*names), source) - 1 if names else F.lit(0).cast("long")
    tie = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), no.alias("_source_no"), hash64(F.col(id_col)).alias("_hash"), F.col(id_col).alias("_own"), tie.alias("_tie"))
    ranked = gapless_rank(rows, "_source_no", [F.col("_hash"), F.col("_own").asc_nulls_first(), F.col("_tie")], "_place", total=sum(n for _, n in counted))
    placed = ranked.withColumn("_block", F.floor(F.col("_place") / block_rows).cast("long")).withColumn("_in_block", F.col("_place") % block_rows)
    out = placed.join(slots, (F.col("_source_no") == F.col("_s")) & (F.col("_block") == F.col("_k")))
    return out.select("row", F.col("_source_no").alias("source_no"), F.col("_block").alias("block_no"), F.col("_slot").alias("slot"), F.col("_in_block").alias("in_block"))


def interleaved(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` in mixed order, over range partitions, with their columns alone."""
    return mix(docs, **how).repartitionByRange("slot", "in_block").sortWithinPartitions("slot", "in_block").select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` with its block and slot: doc_id, source, block_no, slot, in_block."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("text"))  # the text only breaks ties
    mixed = mix(docs)
    return mixed.select("row.doc_id", "row.source", "block_no", "slot", "in_block")
