"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the groups that its links form.

Two documents link when their shingle sets' Jaccard similarity is at least num/den. Steps:

1. Equal sets, known by 128 bits of digest, are one node, the row with the least row number (a number of
   our own, so ids may be null or repeated).
2. Who can link at all. A set of size n lacks at most n - T of its shingles in a partner, T being the
   overlap with the smallest partner. Each set posts the shingles below a bound of the hash space (`sampled`;
   a set that is unlucky posts all, too), so at least c = posted - (n - T) of these are in the partner as well. Shingles that
   no other node posts are left out; a node with fewer than c left links with nothing. Most stop here.
3. Neighbourhoods. In the order of rarity the first left - c + 1 of a node's postings hold one that the
   partner's first hold, too. Nodes that share such a one are a neighbourhood: components of a sparse
   graph with one edge for each posting, to the least node there. No pairs are made.
4. Each neighbourhood is searched by DivideSkip in one task: the required overlap of a query set of size n
   is T; its L longest lists are set aside, the short ones are merged with a heap, documents met T - L times
   are probed for in the long lists by binary search, and those that reach the exact overlap link. Members
   that are connected already are skipped.
5. A neighbourhood over `block` shingles is dealt over blocks, and some of its members (pivots) are in all
   of them: blocks of a large family join up through these. Then steps 2 and 3 are repeated for it with
   what is connected counted as one, so that shingles of one family alone fall out and the family with
   them. What is still over `block` after `ROUNDS` rounds is searched by all pairs of blocks: exact too.

A shingle that many documents hold is posted with its count from a table of the commonest (at most `HOT`,
counted in batches before any shuffle) and doesn't meet in one task.

Defined results: null text counts as empty; a text without words has an empty set, links with nothing and
is its own component; fewer words than `words` make one shingle. Rows with equal ids are nodes of their
own; a component's id is the smallest id of its rows, and null where these have none. Ties need no rule:
links are symmetric. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm.common import SMALL_ROWS, checkpoint, keep_rows, load, row_hash, small, stored
from quillmill.llm.components import components
from quillmill.llm.shingles import U, mix, shingle_sets

#: Most of the commonest postings whose counts are sent to every task.
HOT = 100_000
#: Rounds before all pairs of blocks are searched, and members of a neighbourhood that are in all its blocks.
ROUNDS, PIVOTS = 4, 16


def tier_of(n: int) -> int:
    """Sizes below 16 are tier 0; from there a tier's greatest size is four times its least."""
    return 0 if n < 16 else (n.bit_length() - 1) // 2 - 1


@lru_cache(maxsize=None)
def bound(tier: int, num: int, den: int) -> int:
    """Hashes up to this are posted: as many as may lack in a partner, and a margin, so that only a set with much in common with others stays."""
    share = 1.0 if tier == 0 else min(1.0, (den - num) / den + 0.07 + 1 / (4 ** (tier + 1)) ** 0.5)
    return (int(share * (1 << 32)) << 32) - 1


def sampled(own: np.ndarray, num: int, den: int) -> list[tuple[int, int, np.ndarray]]:
    """(tier, least number that a partner posts there as well, keys) of a sorted set of hashes.

    A set posts in its tier and, where it can link with a smaller size than that has, in the tier below;
    so two sets that can link share one. Tiers from 32 hold whole sets whose sample says nothing.
    """
    n = len(own)
    need = -(-num * n // den)
    tier, out = tier_of(n), []
    for t in (tier, tier - 1) if tier and need < 4 ** (tier + 1) else (tier,):
        part = own[: np.searchsorted(own, U(bound(t, num, den)), "right")]
        both = len(part) - (n - need)
        out.append((t, max(both, 1), mix(part + U(t + 1) * U(0x51ED270B0FF1CE))))
        if both < 1:
            out.append((t + 32, need, mix(own + U(t + 33) * U(0x51ED270B0FF1CE))))
    return out


_BASE = "_row long, _id long, _hash long, _n long, _a long, _b long, tiers array<struct<tier:int,least:int,keys:array<bigint>>>, hot array<struct<key:bigint,n:bigint>>"


def _sketches(words: int, num: int, den: int):
    """Rows of _BASE: sizes, digests and postings, and in a batch's first row the keys that many sets of the batch post."""

    def made(batch: pa.RecordBatch, n: list, digests: list, posts: list) -> pa.RecordBatch:
        flat = [p for own in posts for p in own]
        keys = np.concatenate([np.zeros(0, U), *(k for *_, k in flat)]).view(np.int64)
        edges = np.append(0, np.cumsum([len(k) for *_, k in flat], dtype=np.int64)).astype(np.int32)
        tiers = pa.StructArray.from_arrays(
            [pa.array([t for t, *_ in flat], pa.int32()), pa.array([c for _, c, _ in flat], pa.int32()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys))],
            ["tier", "least", "keys"])
        rows = np.append(0, np.cumsum([len(own) for own in posts], dtype=np.int64)).astype(np.int32)
        key, times = np.unique(keys, return_counts=True)
        many = times >= max(16, len(n) // 256)
        hot = pa.StructArray.from_arrays([pa.array(key[many]), pa.array(times[many].astype(np.int64))], ["key", "n"])
        at = np.full(len(n) + 1, len(hot), np.int32)
        at[0] = 0
        a, b = (pa.array([(d >> shift & (1 << 64) - 1) - (1 << 63) for d in digests], pa.int64()) for shift in (64, 0))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(n, pa.int64()), a, b, pa.ListArray.from_arrays(pa.array(rows, pa.int32()), tiers), pa.ListArray.from_arrays(pa.array(at, pa.int32()), hot)],
            ["_row", "_id", "_hash", "_n", "_a", "_b", "tiers", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            begun, held, n, digests, posts = 0, 0, [], [], []
            for i, own in enumerate(shingle_sets(batch.column(3), words)):
                n.append(len(own))
                digests.append(xxhash.xxh3_128_intdigest(own.tobytes()))
                posts.append(sampled(own, num, den) if len(own) else [])
                held += len(own)
                if held > 1 << 21 or i + 1 == len(batch):
                    yield made(batch.slice(begun, i + 1 - begun), n, digests, posts)
                    begun, held, n, digests, posts = i + 1, 0, [], [], []

    return run


#: Runs that are merged at a time, and candidates that are probed one by one.
WAYS, FEW = 16, 16


def merged(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in sorted runs without repeats, and how many runs hold each: from a heap the shortest runs are merged."""
    heap = [(len(r), i, r, np.ones(len(r), np.int64)) for i, r in enumerate(runs)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        part = [heapq.heappop(heap) for _ in range(min(WAYS, len(heap)))]
        y, met = np.concatenate([p[2] for p in part]), np.concatenate([p[3] for p in part])
        at = np.argsort(y, kind="stable")
        y = y[at]
        new = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
        y, met = y[new], np.add.reduceat(met[at], new)
        heapq.heappush(heap, (len(y), made, y, met))
        made += 1
    return heap[0][2], heap[0][3]


def divide_skip(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
    """The smallest id of each member's component by links; `side` (0 or 1): only links across, or all where None.

    Members that are equal in `known` are connected from the start.
    """
    order = np.lexsort((ids, [len(s) for s in sets]))
    sets, ids = [sets[i] for i in order], ids[order]
    side = None if side is None else side[order]
    m, size = len(sets), np.array([len(s) for s in sets])
    start = np.append(0, np.cumsum(size))
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    posted = array("q", owner[np.argsort(token, kind="stable")].tobytes())  # inverted lists, one after another
    view = np.frombuffer(posted, np.int64)
    at = np.append(0, np.cumsum(df))
    label, members = np.arange(m), {i: [i] for i in range(m)}
    if known is not None:
        _, lead, group = np.unique(known[order], return_index=True, return_inverse=True)
        label, members = lead[group], {}
        for i, k in enumerate(label.tolist()):
            members.setdefault(k, []).append(i)

    def unite(x: int, y: int) -> None:
        keep, gone = label[x], label[y]
        if len(members[keep]) < len(members[gone]):
            keep, gone = gone, keep
        label[members[gone]] = keep
        members[keep] += members.pop(gone)

    for x in range(1, m):
        n = int(size[x])
        need = -(-num * n // den)  # T: overlap with the smallest partner that can link
        least = int(np.searchsorted(size, need))  # smaller sets can't link
        lists = token[start[x] : start[x + 1]]
        lists = lists[np.argsort(df[lists], kind="stable")]
        aside = max(0, need - 3)  # L
        short, long = lists[: n - aside], lists[n - aside :]
        runs = []
        for t in short:
            if df[t] > 1:
                run = view[at[t] : at[t + 1]]
                run = run[np.searchsorted(run, least) : np.searchsorted(run, x)]
                run = run[label[run] != label[x]]
                if side is not None:
                    run = run[side[run] != side[x]]
                if len(run):
                    runs.append(run)
        if len(runs) < need - aside:
            continue
        y, met = merged(runs)
        y, met = y[met >= need - aside], met[met >= need - aside]
        best = np.argsort(-met, kind="stable")
        y, met = y[best], met[best]
        enough = -(-num * (n + size[y]) // (num + den))

        def probe(first: int, last: int, done: int) -> None:
            for z, have, want in zip(y[first:last].tolist(), met[first:last].tolist(), enough[first:last].tolist(), strict=True):
                if label[x] == label[z]:
                    continue
                left = len(long) - done
                for t in long[done:]:
                    if have >= want or have + left < want:
                        break
                    left -= 1
                    low, high = int(at[t]), int(at[t + 1])
                    p = bisect_left(posted, z, low, high)
                    have += p < high and posted[p] == z
                if have >= want:
                    unite(x, z)

        probe(0, FEW, 0)
        y, met, enough = y[FEW:], met[FEW:], enough[FEW:]
        new = label[y] != label[x]
        y, met, enough = y[new], met[new], enough[new]
        # Many candidates are probed together, until few are left.
        done = 0
        while len(y) > FEW and done < len(long):
            own = view[at[long[done]] : at[long[done] + 1]]
            p = np.searchsorted(own, y)
            met += own[np.minimum(p, len(own) - 1)] == y
            done += 1
            able = met + len(long) - done >= enough
            y, met, enough = y[able], met[able], enough[able]
        probe(0, len(y), done)
    root = np.empty(m, np.int64)
    for own in members.values():
        root[own] = ids[own].min()
    out = np.empty(m, np.int64)
    out[order] = root
    return out


def _search(num: int, den: int):
    """Links (a, b) inside each group of (key, row, label, side, own), whose rows come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            key, found = None, []
            for batch in batches:
                for k, *member in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                    if k != key and found:
                        yield found
                        found = []
                    key = k
                    found.append((*member[:3], np.frombuffer(member[3], U)))
            if found:
                yield found

        for found in groups():
            if len(found) == 1:
                continue
            own, known, sides = (np.array([m[i] for m in found], np.int64) for i in range(3))
            root = divide_skip(own, [m[3] for m in found], num, den, sides if len(np.unique(sides)) > 1 else None, known)
            linked = root != own
            yield pa.RecordBatch.from_pydict({"a": pa.array(own[linked]), "b": pa.array(root[linked])})

    return run


def _sets(words: int):
    """The rows with the text, their last column, as the bytes of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                own = [s.tobytes() for s in shingle_sets(part.column(part.num_columns - 1), words)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(own, pa.binary())], [*part.schema.names[:-1], "own"])

    return run


def _able(postings: DataFrame) -> DataFrame:
    """Of (at, least, key, df), postings that others share: the nodes that have enough, with these by rarity; stored."""
    held = postings.groupBy("at").agg(F.first("least").alias("least"), F.sort_array(F.collect_list(F.struct("df", "key"))).alias("own"))
    return stored(held.where("size(own) >= least"))


def _shared(able: DataFrame, labels: DataFrame | None) -> DataFrame:
    """_able again, over the nodes that were; shingles of one label alone (of one node where None) fall out."""
    node = F.shiftright("at", 6)
    posts = able.select("at", "least", F.explode("own.key").alias("key"), node.alias("label"))
    if labels is not None:
        known = labels.select(F.col("node").alias("label"), "root")
        posts = posts.join(known, "label", "left").select("at", "least", "key", F.coalesce("root", "label").alias("label"))
    kept = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return _able(posts.join(kept.select("key", "df"), "key").select("at", "least", "key", "df"))


def _neighbourhoods(able: DataFrame) -> DataFrame:
    first = able.select(F.shiftright("at", 6).alias("a"), F.explode(F.slice("own", F.lit(1), F.size("own") - F.col("least") + 1)).alias("p")).select("a", F.col("p.key").alias("key"))
    hubs = first.groupBy("key").agg(F.min("a").alias("b"), F.max("a").alias("other")).where("b <> other").select("key", "b")
    return components(first.join(hubs, "key").where("a <> b").select("a", "b"))


def _dealt(members: DataFrame, block: int, last: bool, turn: int) -> tuple[DataFrame, DataFrame]:
    """(members with the places of each: block pairs and sides; members of neighbourhoods that aren't settled thereby)."""
    hoods = members.groupBy("root").agg(F.ceil(F.sum("_n") / F.lit(block)).cast("int").alias("blocks"))
    sized = checkpoint(members.join(hoods, "root"))
    large = sized.where("blocks > 1")
    spread = F.xxhash64("_row", F.lit(turn))
    mine = F.pmod(spread, F.col("blocks")).cast("int")
    place = lambda low, high, side: F.struct(low.alias("low"), high.alias("high"), side.alias("side"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    if last:
        # A member of block i is in all pairs (i, j) of blocks, as side 0 where it is the lower.
        places = F.transform(every, lambda j: place(F.least(mine, j), F.greatest(mine, j), F.when(mine <= j, 0).otherwise(1)))
        return sized.withColumn("places", places), large.limit(0)
    lead = large.where(F.col("_n") * 4 * PIVOTS <= block).withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(spread))).where(F.col("rank") <= PIVOTS)
    pivots = lead.select(F.col("_row").alias("pivot"))
    placed = sized.join(pivots, F.col("_row") == F.col("pivot"), "left")
    places = F.when(F.col("pivot").isNull(), F.array(place(mine, mine, F.lit(0)))).otherwise(F.transform(every, lambda j: place(j, j, F.lit(0))))
    return placed.withColumn("places", places), large


def _linked(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows: _row, _id, _hash, _n, _a, _b; groups of rows with words: _n, _a, _b, root)."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), row_hash(F.col(text_col)).alias("_hash"), F.col(text_col).alias("_text"))
    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_hash", "_text")
    base = stored(numbered.mapInArrow(_sketches(words, num, den), _BASE))
    sized = base.select("_row", "_id", "_hash", "_n", "_a", "_b")
    filled = sized.where("_n > 0")
    named = stored(filled.groupBy("_n", "_a", "_b").agg(F.min("_row").alias("node")))
    copies = filled.join(named.select("node"), F.col("_row") == F.col("node"), "left_anti").select(F.col("_row").alias("copy"))
    if filled.count() - named.count() <= SMALL_ROWS:
        nodes = base.join(F.broadcast(copies), F.col("_row") == F.col("copy"), "left_anti")
    else:
        nodes = base.join(named.select("node"), F.col("_row") == F.col("node"), "left_semi")

    posts = nodes.select("_row", F.inline("tiers")).select((F.shiftleft("_row", 6) + F.col("tier")).alias("at"), "least", F.explode("keys").alias("key"))
    hot = base.select(F.inline("hot")).groupBy("key").agg(F.sum("n").alias("df")).orderBy(F.desc("df"), "key").limit(HOT)
    # Postings of the commonest keys are dealt by node: their counts are known.
    dealt = posts.join(F.broadcast(hot), "key", "left").withColumn("place", F.when(F.col("df").isNull(), F.col("key")).otherwise(F.col("at")))
    counted = dealt.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("place"))).select("at", "least", "key", F.coalesce("df", "n").alias("df"))
    able = _shared(_able(counted.where("df > 1")), None)

    found, labels, turn = None, None, 0
    while True:
        last = turn == ROUNDS
        around = _neighbourhoods(able)
        members = around.join(sized, F.col("node") == F.col("_row")).select("_row", "_id", "_hash", "_n", "root")
        placed, open_ = _dealt(members, block, last, turn)
        if labels is not None:
            known = labels.select("node", F.col("root").alias("label"))
            placed = placed.join(known, F.col("_row") == F.col("node"), "left")
        label = F.col("_row") if labels is None else F.coalesce("label", "_row")
        wanted = small(checkpoint(placed.select("_row", F.col("_id").alias("_own"), F.col("_hash").alias("_h"), label.alias("label"), "root", "places")))
        texts = rows.join(wanted, (F.col("_hash") == F.col("_h")) & F.col("_id").eqNullSafe(F.col("_own"))).select("_row", "label", "root", "places", "_text")
        if not wanted.join(sized, (F.col("_hash") == F.col("_h")) & F.col("_id").eqNullSafe(F.col("_own"))).groupBy("_h", "_own").count().where("count > 1").isEmpty():
            texts = texts.dropDuplicates(["_row"])  # rows that share id and text
        kinds = "_row long, label long, root long, places array<struct<low:int,high:int,side:int>>, own binary"
        sets = texts.mapInArrow(_sets(words), kinds).select("_row", "label", "root", "own", F.inline("places"))
        by = ["root", "low", "high"]
        keyed = sets.repartition(*by).sortWithinPartitions(*by)
        links = checkpoint(keyed.select(F.concat_ws("|", *by).alias("key"), "_row", "label", "side", "own").mapInArrow(_search(num, den), "a long, b long"))
        found = links if found is None else found.unionByName(links)
        if last or open_.isEmpty():
            break
        labels = components(found)
        left = open_.select(F.col("_row").alias("open"))
        able = _shared(able.join(small(left), F.shiftright("at", 6) == F.col("open"), "left_semi"), labels)
        turn += 1
    joined = components(found)
    groups = named.join(joined.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("_n", "_a", "_b", F.coalesce("root", "node").alias("root"))
    return sized, stored(groups)


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = 2_000_000) -> DataFrame:
    """One row per row of `docs`: the id, n_shingles, component_id (smallest id reachable by links)."""
    sized, groups = _linked(docs, words, num, den, id_col, text_col, block)
    by = ["_n", "_a", "_b"]
    least = sized.where("_n > 0").groupBy(*by).agg(F.min("_id").alias("least")).join(groups, by)
    ids = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(*by, "component_id")
    out = sized.join(ids, by, "left")
    named = F.when(F.col("_n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), named.alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = 2_000_000) -> DataFrame:
    """The rows of `docs` that stay, with their columns: of each component one row, with its smallest id (null last).

    Rows without words all stay.
    """
    sized, groups = _linked(docs, words, num, den, id_col, text_col, block)
    rows = sized.join(groups, ["_n", "_a", "_b"])
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    stays = rows.groupBy("root").agg(F.min(order).alias("stays"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    decided = rows.join(stays, "root").select("_id", "_hash", (order == F.col("stays")).alias("_keep"))
    return keep_rows(docs, checkpoint(decided), id_col, text_col)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result over all of `documents`: three words, 0.9."""
    return jaccard_components(load(spark, sf_dir, "documents"), words=3, num=90, den=100)
