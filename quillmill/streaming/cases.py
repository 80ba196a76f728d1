"""Versioned cases folded from a stream of changes: locks by path, expected versions, events that come late.

A change sets, locks or unlocks a path of a case. Locked paths, and all below them, refuse changes; a change that
expects another version than the case has is refused, too. What is refused is counted and changes nothing.

Changes are applied in the order of their time and id, whatever order they come in: each waits in the state of its case's bucket
until the watermark has passed it, and a timer wakes the bucket when that is due. So a state holds its cases' values and what
the watermark still allows to be out of order, and nothing is kept by the driver. Changes later than the watermark are
dropped, as in any stream; null cases, times and paths are, too.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGES = "case_id string, at timestamp, change_id long, action string, path string, value string, expected long"
CASES = "case_id string, version long, refused long, record string, locks string"
_STATE = "known string, waiting string, first long"


class Case:
    """Values and locks by path, the version and the number of refused changes."""

    def __init__(self, version: int = 0, refused: int = 0, record: str = "{}", locks: str = "[]"):
        self.version, self.refused, self.values, self.locks = version, refused, json.loads(record), set(json.loads(locks))

    def locked(self, path: str) -> bool:
        return any(path == k or path.startswith(k + "/") for k in self.locks)

    def apply(self, action: str, path: str, value: str | None, expected: int | None) -> None:
        if (expected is not None and expected != self.version) or (action == "set" and self.locked(path)) or action not in ("set", "lock", "unlock"):
            self.refused += 1
            return
        if action == "set":
            self.values = {k: v for k, v in self.values.items() if not k.startswith(path + "/")}
            self.values[path] = value
        elif action == "lock":
            self.locks.add(path)
        else:
            self.locks.discard(path)
        self.version += 1

    @property
    def stored(self) -> tuple[int, int, str, str]:
        return self.version, self.refused, json.dumps(self.values, sort_keys=True), json.dumps(sorted(self.locks))


def replayed(changes: Iterable[tuple]) -> Case:
    """The case after changes (micros, id, action, path, value, expected), in the order of the first two."""
    case = Case()
    for _, _, *change in sorted(changes, key=lambda c: c[:2]):
        case.apply(*change)
    return case


def _change(text: list) -> tuple:
    case, t, i, action, path, value, expected = text
    return case, int(t), int(i), action, path, value, None if expected is None else int(expected)


def fold(changes: DataFrame, late: str, buckets: int = 1 << 14) -> DataFrame:
    """A stream of CHANGES as a stream of CASES: a row for a case whenever the watermark settles changes of it.

    Cases share `buckets` states by a hash of their ids, since a call of Python for each case costs more than its changes do;
    with cases beyond some millions more buckets keep a state small. A change comes as one JSON text, which waits
    there as it came and is read once some change of its bucket is due.
    """
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, waiting, first = state.get if state.exists else ("{}", "", None)
        parts = [waiting] if waiting else []
        for rows in batches:
            if len(rows):
                parts += rows["change"].tolist()
                least = int(rows["micros"].to_numpy().min())
                first = least if first is None else min(first, least)
        waiting, upto = ",".join(parts), state.getCurrentWatermarkMs() * 1000
        out = []
        if first is not None and first < upto:
            stored, every, due = json.loads(known), [_change(x) for x in json.loads(f"[{waiting}]")], {}
            for case, *change in sorted((w for w in every if w[1] < upto), key=lambda w: w[:3]):
                if case not in due:
                    due[case] = Case(*stored.get(case, ()))
                due[case].apply(*change[2:])
            out = [(k, *c.stored) for k, c in due.items()]
            stored |= {k: own for k, *own in out}
            left = [w for w in every if w[1] >= upto]
            known, waiting, first = json.dumps(stored), json.dumps(left)[1:-1], min((w[1] for w in left), default=None)
        state.update((known, waiting, first))
        if first is not None:
            state.setTimeoutTimestamp(max(first // 1000, upto // 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["case_id", "version", "refused", "record", "locks"])

    whole = changes.where("case_id IS NOT NULL AND at IS NOT NULL AND path IS NOT NULL AND change_id IS NOT NULL").withWatermark("at", late)
    micros = F.unix_micros("at")
    text = F.to_json(F.array("case_id", micros.cast("string"), F.col("change_id").cast("string"), "action", "path", "value", F.col("expected").cast("string")))
    packed = whole.select(F.pmod(F.xxhash64("case_id"), F.lit(buckets)).alias("bucket"), "at", micros.alias("micros"), text.alias("change"))
    return packed.groupBy("bucket").applyInPandasWithState(step, CASES, _STATE, "update", "EventTimeTimeout")


def replay(changes: DataFrame) -> DataFrame:
    """The same of a table: each case's last row of CASES once all its changes are settled. A case's changes meet in one task, as they do in its state."""
    import pandas as pd

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        micros = rows["at"].astype("datetime64[us]").astype("int64")
        case = replayed((int(t), int(i), a, p, v, None if pd.isna(e) else int(e)) for t, i, a, p, v, e in zip(micros, rows["change_id"], rows["action"], rows["path"], rows["value"], rows["expected"], strict=True))
        return pd.DataFrame([(key[0], *case.stored)], columns=["case_id", "version", "refused", "record", "locks"])

    whole = changes.where("case_id IS NOT NULL AND at IS NOT NULL AND path IS NOT NULL AND change_id IS NOT NULL")
    return whole.groupBy("case_id").applyInPandas(one, CASES)


def last_of(cases: DataFrame) -> DataFrame:
    """Of a drained stream of CASES each case's last row."""
    last = cases.groupBy("case_id").agg(F.max_by(F.struct("version", "refused", "record", "locks"), F.col("version") + F.col("refused")).alias("_last"))
    return last.select("case_id", "_last.*")
