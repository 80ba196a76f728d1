"""The versioned fold of a stream against a replay, its changes fed in three orders."""

import datetime
import random
import uuid

import pytest

from quillmill.streaming import cases as C
from quillmill.streaming import folds

START = datetime.datetime(2024, 1, 1)


def made(n=240):
    r = random.Random(4)
    out = []
    for i in range(n):
        action = r.choice(["set"] * 6 + ["lock", "unlock", "jump"])
        out.append((f"c{r.randrange(6)}", START + datetime.timedelta(minutes=r.randrange(600)), i, action, r.choice(["/a", "/a/b", "/c"]), r.choice(["x", "y", None]), r.choice([None, None, None, r.randrange(6)])))
    return sorted(out, key=lambda x: (x[1], x[2]))


def test_rules():
    case = C.replayed([(1, 1, "set", "/a/b", "x", None), (2, 1, "lock", "/a", None, 1), (3, 1, "set", "/a/b", "y", None), (4, 1, "set", "/ab", "z", 9), (5, 1, "set", "/ab", "z", 2), (6, 1, "unlock", "/a", None, None), (7, 1, "set", "/a", "w", None)])
    assert case.stored == (5, 2, '{"/a": "w", "/ab": "z"}', "[]")


@pytest.mark.parametrize("order", ["in order", "backwards in each file", "shuffled within the allowed lateness"])
def test_stream_equals_replay_in_any_order(spark, tmp_path, order):
    changes = made()
    size = 40
    files = [changes[i : i + size] for i in range(0, len(changes), size)]
    if order.startswith("back"):
        files = [f[::-1] for f in files]
    elif order.startswith("shuffled"):
        r = random.Random(1)
        whole = sorted(changes, key=lambda c: c[1] + datetime.timedelta(minutes=r.randrange(100)))
        files = [whole[i : i + size] for i in range(0, len(whole), size)]
    # A last change far ahead lets the watermark pass all others.
    files.append([("end", START + datetime.timedelta(days=9), 10_000, "set", "/a", "x", None)])
    files.append([("end", START + datetime.timedelta(days=10), 10_001, "set", "/a", "y", None)])
    folder = tmp_path / "in"
    for k, f in enumerate(files):
        spark.createDataFrame(f, C.CHANGES).coalesce(1).write.mode("append").parquet(str(folder / f"events{k}.parquet"))
    stream = spark.readStream.schema(C.CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(folder))
    out = folds.drained(C.fold(stream, "2 hours"), "update", f"file://{tmp_path}/{uuid.uuid4().hex}")
    got = sorted(map(tuple, C.last_of(out).where("case_id <> 'end'").collect()))
    want = sorted(map(tuple, C.replay(spark.createDataFrame(changes, C.CHANGES)).collect()))
    assert got == want and len(want) == 6 and any(w[2] for w in want)
    plain = {c: C.replayed((int(t.timestamp() * 1e6), i, a, p, v, e) for k, t, i, a, p, v, e in changes if k == c).stored for c in {x[0] for x in changes}}
    assert {w[0]: w[1:] for w in want} == plain
