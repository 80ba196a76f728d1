"""Cases that share a state, in a stream of several batches."""

import datetime
import uuid

from quillmill.streaming import cases as C
from quillmill.streaming import folds

START = datetime.datetime(2024, 1, 1)


def test_cases_that_share_a_state_stay_apart(spark, tmp_path):
    at = lambda m: START + datetime.timedelta(minutes=m)
    names = ["a", 'b"]', "c,\\", "d\u20ac"]
    changes = [(n, at(7 * i + j), 10 * i + j, action, "/x", f"{n}{j}", None) for i, n in enumerate(names) for j, action in enumerate(["set", "lock", "set", "unlock", "set"])]
    files = [changes[::-1], [("a", at(90), 100, "set", "/y", None, 4), ("end", at(9000), 1000, "set", "/x", "z", None)], [("end", at(10000), 1001, "set", "/x", "z", None)]]
    for k, f in enumerate(files):
        spark.createDataFrame(f, C.CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"events{k}.parquet"))
    stream = spark.readStream.schema(C.CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = folds.drained(C.fold(stream, "2 hours", buckets=1), "update", f"file://{tmp_path}/{uuid.uuid4().hex}")
    got = sorted(map(tuple, C.last_of(out).where("case_id <> 'end'").collect()))
    want = sorted(map(tuple, C.replay(spark.createDataFrame([c for f in files for c in f if c[0] != "end"], C.CHANGES)).collect()))
    assert got == want and [w[0] for w in want] == sorted(names) and want[0][1:3] == (5, 1)
