"""Files told apart by content, and walks through any JSON."""

import json
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from quillmill.functions import json_docs as J
from quillmill.sources import note_files as N


def test_formats(spark, tmp_path):
    files = {
        "a.bin": '{"id":"1","prompt":" p "}\n\n{"id":2,"text":"t","note_text":""}\nnot json\n', "b.bin": json.dumps({"cases": [{"id": "c", "text": "x"}, 5]}), "c.bin": json.dumps([{"note_id": "n", "note_text": "é"}, "s"]), "d.bin": json.dumps({"data": [{"text": "d"}], "more": 1}),
        "e.bin": "Plain note\n{not json}\n", "f.bin": "  \n", "g.bin": json.dumps({"text": "only"}, indent=1), "sub/h.bin": json.dumps({"records": [], "cases": None}), "i.bin": '{"id":"one"}', "j.bin": "﻿[]"}
    (tmp_path / "sub").mkdir()
    for name, content in files.items():
        (tmp_path / name).write_text(content, encoding="utf-8")
    (tmp_path / "k.bin").write_bytes(b"\xff bad")
    got = sorted((r.path.rpartition("/")[2], r.format, r.place, r.id, r.text) for r in N.note_files(spark, str(tmp_path)).collect())
    assert got == [
        ("a.bin", "json_lines", 0, "1", "p"), ("a.bin", "json_lines", 1, "2", "t"), ("b.bin", "cases", 0, "c", "x"), ("c.bin", "entries", 0, "n", "é"), ("d.bin", "entries", 0, None, "d"), ("e.bin", "text", 0, None, "Plain note\n{not json}\n"),
        ("g.bin", "object", 0, None, "only"), ("i.bin", "json_lines", 0, "one", None), ("k.bin", "text", 0, None, "� bad")]
    plan = N.note_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "length" not in plan.split("ReadSchema")[-1] and "modificationTime" not in plan.split("ReadSchema")[-1]


def test_json_lines_are_not_held_together():
    content = "\n".join(json.dumps({"id": str(i), "text": f"note {i} " * 400}) for i in range(4000)).encode()
    batch = pa.RecordBatch.from_pydict({"path": ["a"], "content": pa.array([content], pa.binary())})
    tracemalloc.start()
    rows = sum(part.num_rows for part in N._parse(N.TEXT_FIELDS, N.ID_FIELDS)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4000 and peak < 2.5 * len(content)


def test_walks(spark):
    rows = [('{"31652":{"x":[" j1234 ",31653,31653.0,"+31654","code 31655",true,null,"316561"]},"k":-31657}',), ("[]",), ("no",), (None,)]
    got = [r.c for r in spark.createDataFrame(rows, "j string").select(J.codes_anywhere(F.col("j")).alias("c")).collect()]
    assert got == [["+31654", "31652", "31653", "J1234"], [], None, None]
    doc = '{"note":"call 555 now","code":"555","deep":[{"note":"555 555","n":555},"555 and more"],"s":"555!"}'
    df = spark.createDataFrame([(doc,), ("x",)], "j string")
    assert [r.c for r in df.select(J.json_redacted(F.col("j"), {"NUM": "5+"}, ["note"]).alias("c")).collect()] == ['{"note":"call [NUM] now","code":"555","deep":[{"note":"[NUM] [NUM]","n":555},"555 and more"],"s":"555!"}', None]
    assert df.select(J.json_redacted(F.col("j"), {"NUM": "5+"}).alias("c")).first().c == '{"note":"call [NUM] now","code":"555","deep":[{"note":"[NUM] [NUM]","n":555},"555 and more"],"s":"[NUM]!"}'
