"""Clinical values on edge cases, and the detectors against a plain search."""

import re

import pytest
from pyspark.sql import functions as F

from quillmill.functions import clinical as C
from quillmill.operators import detectors as D


def values(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r.v) if isinstance(r.v, tuple) else r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(("f", "cases"), [
    (C.sizes_mm, {"3 x 2.5 x 1 cm": (30, 25, 10), "4x5x6": (4, 5, 6), "2.5 mm": (2, None, None), "3 × 4 mm": (3, 4, None), "3 x 4": (None, None, None), "": (None,) * 3, None: (None,) * 3}),
    (C.response, {"new lesion, regression": "Mixed", "enlarging": "Progression", "Resolved": "Response", "similar": "Stable", None: "Indeterminate"}),
    (C.change, {"new and stable": "New", "reduced": "Decreased", "nothing": None, None: None}),
    (C.agreed_suv, {"SUV 2.4, SUVmax: 2.4": 2.4, "SUV 2 and SUV 3": None, "SUV 400": None, None: None}),
    (C.iso_date, {"2/30/2020": None, "2/29/2020": "2020-02-29", "1-2-68": "2068-01-02", "1-2-69": "1969-01-02", "Sep 3, 2019": "2019-09-03", "3 september 2019": "2019-09-03", "2020-13-01": None, "x 3Nov2017": "2017-11-03", None: None, "": None}),
    (C.station, {"station 7": "7", "lymph 7": None, "7": "7", "11rs": "11RS", "4Rs": "4R", "14R": None, None: None}),
    (C.procedure_codes, {"31652, 31652-26 x 31652": ["31652", "31652-26"], "316522": None, None: None}),
    (C.bare_code, {" +31652 ": "31652", "++31652": None, "3165": None, None: None}),
    (C.list_items, {" a, ,b ": ["a", "b"], " , ": None, None: None}),
    (C.clock_time, {"930": "09:30", "12:00 am": "00:00", "12:00 PM": "12:00", "24:00": None, "9:60": None, "13:00 pm": "13:00", "9": None, None: None}),
    (C.minutes_of_day, {"1:05": 65, "24:00": None, "8:30:59": 510, "8": None, None: None}),
])
def test_values(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_arrays(spark):
    df = spark.createDataFrame([(["7", " 4r", "zz", "2R", "4R", "", None], [("4R", "Benign"), ("7", "Nondiagnostic"), ("", "x")]), ([], []), (None, [("7", "Benign"), ("4L", "Suspicious, Malignant")])], "s array<string>, d array<struct<station:string,result:string>>")
    got = df.select(C.sorted_stations(F.col("s")).alias("s"), C.overall_result(F.col("d")).alias("d")).collect()
    assert [r.s for r in got] == [["2R", "4R", "7", "ZZ"], [], None]
    assert [r.d for r in got] == ["Mixed (4R Benign; 7 Nondiagnostic)", None, "Malignant"]


TEXTS = [
    "DOB: 01/02/1960, MRN# AB-12345; call (555) 123-4567 ext 12 or 555.123.4567", "SSN 123456789 and 123-45-6789, 2020-01-02", "mail é.x@a.org, https://a.org/x?y at 10.0.0.255 and 256.1.1.1",
    "Account No. 99-1234 on March 3, 2020 March 4 2021", "1/2/20 1/3/20", "nothing here", "", None, "😀 MRN 12345 😀 a@b.co", "word " * 20_000 + "a@b.co"]


def test_detectors(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r.i: (r.all, r.merged) for r in df.select("i", D.detect(F.col("t")).alias("all"), D.merge_strongest(D.detect(F.col("t"))).alias("merged")).collect()}
    for i, t in enumerate(TEXTS):
        found = sorted(((*m.span(d.group), d.type, d.confidence) for d in D.DETECTORS for m in re.finditer(d.pattern, t or "", re.ASCII)), key=lambda s: (s[0], -s[1]))
        assert sorted(map(tuple, got[i][0] or [])) == sorted(found)
        merged = []
        for s in found:
            if not merged or s[0] > merged[-1][1]:
                merged.append(s)
                continue
            key = lambda x: (x[3], D.PRIORITY[x[2]], x[1] - x[0])
            best = s if key(s) > key(merged[-1]) else merged[-1]
            merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]), best[2], max(merged[-1][3], s[3]))
        assert list(map(tuple, got[i][1] or [])) == merged
