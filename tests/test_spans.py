"""Finding and folding spans: against plain versions, and on texts of ten megabytes."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import detectors as D
from quillmill.operators import spans as S

PATTERNS = [*[p for p, _ in S.PII.values()], *[d.pattern for d in D.DETECTORS if not d.group]]


def test_found_as_the_patterns_find():
    r = random.Random(0)
    for _ in range(4000):
        t = "".join(r.choice(["a", "b.", "@", ".", "co", "_", "-", "é", " ", "1", "555", "A", "%"]) for _ in range(r.randrange(30)))
        for p in PATTERNS:
            assert list(S.spans_in(t, S.Detector("", p, 1.0))) == [m.span() for m in re.finditer(p, t, re.ASCII)], (p, t)


def pairwise(spans):
    """The rules of best_of, case by case."""
    pattern = lambda s: str(s["source"] or "").startswith("regex_")
    score = lambda s: s["score"] or 0
    out = []
    for s in sorted(spans, key=lambda s: (s["start"], 0 if pattern(s) else 1, -score(s))):
        if not out or not (out[-1]["start"] <= s["end"] and s["start"] <= out[-1]["end"]):
            out.append(dict(s))
            continue
        last = out[-1]
        common = min(last["end"], s["end"]) - max(last["start"], s["start"])
        union = {"start": min(last["start"], s["start"]), "end": max(last["end"], s["end"]), "score": max(score(last), score(s))}
        if common > 0 and (pattern(last) or pattern(s)):
            one = last if pattern(last) else s
            out[-1] = {**one, **union} if last["label"] == s["label"] else dict(one)
        elif last["label"] == s["label"]:
            out[-1] = {**last, **union, "source": last["source"] or s["source"]}
        elif max(common, 0) / min(max(1, last["end"] - last["start"]), max(1, s["end"] - s["start"])) >= 0.8:
            if score(s) > score(last):
                out[-1] = dict(s)
        else:
            out.append(dict(s))
    return out


def spans_of(r, n, most):
    for _ in range(n):
        a = r.randrange(most)
        yield (a, a + r.randrange(12), r.choice(["NAME", "DATE", "ID"]), r.choice([None, 0.5, 0.8, 0.9]), r.choice([None, "ml", "regex_a", "regex_b"]))


def test_best_of_on_random_spans(spark):
    r = random.Random(7)
    rows = [(i, list(spans_of(r, r.randrange(14), 40))) for i in range(400)] + [(400, []), (401, None)]
    df = spark.createDataFrame(rows, "i int, s array<struct<start:int,end:int,label:string,score:double,source:string>>")
    keys = list(S.LABELLED)
    for x in df.select("i", S.merged_best_of(F.col("s")).alias("m"), S.deduped(F.col("s")).alias("d"), S.deduped(F.col("s"), by_source=False).alias("e")).collect():
        spans = rows[x.i][1]
        if spans is None:
            assert x.m is x.d is x.e is None
            continue
        assert [tuple(m) for m in x.m] == [tuple(m[k] for k in keys) for m in pairwise([dict(zip(keys, s, strict=True)) for s in spans])]
        assert [tuple(m) for m in x.d] == [s for k, s in enumerate(spans) if not any((*s[:3], s[4] or "") == (*z[:3], z[4] or "") for z in spans[:k])]
        firsts = [s for k, s in enumerate(spans) if s[:3] not in [z[:3] for z in spans[:k]]]
        assert [tuple(m) for m in x.e] == [max((z for z in spans if z[:3] == s[:3]), key=lambda z: (z[3] or 0, (z[4] or "").startswith("regex_"))) for s in firsts]


def test_a_hundred_thousand_spans_in_a_second():
    spans = list(spans_of(random.Random(1), 100_000, 1_000_000))
    for f in (S.best_of, S.first_of_equals, S.best_of_equals):
        began = time.process_time()
        f(spans)
        assert time.process_time() - began < 1


@pytest.mark.parametrize("text", ["a" * 10_000_000, "a@b.co " * 1_400_000, "<" * 10_000_000, "a." * 5_000_000 + "@", "555-123-4567 " * 770_000], ids=["word", "addresses", "open", "dots", "phones"])
def test_ten_megabytes(spark, text):
    df = spark.createDataFrame([(1, text)], "i int, t string")
    began = time.time()
    n = S.find(df, "t", S.PII, ["i"]).count()
    assert n == len(re.findall("@b|555", text))
    df.select(T.strip_tags(F.col("t")).alias("x")).agg(F.sum(F.length("x"))).first()
    assert time.time() - began < 20


def test_strip_tags_as_by_pattern(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["<", ">", "a", " ", "<b>", "</script>", "<script>", "\n"]) for _ in range(r.randrange(20))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for x in df.select("t", T.strip_tags(F.col("t")).alias("got")).collect():
        if x.t is None:
            assert x.got is None
        else:
            t = re.sub(r"(?is)<script.*?</script>|<style.*?</style>", " ", x.t)
            assert x.got == re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", t)).strip()
