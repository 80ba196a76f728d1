"""op11: runs of words against a search of every stretch."""

import hashlib
import random
import zlib

import pytest

from quillmill.llm import periodic_runs as R


def brute(w):
    n, out = len(w), []
    for s in range(n):
        for e in range(s + 6, n + 1):
            q = next((q for q in range(1, (e - s) // 4 + 1) if all(w[i] == w[i + q] for i in range(s, e - q))), None)
            if q and (s == 0 or w[s - 1] != w[s - 1 + q]) and (e == n or w[e] != w[e - q]):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(seed, n=400):
    r = random.Random(seed)
    for _ in range(n):
        k, size = r.choice([1, 2, 2, 3, 5]), r.randrange(60)
        w = [r.randrange(k) for _ in range(size)]
        if r.random() < 0.6 and size > 8:
            p, a = r.randrange(1, 8), r.randrange(size)
            w = w[:a] + [w[a + (i - a) % min(p, size - a)] for i in range(a, size)]
            for _ in range(r.randrange(3)):
                w.insert(r.randrange(size), r.randrange(k))
        yield w


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_runs_equal_brute_force(seed):
    for w in made(seed):
        assert R.runs(w) == brute(w), w


def test_z_function():
    for w in made(5, 100):
        if w:
            assert R.z_function(w, len(w)) == [0] + [next((k for k in range(len(w) - i) if w[k] != w[i + k]), len(w) - i) for i in range(1, len(w))]


def test_long_texts():
    assert R.runs([0] * 200_000) == [(0, 200_000, 1)]
    assert R.runs([7, *[i % 3 for i in range(99_999)], 8]) == [(1, 99_999, 3)]
    assert R.runs(list(range(100_000)) * 2) == []
    assert R.runs(list(range(20_000)) * 4) == [(0, 80_000, 20_000)]


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t).hexdigest()
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_equals_the_contract(spark, tmp_path):
    r = random.Random(3)
    texts = [" ".join(f"é{x}" for x in w) for w in made(9, 150)] + [" ".join(f"w{r.randrange(9000)}" for _ in range(r.randrange(90))) for _ in range(150)]
    texts += [None, "", " \t\r\n", "a\x0ba\x0ca a\ta\na", "a a a a a", "a a a a a a a a a a a a"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "b b b b b b c", "x", 1), (4, texts[4], "x", 1), (4, texts[4], "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, start int").write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if not c.endswith("256")} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(d, t) for d, t, *_ in rows), key=repr)


def test_no_rows(spark):
    assert R.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_collapsed_text_keeps_one_period(spark):
    df = spark.createDataFrame([("k", "say no no no no no no more")], "name string, body string")
    row = R.periodic_runs(df, "name", "body").first()
    assert row["collapsed"] == "say no more" and [tuple(x) for x in row["runs"]] == [(1, 6, 1)] and row["n_words"] == 8
