"""op12: mined URL rules against a search of all combinations of tokens."""

import itertools
import random
import re

from pyspark.sql import functions as F

from quillmill.llm import url_filter as U

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return m[1].translate(LOWER), m[2]


def listed(url):
    h, p = split(url)
    fits = [(len(a + b), a + b, v) for v, a, b in U.LIST if (h == a or h.endswith("." + a)) and p.startswith(b)]
    return max(fits)[1:] if fits else (None, None)


def expected(urls, tokens, support, confidence):
    """Verdict and tokens of the best mined rule for each URL, by counting every combination."""
    labelled = [(frozenset(t), listed(u)[1]) for u, t in zip(urls, tokens, strict=True) if listed(u)[0]]
    count = {}
    for t, v in labelled:
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), k):
                for key in ((c, None), (c, v)):
                    count[key] = count.get(key, 0) + 1
    sure = [(-n / count[c, None], -n / len(labelled), len(c), v != "block", c, v) for (c, v), n in count.items() if v and n >= support * len(labelled) and n / count[c, None] >= confidence]
    best = [min((r for r in sure if set(r[4]) <= set(t)), default=None) for t in tokens]
    return [(listed(u)[1] or (b[5] if b else "allow")) for u, b in zip(urls, best, strict=True)], [b and -b[0] if not listed(u)[0] else None for u, b in zip(urls, best, strict=True)]


def made(n=400):
    r = random.Random(2)
    out = []
    for _ in range(n):
        sub = r.choice(["a.", "B.", "www.a.", "x.y.z.a.", ""])
        host = sub + r.choice(["example", "EXAMPLE", "example", "example", "other"]) + r.choice([".org", ".com", ".net", ".org:80", ""])
        out.append(r.choice(["http", "HTTPS"]) + "://" + host + r.choice(["/", "", "/es/", "/es/", "/es/", "/en/", "/de/", "/fr/", "/en"]) + str(r.randrange(300)) * r.randrange(2) + r.choice(["", "?a=1&b=2", "#top", "?q=://x", ".html", "/"]))
    return out + [None, "", "no scheme", "://", "http://", "http://org", "http://org/", "http://aorg/", "http://a.org?x", "http://example.org/en/1", "http://example.org/en/2", "http://line\n.org/a\nb", "http://com/fr/://org/", "HTTP://ÄB.ORG/", out[0], out[0]]


def test_verdicts_equal_brute_force(spark):
    urls = made()
    df = spark.createDataFrame([(i if i % 50 else None, u, "x", "y", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, key string, verdict int").repartition(4)
    words = [list(x["t"]) for x in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").select("i", U.tokens(F.col("url")).alias("t")).orderBy("i").collect()]
    assert all(len(set(t)) == len(t) <= 10 and len({x.split("=")[0] for x in t}) == len(t) for t in words)
    for support, confidence in ((0.02, 0.8), (0.1, 0.6)):
        verdicts, sure = expected(urls, words, support, confidence)
        got = U.judge(df, min_support=support, min_confidence=confidence)
        want = [(i if i % 50 else None, *split(u), listed(u)[0], v, s) for i, (u, v, s) in enumerate(zip(urls, verdicts, sure, strict=True))]
        assert sorted(map(tuple, got.drop("mined").collect()), key=repr) == sorted(want, key=repr)
        assert {"allow", "block"} == {w[4] for w in want if w[5]}


def test_op12_rows_and_types(spark, tmp_path):
    spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(made())], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = U.op12_url_filter(spark, str(tmp_path))
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"] and got.count() == len(made())
    assert {r["rule"] for r in got.select("rule").distinct().collect()} == {None, *(a + b for _, a, b in U.LIST)}
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", got._jdf.queryExecution().toString())


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(none).count() == 0
    rows = U.judge(spark.createDataFrame([(1, "http://a.net/x"), (2, None)], none.schema)).collect()
    assert [r["verdict"] for r in rows] == ["allow", "allow"]
