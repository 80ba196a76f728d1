"""Merging two versions of a text and repairing phrases, against plain versions."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from quillmill.catalog import QUERIES
from quillmill.operators import phrases as P
from quillmill.operators import versions as V

WORDS = [a + b for a in ("bron", "lav", "need", "mark", "trans", "bio") for b in ("chus", "age", "les", "er", "port", "psy")]


def plain_matches(a, b):
    """All pairs, one by one."""
    equal = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x.key == y.key}
    free = lambda own, done: [i for i in range(len(own)) if i not in done]
    fa, fb = free(a, {i for i, _ in equal}), free(b, {j for _, j in equal})
    rank = lambda own, left, i: [k for k in left if own[k].tokens == own[i].tokens].index(i)
    return equal | {(i, j) for i in fa for j in fb if V.near(a[i].tokens, b[j].tokens) and rank(a, fa, i) == rank(b, fb, j)}


def plain_lcs(n, m, same):
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + ((i, j) in same))
    return best[-1][-1]


def made(r):
    line = lambda: " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 9))) + r.choice(["", ".", " 12%"])
    a = [line() for _ in range(r.randrange(12))]
    b = [x if r.random() < 0.5 else " ".join(w if r.random() > 0.15 else "odd" for w in x.split()) for x in a if r.random() > 0.2]
    for _ in range(r.randrange(4)):
        b.insert(r.randrange(len(b) + 1), line())
    if r.random() < 0.3:
        r.shuffle(b)
    return "\n".join(a), "\r\n".join(b)


@pytest.mark.parametrize("seed", range(4))
def test_alignment_is_a_longest_common_subsequence(seed):
    r = random.Random(seed)
    for _ in range(200):
        first, other = made(r)
        a, b = V.lines(first), V.lines(other)
        pairs, known = V.matches(a, b)
        assert set(pairs) == plain_matches(a, b)
        chain = V.aligned(pairs)
        assert len(chain) == plain_lcs(len(a), len(b), set(pairs)) and set(chain) <= set(pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(chain, chain[1:]))
        text, _, inserted, repaired = V.merged(first, other)
        out = [x.key for x in V.lines(text)]
        if not repaired:
            assert [k for k in out if k in {x.key for x in a}] == [x.key for x in a]  # the first version's lines, in order
        missing = [y for y in b if all(x.key != y.key and not V.near(x.tokens, y.tokens) for x in a)]
        assert known == {j for j, y in enumerate(b) if y not in missing}
        assert all(y.key in out for y in missing) and (repaired or inserted == len(missing))


def test_merged_text():
    first = "Procedure note\nwas advanced to the carina.\nThe patient tolerated this well"
    other = "PROCEDURE  NOTE\nThe bronchoscope was advanced to the carina.\nNo bleeding was seen\nThe patient tolerated this very well"
    assert V.merged(first, other) == ("Procedure note\nThe bronchoscope was advanced to the carina.\nNo bleeding was seen\nThe patient tolerated this well", 3, 1, 1)
    assert V.merged(first, other, most_inserted=0)[2] == 0
    assert V.merged(None, None) == ("", 0, 0, 0) and V.merged("a\na\n\nb", None)[0] == "a\nb" and V.merged(None, "x\ny")[0] == "x\ny"


def test_versions_of_columns_and_long_texts(spark):
    long = "\n".join(f"line {i} about the {WORDS[i % 36]} and {i * 7}" for i in range(20_000))
    df = spark.createDataFrame([("a\nb", "b\nc"), (None, "x"), (long, long), ("", None)], "a string, b string")
    got = df.select(V.merge_versions(F.col("a"), F.col("b")).alias("m")).select("m.*").collect()
    assert [tuple(x)[1:] for x in got] == [(1, 1, 0), (0, 1, 0), (20_000, 0, 0), (0, 0, 0)] and got[0].text == "a\nb\nc" and got[2].text == long


def test_versions_that_begin_alike_are_dealt_over_tasks(spark, tmp_path):
    opening = " --- ".join("Operative note of the clinic and its wards today".split())
    docs = [(i, f"{opening}\nline {i % 7} of the text\nline {i % 5}") for i in range(300)] + [(300, "short"), (301, None), (302, "." * 100), (303, "One other text that begins like none of all these.")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = QUERIES["merged_versions"].run(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.doc_id for r in got) == list(range(1, 300)) and {r.first_id for r in got} == {0} and len({r.task for r in got}) > 1
    for r in got[:20]:
        text, *counts = V.merged(docs[0][1], docs[r.doc_id][1])
        assert (r.aligned, r.inserted, r.repaired, r.text_md5) == (*counts, hashlib.md5(text.encode()).hexdigest())


def plain_repairs(text, phrases, most):
    """Every window of every phrase."""
    found = list(P.WORD.finditer(text))
    out = []
    for p in phrases:
        own = p.text.split()
        for i in range(len(found) - len(own) + 1):
            w = found[i : i + len(own)]
            span = text[w[0].start() : w[-1].end()]
            a, b = [P.bare(m[0]) for m in w], [P.bare(x) for x in own]
            scores = [P.ratio(x, y) for x, y in zip(a, b, strict=True)]
            full = P.ratio("".join(a), "".join(b))
            if a and "[" not in span and "]" not in span and "".join(a) != "".join(b) and full >= p.full and sum(scores) / len(scores) >= p.mean and min(scores) >= p.least:
                out.append((round(full, 1), w[0].start(), w[-1].end(), p.text.upper() if span.isupper() else p.text.title() if span.istitle() else p.text))
    taken = []
    for c in sorted(out, key=lambda c: (-c[0], -(c[2] - c[1]), phrases_at(phrases, c[3]), c[1])):
        if len(taken) < most and not any(c[1] < t[2] and t[1] < c[2] for t in taken):
            taken.append(c)
    return sorted((s, e, x, score) for score, s, e, x in taken)


def phrases_at(phrases, text):
    return next(i for i, p in enumerate(phrases) if p.text == text.lower())


def test_repairs_equal_all_windows():
    r, some = random.Random(5), 0
    own = P.Repairer(P.PHRASES)
    vocabulary = [w for p in P.PHRASES for w in p.text.split()] + ["the", "a", "of", "x/y"]
    for _ in range(1500):
        words = []
        for _ in range(r.randrange(1, 14)):
            w = list(r.choice(vocabulary))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(["l", "1", "", "rn", "i"])
            w = "".join(w) or "x"
            words.append(r.choice([w, w, w.upper(), w.title(), f"[{w}]"]))
        if r.random() < 0.7:
            words += [x if r.random() > 0.5 else x.replace("i", "l", 1) for x in r.choice(P.PHRASES).text.split()]
        text = " ".join(words)
        got = own.repairs(text, 3)
        assert [g[3] for g in got] == [w[3] for w in plain_repairs(text, P.PHRASES, 3)] and {(g[0], g[1]) for g in got} == {(w[0], w[1]) for w in plain_repairs(text, P.PHRASES, 3)}, text
        some += len(got)
    assert some > 300


def test_many_phrases_in_many_texts():
    r = random.Random(8)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti".split()
    words = ["".join(r.choice(parts) for _ in range(r.randrange(1, 6))) for _ in range(6000)]
    phrases = [P.Phrase(" ".join(r.choices([w for w in words if len(w) > 5], k=2 + i % 2))) for i in range(150)]
    garbled = lambda t: t[:3] + t[4:8] + "x" + t[8:]
    texts = [" ".join([*r.choices(words, k=400), garbled(r.choice(phrases).text), *r.choices(words, k=400)]) for _ in range(40)] + [None, "", "[", phrases[0].text + "\nx " + phrases[1].text]
    own, began = P.Repairer(phrases), time.time()
    got = list(own.all_repairs(texts))
    assert time.time() - began < 4  # each word against each phrase took 8.6 s
    assert sum(map(len, got)) >= 30 and got[-4:] == [[]] * 4
    assert got == [own.repairs(t) for t in texts]
    assert got[:2] == [plain_repairs(t, phrases, 16) for t in texts[:2]]


def test_repaired_text(spark):
    rows = [("Underwent THERAPEUTlC ASPlRATION and Fiduclal Markar; radial ebus. [REDACTED] bronchoalveolar lavaqe",), ("",), (None,), ("therapeutic aspiration " * 3,), ("therapeutlc aspiration " * 20,), ("RADIAL EBVS and Radial Ebvs",)]
    got = [tuple(x.r) if x.r else None for x in spark.createDataFrame(rows, "t string").select(P.repaired(F.col("t")).alias("r")).collect()]
    assert got[0][0] == "Underwent therapeutic aspiration and Fiduclal Markar; radial ebus. [REDACTED] bronchoalveolar lavage"
    assert got[1] == ("", []) and got[2] is None and got[3] == (rows[3][0], []) and len(got[4][1]) == 16 and got[5][0] == "RADIAL EBUS and Radial Ebus"


def test_all_repairs_of_a_text():
    own = P.Repairer(P.PHRASES)
    text = "therapeutlc aspiration, " * 50 + "radial ebvs"
    assert len(own.repairs(text)) == 16 and own.repairs(text, None) == plain_repairs(text, P.PHRASES, 1000) and len(own.repairs(text, None)) == 51
    began = time.time()
    assert len(own.repairs("therapeutlc aspiration, " * 20_000, None)) == 20_000 and time.time() - began < 20


def test_repairs_of_phrases_in_blocks(spark):
    r = random.Random(9)
    words = ["".join(r.choice(["th", "er", "on", "an", "re"]) for _ in range(r.randrange(3, 6))) for _ in range(60)]
    phrases = sorted({" ".join(r.choices(words, k=2)) for _ in range(80)})
    garbled = lambda t: t[:3] + r.choice("lx") + t[4:]
    texts = [", ".join(garbled(r.choice(phrases)) for _ in range(r.randrange(40))) for _ in range(30)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([(p,) for p in [*phrases, phrases[0], "", None]], "phrase string")
    want = {(i, s, e, x, score) for i, t in enumerate(texts) for s, e, x, score in plain_repairs(t or "", [P.Phrase(p) for p in phrases], 1000)}
    assert max(sum(w[0] == i for w in want) for i in range(30)) > 16
    for size in (1_000_000, 300):  # one block, and several whose windows overlap
        got = [tuple(x) for x in P.find_repairs(docs, table, block_chars=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    none = P.find_repairs(docs, table.where("phrase = ''"))
    assert none.columns == ["doc_id", "start", "end", "replacement", "score"] and not none.collect()


def test_phrase_repairs_takes_all_phrases_and_all_places(spark, tmp_path):
    # An item has several pairs, a text over 16 places, two rows one id.
    docs = [(1, "fiducial marker " + "therapeutlc aspiration, " * 40), (2, "needle navigationa1 bronchoscopy"), (2, "needle navigationa1 bronchoscopy"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "Fiducial marker of therapeutic aspiration, Therapeutic navigational bronchoscopy"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(x) for x in QUERIES["phrase_repairs"].run(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(1, 16 + 24 * i, 38 + 24 * i, "therapeutic aspiration", 95.2) for i in range(40)] + [(2, 7, 32, "navigational bronchoscopy", 95.8)] * 2
