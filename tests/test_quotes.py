"""Quotes and terms in texts against plain versions."""

import random
import re
import time

import pytest

from quillmill.operators import quotes as Q
from quillmill.operators.terms import find_terms


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j], row[j + 1]) if x != y else last + 1
    return row[-1]


def plain_best(q, t, threshold):
    """All windows, one after the other."""
    m, n = len(q), len(t)
    windows = [(0, n)] if n <= m else [(0, k) for k in range(1, m)] + [(s, s + m) for s in range(n - m + 1)] + [(s, n) for s in range(n - m + 1, n)]
    best = None
    for s, e in windows:
        score = 200 * lcs(q, t[s:e]) / (m + e - s) if e > s else 0
        if score >= threshold and (best is None or score > best[0]):
            best = (score, s, e)
    return best


def edited(r, text, k):
    w = list(text)
    for _ in range(k):
        at = r.randrange(len(w) + 1)
        if r.random() < 0.4:
            w.insert(at, r.choice("abcé "))
        elif w:
            w[at - 1 : at] = r.choice(["", "x"])
    return "".join(w)


@pytest.mark.parametrize("threshold,n", [(90.0, 2000), (80.0, 300), (60.0, 150)])
def test_best_window_equals_all_windows(threshold, n):
    r, some = random.Random(4), 0
    for _ in range(n):
        q = "".join(r.choice("abcde é") for _ in range(r.randrange(12, 26)))
        t = "".join(r.choice("abcde é") for _ in range(r.randrange(30))) + edited(r, q, r.randrange(5)) + "".join(r.choice("abcde é") for _ in range(r.randrange(30)))
        t = t[r.randrange(4) :][: r.choice([8, 20, 60, 90])]
        got, want = Q.Quote(q, threshold).best(t), plain_best(q, t, threshold)
        assert (got is None) == (want is None) and (got is None or (got[1:] == want[1:] and got[0] == pytest.approx(want[0]))), (q, t)
        some += want is not None
    assert some > n / 20


def test_tiers():
    text = "Pré: The  lung was\nexamined, NO lesion seen. Later the lung again."
    at = lambda q, **k: (h := Q.anchor(text, q, **k)) and (h[0], text[h[2] : h[3]])
    assert at(" NO lesion ") == ("exact", "NO lesion")
    assert at("no LESION") == ("case_insensitive", "NO lesion")
    assert at("lung was examined") == ("whitespace", "lung was\nexamined")
    assert at("THE LUNG WAS") == ("whitespace_case_insensitive", "The  lung was")
    assert at("lung was examned; no lesion")[0] == "fuzzy"
    assert at("lun wax") is None and at("") is None and at(None) is None and Q.anchor(None, "x") is None
    assert Q.anchor(text, "the lung", prefix="Later", window=0)[2] == text.index("the lung")
    assert Q.anchor("İ x the END", "the end") == ("case_insensitive", 98.0, 4, 11)


def test_all_quotes_in_all_texts(spark):
    r = random.Random(6)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    quotes = [(i, text(r.choice([1, 3, 12, 30]))) for i in range(25)] + [(25, None), (26, ""), (27, " "), (28, "a"), (3, "x")]
    docs = [(i, text(20) + "  " + edited(r, r.choice(quotes[:25])[1], r.randrange(6)).replace(" ", r.choice([" ", "\n "])).title() + " " + text(20), "s") for i in range(60)]
    docs += [(60, None, "s"), (61, "", "s"), (None, docs[5][1], "s"), (5, docs[5][1], "s"), (62, quotes[3][1][:-4], "s")]
    df, qs = spark.createDataFrame(docs, "doc_id long, text string, start string"), spark.createDataFrame(quotes, "item_id int, text string")
    want = sorted(((d, i, *h) for d, t, _ in docs for i, q in quotes if (h := Q.anchor(t, q))), key=repr)
    assert {w[2] for w in want} >= {"exact", "case_insensitive", "whitespace_case_insensitive", "fuzzy"}
    for size in (2_000_000, 100):
        assert sorted(map(tuple, Q.anchor_quotes(df, qs, block_chars=size).collect()), key=repr) == want
    assert Q.anchor_quotes(df, qs.limit(0)).count() == Q.anchor_quotes(df.limit(0), qs).count() == 0


def test_few_texts_of_the_same_words_are_aligned():
    r = random.Random(9)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le".split()
    text = lambda k: " ".join(r.choice(("the", "of", "and", "in")) if r.random() < 0.35 else "".join(r.choice(parts) for _ in range(r.randrange(1, 5))) for _ in range(k))
    quotes = [(i, text(40)) for i in range(40)]
    docs = [text(300) for _ in range(40)] + [edited(r, text(30) + " " + q + " " + text(30), 22) for _, q in quotes] + [edited(r, q, 12)[: len(q) - 8] for _, q in quotes]
    block = Q._Block(quotes, 90.0)
    found = [block.candidates(d) for d in docs]
    assert sum(map(len, found[:40])) < 800  # of 1,600
    assert all(i in found[k + i] for k in (40, 80) for i in range(40) if Q.anchor(docs[k + i], quotes[i][1]))
    assert sum(Q.anchor(docs[k + i], quotes[i][1]) is not None for k in (40, 80) for i in range(40)) == 80


def test_hints_come_with_the_quotes(spark):
    docs = spark.createDataFrame([(1, "one two " + "z " * 3000 + "Two one two")], "doc_id long, text string")
    quotes = spark.createDataFrame([("a", "one two", "two", None)], "item_id string, text string, before string, after string")
    assert Q.anchor_quotes(docs, quotes, hints=("before", "after")).first()["start"] == 0
    far = spark.createDataFrame([("a", "one two", "z two", None)], quotes.schema)
    assert Q.anchor_quotes(docs, far, hints=("before", "after")).first()["start"] > 6000


def test_terms_in_texts(spark):
    r = random.Random(1)
    text = lambda k: "".join(r.choice("abAB é") for _ in range(k))
    docs = [(i, text(r.randrange(60)), "t") for i in range(80)] + [(None, "ab ab", "t"), (81, None, "t"), (82, "", "t")]
    terms = sorted({text(r.randrange(1, 4)) for _ in range(40)}) + ["ab", "AB", None, "", "ab"]
    df, ts = spark.createDataFrame(docs, "doc_id long, text string, term string"), spark.createDataFrame([(t,) for t in terms], "term string")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    for overlapping in (True, False):
        want = []
        for d, t, _ in docs:
            for term in {low(x) for x in terms if x}:
                at = [m.start() for m in re.finditer(f"(?={re.escape(term)})" if overlapping else re.escape(term), low(t or ""))]
                want += [(d, term, s, s + len(term)) for s in at]
        for size in (8_000_000, 5):
            assert sorted(map(tuple, find_terms(df, ts, overlapping=overlapping, block_chars=size).collect()), key=repr) == sorted(want, key=repr)
    whole = find_terms(df, ts, words=True).where("term = 'ab'").collect()
    assert {(x["doc_id"], x["start"]) for x in whole} == {(d, m.start()) for d, t, _ in docs for m in re.finditer(r"(?<![abé])ab(?![abé])", low(t or ""))}
    assert find_terms(df, ts.limit(0)).count() == find_terms(df.limit(0), ts).count() == 0


def test_terms_in_a_text_of_ten_megabytes(spark):
    docs = spark.createDataFrame([(1, "a" * 10_000_000), (2, "needle hay " * 900_000)], "doc_id long, text string")
    began = time.time()
    got = find_terms(docs, spark.createDataFrame([("needle",), ("aab",), ("a" * 5000 + "b",)], "term string")).count()
    assert got == 900_000 and time.time() - began < 30
