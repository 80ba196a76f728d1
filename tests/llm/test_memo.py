"""The bounded memo of words of the BPE operator."""

import tracemalloc

from quillmill.llm import bpe


def test_memo_holds_two_small_generations():
    calls = []

    def make(key):
        calls.append(key)
        return f"{key},{key}"

    tracemalloc.start()
    memo, most = bpe.Memo(make, bpe.SMALL_MEMO), 0
    for i in range(250_000):
        assert memo[f"word{i}"] == f"word{i},word{i}"
        most = max(most, len(memo) + len(memo.old))
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert most <= 2 * bpe.SMALL_MEMO and size < 60e6
    n = len(calls)
    assert memo["word249999"] == "word249999,word249999" and len(calls) == n  # kept
    assert memo["word0"] == "word0,word0" and len(calls) == n + 1  # forgotten


def test_small_memo_ends_with_its_task(spark):
    """Workers serve the stages after; a memo of their own lasts."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    def opened(batches):
        import pyarrow as pa

        from quillmill.llm import bpe as own

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(memo == own.SMALL_MEMO for _, memo in own._open)], pa.int64())})

    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string").coalesce(1)
    rows = bpe.encode_decode(docs, path, memo=bpe.SMALL_MEMO)
    assert rows.count() == 2
    open_now = spark.range(8).repartition(8).mapInArrow(opened, "n long")
    assert rows.collect() == bpe.encode_decode(docs, path).collect()
    assert not any(r.n for r in open_now.collect())


def test_language_stage_sends_texts_alone_to_python(spark):
    from quillmill.llm.language_id import drop_unknown, fit, identify

    words = {"en": "the cat and the dog went over the old bridge", "de": "der hund und die katze gehen über die alte brücke"}
    rows = [(i, f"{words[lang]} {i}", lang, "s") for i in range(40) for lang in words] + [(90, "123 456", "en", "s"), (91, None, "de", None), (92, "", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = drop_unknown(docs)
    want = identify(docs, fit(docs.select("doc_id", "text", "lang"))).where("lang_pred <> 'und'").select(*docs.columns)
    assert sorted(kept.collect(), key=str) == sorted(want.collect(), key=str) and kept.count() == 80
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "EvalPython" in plan
