"""Operations of a training-data pipeline; nothing else in the library imports this subpackage."""


def queries() -> dict:
    """Name to (spark, sf_dir) -> DataFrame."""
    from quillmill.llm.bpe import op10_bpe
    from quillmill.llm.exact_dedup import op2_exact_dedup
    from quillmill.llm.hard_negatives import op13_hard_negatives
    from quillmill.llm.language_id import op8_language_id
    from quillmill.llm.lm_scoring import op9_lm_score
    from quillmill.llm.mixing import op1_mixing
    from quillmill.llm.ngram_join import op3_ngram_join
    from quillmill.llm.periodic_runs import op11_periodic_runs
    from quillmill.llm.sharding import op4_sharding
    from quillmill.llm.substring_dedup import op6_substring_dedup
    from quillmill.llm.token_files import op7_token_files
    from quillmill.llm.topk import op5_topk
    from quillmill.llm.url_filter import op12_url_filter

    found = (op1_mixing, op2_exact_dedup, op3_ngram_join, op4_sharding, op5_topk, op6_substring_dedup, op7_token_files, op8_language_id, op9_lm_score, op10_bpe, op11_periodic_runs, op12_url_filter, op13_hard_negatives)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from quillmill.llm.exact_dedup import OP2_SQL
    from quillmill.llm.hard_negatives import OP13_SQL
    from quillmill.llm.topk import OP5_SQL

    return {"op2_exact_dedup": OP2_SQL, "op5_topk": OP5_SQL, "op13_hard_negatives": OP13_SQL}
