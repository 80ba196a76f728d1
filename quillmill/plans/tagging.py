"""Queries over tagged tokens and labelled spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import spans as S
from quillmill.operators import tagging as G
from quillmill.operators import vault as V
from quillmill.plans.documents import _span_sql
from quillmill.plans.registry import query
from quillmill.sources.shared import stored
from quillmill.sources.tables import table

#: Words of the tables that stand for protected words and billing words here, as no table has clinical notes.
RULES = G.Rules(devices=frozenset(("and", "der", "pour")), anatomy=frozenset(("inen", "euxelle")), code_words=frozenset(("the", "de", "von")), station_words=frozenset(), context={})


def tagged(df):
    """tokens of `text` and the tags of a plain tagger: words with a capital, numbers, brackets and hyphens."""
    tokens = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]"), F.lit(0))
    tag = lambda t, i: F.when(t.rlike("^[0-9]{6,}$"), "I-MRN").when(t.rlike("^[0-9]+$"), "B-ID").when(t.rlike("^[A-Z]"), F.when(i % 3 == 0, "B-NAME").otherwise("I-NAME")).when(t.isin("(", "-"), "I-CONTACT").when(i % 7 == 0, "I-NAME").otherwise("O")
    return df.select("*", tokens.alias("tokens")).withColumn("tags", F.transform("tokens", tag))


_IN = lambda c, words: f"{c} IN ({', '.join(repr(w) for w in sorted(words))})"
_NORMAL = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"

_TAGGED_SQL = rf"""x AS (SELECT conv_id, turn, i - 1 AS i, ts[i] AS t FROM (SELECT conv_id, turn, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]') AS ts FROM conversations))),
g AS (SELECT *, CASE WHEN regexp_matches(t, '^[0-9]{{6,}}$') THEN 'I-MRN' WHEN regexp_matches(t, '^[0-9]+$') THEN 'B-ID' WHEN regexp_matches(t, '^[A-Z]') THEN CASE WHEN i % 3 = 0 THEN 'B-NAME' ELSE 'I-NAME' END WHEN t IN ('(', '-') THEN 'I-CONTACT' WHEN i % 7 = 0 THEN 'I-NAME' ELSE 'O' END AS tag, {_NORMAL.format(c='t')} AS w FROM x),
l AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) END AS label FROM g),
s AS (SELECT *, label IS NOT NULL AND (tag LIKE 'B-%' OR label IS DISTINCT FROM lag(label) OVER (PARTITION BY conv_id, turn ORDER BY i)) AS first, lead(t) OVER (PARTITION BY conv_id, turn ORDER BY i) AS follows FROM l),
r AS (SELECT *, sum(first::INT) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM s)"""


@query(f"WITH {_TAGGED_SQL} SELECT conv_id, turn, min(i)::INTEGER AS start_at, (max(i) + 1)::INTEGER AS end_at, any_value(label) AS label FROM r WHERE label IS NOT NULL GROUP BY conv_id, turn, run")
def conv_entity_runs(spark, d):
    """Runs of a label over the tokens of each turn."""
    runs = tagged(table(spark, d, "conversations")).select("conv_id", "turn", F.inline(G.entity_runs(F.col("tags"))))
    return runs.select("conv_id", "turn", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "label")


@query(f"""WITH {_TAGGED_SQL},
e AS (SELECT conv_id, turn, run, any_value(label) AS label, bool_and(regexp_matches(t, '^[()\\[\\]{{}},.;:!?/\\\\_"''-]$')) AS marks, bool_or({_IN('w', RULES.devices | RULES.anatomy)}) AS guarded, trim(regexp_replace(string_agg(w, ' ' ORDER BY i), ' +', ' ', 'g')) AS words,
  bool_or(contains(t, '''')) OR coalesce(arg_max(follows, i) = '''', false) AS apostrophe, arg_min(t, i) AS head FROM r WHERE label IS NOT NULL GROUP BY conv_id, turn, run),
f AS (SELECT conv_id, turn, run, label NOT IN ('MRN', 'SSN') AND (marks OR guarded OR (length(words) < 2 AND NOT (words = 'o' AND apostrophe)) OR (words <> 'o' AND len(list_filter(string_split(words, ' '), lambda z: NOT ({_IN('z', RULES.stopwords)}))) = 0)
  OR (regexp_matches(head, '^[()\\[\\]{{}},.;:!?/\\\\_"''-]$') AND NOT (head = '(' AND label IN ('CONTACT', 'PHONE')))) AS falls FROM e),
b AS (SELECT conv_id, turn, max(({_IN('w', RULES.code_words)})::INT) AS billed FROM r GROUP BY conv_id, turn),
c AS (SELECT r.*, coalesce(falls, false) OR (label IS NOT NULL AND label NOT IN ('MRN', 'SSN') AND (({_IN('r.w', RULES.devices | RULES.anatomy)}) OR (regexp_matches(t, '^[0-9]{{4,6}}$') AND (billed = 1
  OR max(({_IN('r.w', RULES.code_words)})::INT) OVER (PARTITION BY r.conv_id, r.turn ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) = 1
  OR (max((t IN ('(', ')'))::INT) OVER (PARTITION BY r.conv_id, r.turn ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) = 1 AND max((t = '/')::INT) OVER (PARTITION BY r.conv_id, r.turn ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) = 1))))) AS gone
  FROM r JOIN b USING (conv_id, turn) LEFT JOIN f ON f.conv_id = r.conv_id AND f.turn = r.turn AND f.run = r.run AND r.label IS NOT NULL),
k AS (SELECT conv_id, turn, i, CASE WHEN NOT gone THEN label END AS label, CASE WHEN NOT gone THEN tag END AS tag FROM c),
z AS (SELECT *, tag LIKE 'B-%' OR label IS DISTINCT FROM lag(label) OVER (PARTITION BY conv_id, turn ORDER BY i) AS first FROM k)
SELECT conv_id, turn, label, count(*) FILTER (first) AS entities, count(*) AS tokens FROM z WHERE label IS NOT NULL GROUP BY ALL""")
def conv_entity_veto(spark, d):
    """Entities of each turn that no veto drops, and their tokens."""
    kept = tagged(table(spark, d, "conversations")).select("conv_id", "turn", F.explode(G.veto(F.col("tokens"), F.col("tags"), F.col("text"), RULES)).alias("tag")).where("tag <> 'O'")
    return kept.groupBy("conv_id", "turn", F.substring("tag", 3, 99).alias("label")).agg(F.count_if(F.col("tag").startswith("B-")).alias("entities"), F.count(F.lit(1)).alias("tokens"))


def labelled_spans(df, keep):
    """Spans of personal data as patterns find them, and as a tagger with other scores might."""
    found = S.find(df, "text", S.PII, keep).select(*keep, "start", "end", F.col("entity").alias("label"), F.col("confidence").alias("score"), F.concat(F.lit("regex_"), "entity").alias("source"))
    other = found.where("label <> 'PHONE'").withColumns({"score": F.when(F.col("start") % 2 == 0, 0.99).otherwise(F.col("score")), "source": F.lit("tagger")})
    return found.unionByName(other)


_LABELLED_SQL = f"""{_span_sql('doc_id')}, f AS (SELECT doc_id, s::INTEGER AS s, e::INTEGER AS e, entity, CASE entity {' '.join(f"WHEN '{e}' THEN {c}" for e, (_, c) in S.PII.items())} END::DOUBLE AS c FROM spans),
u AS (SELECT *, 'regex_' || entity AS source FROM f UNION ALL SELECT doc_id, s, e, entity, CASE WHEN s % 2 = 0 THEN 0.99 ELSE c END, 'tagger' FROM f WHERE entity <> 'PHONE')"""


@query(f"WITH {_LABELLED_SQL} SELECT doc_id, s AS start_at, e AS end_at, entity AS label, c AS score, source FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, s, e, entity ORDER BY c DESC, source LIKE 'regex%' DESC) = 1")
def doc_spans_deduped(spark, d):
    """One of spans equal in place and label: the higher score, then the pattern's."""
    each = labelled_spans(table(spark, d, "documents"), ["doc_id"]).groupBy("doc_id").agg(F.collect_list(F.struct(*S.LABELLED)).alias("s"))
    return each.select("doc_id", F.inline(S.deduped(F.col("s"), by_source=False))).withColumnsRenamed({"start": "start_at", "end": "end_at"})


@query(None)
def doc_spans_best_of(spark, d):
    """Overlaps of patterns' and tagger's spans resolved; tested against a plain fold."""
    each = labelled_spans(table(spark, d, "documents"), ["doc_id"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*S.LABELLED))).alias("s"))
    return each.select("doc_id", F.inline(S.merged_best_of(F.col("s")))).withColumnsRenamed({"start": "start_at", "end": "end_at"})


@query(f"WITH {_span_sql('doc_id')} SELECT entity, CASE WHEN hash_doc % 3 = 0 THEN 'new' ELSE 'old' END AS key_id, count(*) AS opened, count(DISTINCT m) AS texts FROM (SELECT *, doc_id AS hash_doc FROM spans) GROUP BY ALL")
def vault_round_trip(spark, d):
    """Personal data sealed, a third of it under another key, and opened again."""
    found = S.find(table(spark, d, "documents"), "text", S.PII, ["doc_id"]).select("doc_id", F.concat_ws(":", "doc_id", "entity", "start").alias("id"), "entity", "match")
    # Keys of a fixture: real ones come from a store of secrets.
    keys = spark.range(2).select(F.when(F.col("id") == 0, "old").otherwise("new").alias("key_id"), F.sha2(F.col("id").cast("string"), 256).alias("h")).select("key_id", F.unhex("h").alias("key"))
    vault = stored(V.sealed(found, "id", "match", keys, "old"))
    moved = F.split("id", ":")[0].cast("bigint") % 3 == 0
    both = V.rotated(vault.where(moved), keys, "new").unionByName(vault.where(~moved))
    plain = V.opened(both, keys).where("value IS NOT NULL")
    return plain.groupBy(F.split("id", ":")[1].alias("entity"), "key_id").agg(F.count(F.lit(1)).alias("opened"), F.countDistinct("value").alias("texts"))
