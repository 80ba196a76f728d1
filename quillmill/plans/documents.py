"""Queries over texts: personal data, hygiene, quality, sections, terms, linkage."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as T
from quillmill.operators import spans as S
from quillmill.operators.phrases import find_repairs
from quillmill.operators.quotes import anchor_quotes
from quillmill.operators.set_join import jaccard_join, near_parts
from quillmill.operators.terms import find_terms
from quillmill.operators.versions import merge_versions
from quillmill.plans.registry import query
from quillmill.sources.tables import table

big = lambda c: c.cast("bigint")
#: Documents that begin alike and are compared in one part.
ALIKE = 64


def _span_sql(keep: str, source: str = "documents", id_col: str = "doc_id") -> str:
    """SQL for the spans of S.PII: {keep}, entity, s, e, m."""
    one = """SELECT {keep}, '{e}' AS entity, ms[k] AS m,
      (list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0))::BIGINT AS s
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT *, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gs FROM {source}))"""
    return "spans AS (SELECT *, s + length(m) AS e FROM (" + " UNION ALL ".join(one.format(keep=keep, e=e, p=p, source=source) for e, (p, _) in S.PII.items()) + "))"


_REDACT_SQL = "text"
for _e, (_p, _) in S.PII.items():
    _REDACT_SQL = f"regexp_replace({_REDACT_SQL}, '{_p}', '[{_e}]', 'g')"


@query(f"WITH {_span_sql('doc_id, lang')} SELECT lang, entity, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM spans GROUP BY ALL")
def doc_pii_redaction_summary(spark, d):
    found = S.find(table(spark, d, "documents"), "text", S.PII, ["doc_id", "lang"])
    per_doc = found.groupBy("lang", "entity", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("lang", "entity").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("docs"))


@query(f"WITH {_span_sql('doc_id')} SELECT doc_id, entity, s AS start_at, e AS end_at, md5(m) AS text_md5 FROM spans")
def doc_pii_spans(spark, d):
    found = S.find(table(spark, d, "documents"), "text", S.PII, ["doc_id"])
    return found.select("doc_id", "entity", big(F.col("start")).alias("start_at"), big(F.col("end")).alias("end_at"), F.md5("match").alias("text_md5"))


@query(f"""WITH {_span_sql('doc_id')}, p AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM spans),
n AS (SELECT *, sum(CASE WHEN s <= u THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS i FROM p)
SELECT doc_id, min(s) AS start_at, max(e) AS end_at, count(*) AS n_spans FROM n GROUP BY doc_id, i""")
def doc_span_merge(spark, d):
    found = S.find(table(spark, d, "documents"), "text", S.PII, ["doc_id"])
    return S.merge(found, "doc_id").select("doc_id", big(F.col("start")).alias("start_at"), big(F.col("end")).alias("end_at"), "n_spans")


@query(f"SELECT doc_id, md5({_REDACT_SQL}) AS redacted_md5 FROM documents")
def doc_redacted_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.redact(F.col("text"), S.PII)).alias("redacted_md5"))


@query(f"""WITH {_span_sql('doc_id')}, n AS (SELECT doc_id, count(*) AS c, count(*) FILTER (entity <> 'IPV4') AS k FROM spans GROUP BY 1)
SELECT doc_id, length(text)::BIGINT AS original_length, length({_REDACT_SQL})::BIGINT AS scrubbed_length, coalesce(c, 0) AS redactions, coalesce(k, 0) AS kept_by_threshold FROM documents LEFT JOIN n USING (doc_id)""")
def doc_redaction_audit(spark, d):
    count = [T.count_of(F.col("text"), p) for p, _ in S.PII.values()]
    kept = [n for n, (_, s) in zip(count, S.PII.values(), strict=True) if s >= 0.8]
    add = lambda xs: F.coalesce(sum(xs[1:], xs[0]), F.lit(0).cast("bigint"))
    return table(spark, d, "documents").select("doc_id", big(F.length("text")).alias("original_length"), big(F.length(S.redact(F.col("text"), S.PII))).alias("scrubbed_length"), add(count).alias("redactions"), add(kept).alias("kept_by_threshold"))


@query(f"WITH {_span_sql('doc_id')} SELECT doc_id, entity, s AS start_at FROM spans a WHERE entity <> 'EMAIL' AND NOT EXISTS (SELECT 1 FROM spans z WHERE z.entity = 'EMAIL' AND z.doc_id = a.doc_id AND a.s < z.e AND z.s < a.e)")
def doc_protected_zone_filter(spark, d):
    found = S.find(table(spark, d, "documents"), "text", S.PII, ["doc_id"])
    return S.outside(found.where("entity <> 'EMAIL'"), found.where("entity = 'EMAIL'"), "doc_id").select("doc_id", "entity", big(F.col("start")).alias("start_at"))


@query(None)
def doc_span_last_kept(spark, d):
    """Overlaps resolved against the span kept last."""
    found = S.find(table(spark, d, "documents"), "text", S.PII, ["doc_id"])
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "confidence")).alias("s"))
    return per_doc.select("doc_id", F.inline(S.best_last_kept(F.col("s"))))


@query(f"WITH {_span_sql('conv_id, turn, role', 'conversations')} SELECT role, entity, count(*) AS hits FROM spans GROUP BY ALL")
def conv_pii_by_role(spark, d):
    return S.find(table(spark, d, "conversations"), "text", S.PII, ["role"]).groupBy("role", "entity").agg(F.count(F.lit(1)).alias("hits"))


_DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"


@query(f"SELECT conv_id, count(*) FILTER (regexp_matches(text, '{_DATE}')) AS leaking_turns, count(*) AS turns FROM conversations GROUP BY 1")
def leak_guard(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("text").rlike(_DATE)).alias("leaking_turns"), F.count(F.lit(1)).alias("turns"))


_NORM_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, E'\r\n?', E'\n', 'g'), E'[ \t]+', ' ', 'g'), E' ?\n ?', E'\n', 'g'), E'\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, md5({_NORM_SQL}) AS norm_md5 FROM documents")
def norm_whitespace_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("norm_md5"))


_BOILER = "all rights reserved|copyright|licen[cs]e"


@query(f"SELECT doc_id, (length(text) - length(r))::BIGINT AS removed, md5(r) AS text_md5 FROM (SELECT doc_id, text, array_to_string(list_filter(string_split(text, E'\\n'), lambda x: NOT regexp_matches(lower(x), '{_BOILER}')), E'\\n') AS r FROM documents)")
def strip_boilerplate(spark, d):
    """Lines with boilerplate wording go; line by line, so a long line isn't searched from each of its places."""
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.lower(x).rlike(_BOILER)), "\n")
    cut = table(spark, d, "documents").withColumn("r", kept)
    return cut.select("doc_id", big(F.length("text") - F.length("r")).alias("removed"), F.md5("r").alias("text_md5"))


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


_LINES_SQL = "lines AS (SELECT doc_id, k - 1 AS line_no, ls[k] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, E'\\n') AS ls FROM documents)))"


@query(f"WITH {_LINES_SQL} SELECT md5(line) AS line_md5, count(DISTINCT doc_id) AS docs, count(*) AS n FROM lines WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT doc_id) >= 3")
def repeated_lines(spark, d):
    long = _lines(spark, d).where(F.length("line") >= 20)
    per_doc = long.groupBy(F.md5("line").alias("line_md5"), "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return per_doc.groupBy("line_md5").agg(F.count(F.lit(1)).alias("docs"), F.sum("k").alias("n")).where("docs >= 3")


@query(f"WITH {_LINES_SQL}, p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM lines) SELECT doc_id, count(*) FILTER (line = b AND line <> '') AS removed FROM p GROUP BY 1")
def consecutive_dup_lines(spark, d):
    # Inside the row: lines and their predecessors are zipped, so no shuffle.
    ls = F.split("text", "\n", -1)
    same = F.zip_with(F.slice(ls, F.lit(2), F.greatest(F.size(ls) - 1, F.lit(0))), F.slice(ls, F.lit(1), F.greatest(F.size(ls) - 1, F.lit(0))), lambda a, b: (a == b) & (a != ""))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", big(F.size(F.filter(same, lambda x: x))).alias("removed"))


@query(r"""SELECT doc_id, round(CASE WHEN n > 0 THEN a / n ELSE 0 END, 6) AS alpha_ratio, words, boilerplate FROM (SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a,
len(regexp_extract_all(text, '[A-Za-z]+'))::BIGINT AS words, len(regexp_extract_all(lower(text), 'all rights reserved|copyright|license|confidential'))::BIGINT AS boilerplate FROM documents)""")
def line_quality_metrics(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.round(T.alpha_ratio(c), 6).alias("alpha_ratio"), T.count_of(c, "[A-Za-z]+").alias("words"), T.count_of(F.lower(c), "|".join(T.BOILERPLATE)).alias("boilerplate"))


@query(r"""SELECT doc_id, score, CASE WHEN score >= 2 THEN 'junk' WHEN score = 1 THEN 'doubtful' ELSE 'good' END AS class FROM (SELECT doc_id,
((CASE WHEN n = 0 OR 10 * a < 6 * n THEN 1 ELSE 0 END) + (CASE WHEN w < 5 THEN 1 ELSE 0 END) + (CASE WHEN b > 0 THEN 1 ELSE 0 END))::BIGINT AS score FROM (SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS n,
length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a, len(regexp_extract_all(text, '[A-Za-z]+')) AS w, len(regexp_extract_all(lower(text), 'all rights reserved|copyright|license|confidential')) AS b FROM documents))""")
def doc_quality_classifier(spark, d):
    c = F.col("text")
    n, a = F.length(F.regexp_replace(c, r"\s", "")), F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    one = lambda x: F.when(x, 1).otherwise(0)
    score = one((n == 0) | (10 * a < 6 * n)) + one(T.count_of(c, "[A-Za-z]+") < 5) + one(T.count_of(F.lower(c), "|".join(T.BOILERPLATE)) > 0)
    return table(spark, d, "documents").select("doc_id", big(score).alias("score")).withColumn("class", F.when(F.col("score") >= 2, "junk").when(F.col("score") == 1, "doubtful").otherwise("good"))


@query(r"""SELECT doc_id, length(m) = length(text) AS same_length, (length(text) - length(regexp_replace(m, '#', '', 'g')))::BIGINT AS hashes FROM (SELECT doc_id, text,
regexp_replace(text, '[0-9]', '#', 'g') AS m FROM documents)""")
def mask_offsets_preserved(spark, d):
    masked = table(spark, d, "documents").withColumn("m", T.mask(F.col("text"), "[0-9]+", "#"))
    return masked.select("doc_id", (F.length("m") == F.length("text")).alias("same_length"), big(F.length("text") - F.length(F.regexp_replace("m", "#", ""))).alias("hashes"))


@query(r"""SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages)""")
def html_strip_text(spark, d):
    t = table(spark, d, "pages").withColumn("t", T.strip_tags(F.col("html")))
    return t.select("page_id", big(F.length("t")).alias("n_chars"), F.md5("t").alias("text_md5"))


_HEAD = "<h[1-6][^>]*>[^<]*"


@query(f"""SELECT page_id, (k - 1)::BIGINT AS n, regexp_replace(hs[k], '<h[1-6][^>]*>', '') AS heading, length(bs[k + 1])::BIGINT AS body_length FROM (SELECT page_id, hs, bs, unnest(range(1, len(hs) + 1)) AS k FROM
(SELECT page_id, regexp_extract_all(html, '{_HEAD}') AS hs, string_split_regex(html, '{_HEAD}') AS bs FROM pages))""")
def page_sections(spark, d):
    heads, bodies = F.regexp_extract_all("html", F.lit(_HEAD), F.lit(0)), F.split("html", _HEAD, -1)
    zipped = F.arrays_zip(heads.alias("h"), F.slice(bodies, F.lit(2), F.size(heads)).alias("b"))
    parts = table(spark, d, "pages").select("page_id", F.posexplode(zipped).alias("n", "s"))
    return parts.select("page_id", big(F.col("n")).alias("n"), F.regexp_replace("s.h", "<h[1-6][^>]*>", "").alias("heading"), big(F.length("s.b")).alias("body_length"))


@query("""SELECT page_id, CASE WHEN a >= b AND a >= c AND a > 0 THEN 'article' WHEN b >= c AND b > 0 THEN 'listing' WHEN c > 0 THEN 'shop' ELSE 'unknown' END AS label, greatest(a, b, c)::BIGINT AS score FROM (SELECT page_id,
2 * contains(lower(html), '<article')::INT + contains(lower(html), '<p')::INT AS a, 2 * contains(lower(html), '<table')::INT + contains(lower(html), '<li')::INT AS b, 3 * contains(lower(html), 'price')::INT AS c FROM pages)""")
def page_fingerprint(spark, d):
    has = lambda s: F.lower("html").contains(s).cast("int")
    s = table(spark, d, "pages").select("page_id", (2 * has("<article") + has("<p")).alias("a"), (2 * has("<table") + has("<li")).alias("b"), (3 * has("price")).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    label = F.when((a >= b) & (a >= c) & (a > 0), "article").when((b >= c) & (b > 0), "listing").when(c > 0, "shop").otherwise("unknown")
    return s.select("page_id", label.alias("label"), big(F.greatest("a", "b", "c")).alias("score"))


@query(f"WITH {_LINES_SQL}, r AS (SELECT doc_id, line_no, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS upto FROM lines WHERE line <> '') SELECT doc_id, count(*) AS kept, max(upto)::BIGINT AS used FROM r WHERE upto <= 2000 GROUP BY 1")
def section_budget(spark, d):
    # A running sum inside the row; lines never leave it.
    ls = F.filter(F.split("text", "\n", -1), lambda x: x != "")
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(0).cast("bigint").alias("kept"), F.lit(0).cast("bigint").alias("used"))

    def step(a, x):
        upto = a["upto"] + F.length(x)
        return F.struct(upto.alias("upto"), F.when(upto <= 2000, a["kept"] + 1).otherwise(a["kept"]).alias("kept"), F.when(upto <= 2000, upto).otherwise(a["used"]).alias("used"))

    return table(spark, d, "documents").select("doc_id", F.aggregate(ls, start, step).alias("s")).select("doc_id", "s.kept", "s.used").where("kept > 0")


#: Families of documents by wording; one expression each. Fixed values.
FAMILIES = {"legal": "license|copyright|rights reserved", "contact": "@|tel|phone", "code": "[{};]|<[a-z]+>", "table": "[|]"}


@query(" UNION ALL ".join(f"SELECT doc_id, '{f}' AS family FROM documents WHERE regexp_matches(lower(text), '{p}')" for f, p in FAMILIES.items()))
def doc_families(spark, d):
    tags = F.array_compact(F.array(*[F.when(F.lower("text").rlike(p), F.lit(f)) for f, p in FAMILIES.items()]))
    return table(spark, d, "documents").select("doc_id", F.explode(tags).alias("family"))


@query("""WITH t AS (SELECT regexp_replace(lower(text), '[^ -~\\n]', ' ', 'g') AS f FROM documents), s AS (SELECT f, string_split(f, 'the') AS parts FROM t),
h AS (SELECT f, unnest(list_transform(range(1, len(parts)), lambda i: len(array_to_string(parts[1:i], 'the')) + 1)) AS p FROM s)
SELECT scope, sum(CASE WHEN regexp_matches(substr(f, greatest(1, p - scope), p - greatest(1, p - scope)), '\\b(no|not|without|never|in|an)\\b') THEN 1 ELSE 0 END)::BIGINT AS negated, count(*) AS hits
FROM h, (VALUES (30), (60), (200)) AS v(scope) GROUP BY 1""")
def negated_terms(spark, d):
    """All hits of a term and those with a negation cue in the 30, 60 and 200 characters before them."""
    folded = table(spark, d, "documents").select(T.ascii_fold(F.lower("text")).alias("f")).where(F.contains("f", F.lit("the")))
    starts = F.transform(S.matches(F.col("f"), "the"), lambda m: m["start"] + 1)

    def cued(scope):
        def test(p):
            first = F.greatest(F.lit(1), p - scope)
            return S.negated(F.substr("f", first, p - first), r"\b(no|not|without|never|in|an)\b")

        return F.size(F.filter("ps", test))

    # Counted inside the row: neither texts nor contexts are copied for each hit.
    each = folded.select("f", starts.alias("ps"))
    scopes = F.array(*[F.struct(F.lit(k).alias("scope"), cued(k).alias("negated"), F.size("ps").alias("hits")) for k in (30, 60, 200)])
    return each.select(F.inline(scopes)).groupBy("scope").agg(big(F.sum("negated")).alias("negated"), big(F.sum("hits")).alias("hits"))


@query("SELECT doc_id, md5(substr(text, greatest(1, p - 40), p - greatest(1, p - 40) + 43)) AS snippet_md5 FROM (SELECT doc_id, text, instr(text, 'the') AS p FROM documents) WHERE p > 0")
def context_snippets(spark, d):
    hit = table(spark, d, "documents").select("doc_id", "text", F.instr("text", "the").alias("p")).where("p > 0")
    first = F.greatest(F.lit(1), F.col("p") - 40)
    return hit.select("doc_id", F.md5(F.substr("text", first, F.col("p") - first + 43)).alias("snippet_md5"))


@query("SELECT lang, count(*) FILTER (regexp_matches(text, '(?s)and.{0,80}the|the.{0,80}and')) AS near, count(*) AS docs FROM documents GROUP BY 1")
def cooccurrence_window(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(F.col("text").rlike("(?s)and.{0,80}the|the.{0,80}and")).alias("near"), F.count(F.lit(1)).alias("docs"))


@query("SELECT doc_id, 'url' AS field, regexp_matches(lower(text), 'https?://|www') AS performed FROM documents UNION ALL SELECT doc_id, 'number', regexp_matches(text, '[0-9]{3,}') FROM documents UNION ALL SELECT doc_id, 'legal', regexp_matches(lower(text), 'license|copyright') FROM documents")
def flag_extraction(spark, d):
    flags = F.array(*[F.struct(F.lit(f).alias("field"), e.alias("performed")) for f, e in (("url", F.lower("text").rlike("https?://|www")), ("number", F.col("text").rlike("[0-9]{3,}")), ("legal", F.lower("text").rlike("license|copyright")))])
    return table(spark, d, "documents").select("doc_id", F.inline(flags))


@query("SELECT doc_id, ns[1]::BIGINT AS first_size, CASE WHEN len(list_distinct(ns)) = 1 THEN ns[1]::BIGINT END AS only_size FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]{1,6}'), lambda x: x::BIGINT) AS ns FROM documents) WHERE len(ns) > 0")
def numeric_sizes(spark, d):
    ns = F.transform(F.regexp_extract_all("text", F.lit("[0-9]{1,6}"), F.lit(0)), lambda x: x.cast("bigint"))
    return table(spark, d, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", ns.alias("n")).select("doc_id", F.col("n")[0].alias("first_size"), F.when(F.size(F.array_distinct("n")) == 1, F.col("n")[0]).alias("only_size"))


_TOK = "list_sort(list_distinct(regexp_extract_all(lower({c}), '[a-z]{{4,}}')))"


@query(f"""WITH t AS (SELECT doc_id, unnest({_TOK.format(c='text')}) AS w FROM documents), n AS (SELECT doc_id, count(*) AS nd FROM t GROUP BY 1), u AS (SELECT item_id, unnest({_TOK.format(c='text')}) AS w FROM benchmark), m AS (SELECT item_id, count(*) AS ni FROM u GROUP BY 1),
i AS (SELECT doc_id, item_id, count(*) AS k FROM t JOIN u USING (w) GROUP BY 1, 2)
SELECT doc_id, item_id, round(k / (nd + ni - k), 6) AS jaccard FROM i JOIN n USING (doc_id) JOIN m USING (item_id) WHERE k / (nd + ni - k) >= 0.2""")
def jaccard_pairs(spark, d):
    """Token-set similarity of documents and benchmark items of 0.2 or more: every shared token is counted, in the documents' own tasks."""
    sets = lambda name, key: table(spark, d, name).select(key, T.tokens(F.col("text"), "[a-z]{4,}").alias("ws"))
    near = jaccard_join(sets("documents", "doc_id"), sets("benchmark", "item_id"), 0.2)
    return near.select("doc_id", "item_id", F.round("jaccard", 6).alias("jaccard"))


@query("""WITH b AS (SELECT item_id, text AS q, trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')) AS nq FROM benchmark),
t AS (SELECT doc_id, text, regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g') AS nt FROM documents)
SELECT item_id, doc_id, CASE WHEN contains(text, q) THEN 'exact' WHEN contains(lower(text), lower(q)) THEN 'case' ELSE 'space' END AS method, instr(nt, nq)::BIGINT AS found_at FROM t, b WHERE nq <> '' AND contains(nt, nq)""")
def quote_anchor(spark, d):
    """Which documents hold a whole quote: exactly, but for case, or but for case and white space; an automaton over all quotes finds them."""
    space = lambda c: F.regexp_replace(F.lower(c), r"[ \t\r\n]+", " ")
    docs = table(spark, d, "documents").select("doc_id", "text", space("text").alias("nt"))
    quotes = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"), F.trim(space("text")).alias("nq"))
    found = find_terms(docs, quotes, text_col="nt", term_col="nq", fold=False).groupBy("doc_id", "term").agg(F.min("start").alias("first"))
    both = found.join(quotes, F.col("term") == F.col("nq")).join(docs.select("doc_id", "text"), "doc_id")
    method = F.when(F.contains("text", F.col("q")), "exact").when(F.contains(F.lower("text"), F.lower("q")), "case").otherwise("space")
    return both.select("item_id", "doc_id", method.alias("method"), big(F.col("first") + 1).alias("found_at"))


@query(r"""WITH b AS (SELECT item_id, q, lower(q) AS lq, array_to_string(list_transform(list_filter(string_split_regex(q, '\s+'), lambda x: x <> ''), lambda x: regexp_escape(x)), '\s+') AS p
  FROM (SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS q FROM benchmark) WHERE q <> ''),
t AS (SELECT doc_id, text, lower(text) AS low FROM documents),
h AS (SELECT *, CASE WHEN contains(text, q) THEN 'exact' WHEN contains(low, lq) THEN 'case_insensitive' WHEN regexp_matches(text, p) THEN 'whitespace' ELSE 'whitespace_case_insensitive' END AS method FROM t, b WHERE regexp_matches(low, lower(p))),
s AS (SELECT item_id, doc_id, method, CASE method WHEN 'exact' THEN q WHEN 'case_insensitive' THEN lq WHEN 'whitespace' THEN regexp_extract(text, p) ELSE regexp_extract(low, lower(p)) END AS found, CASE WHEN method IN ('exact', 'whitespace') THEN text ELSE low END AS place FROM h)
SELECT item_id, doc_id, method, (instr(place, found) - 1)::INTEGER AS start_at, (instr(place, found) - 1 + length(found))::INTEGER AS end_at FROM s""")
def quote_places(spark, d):
    """Where the quotes of `benchmark` stand in documents: exactly, but for case, or but for white space."""
    found = anchor_quotes(table(spark, d, "documents"), table(spark, d, "benchmark"), None)
    return found.select("item_id", "doc_id", "method", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(None)
def quote_places_fuzzy(spark, d):
    """Quotes of `benchmark` whose closest window in a document has a partial ratio of 90 or more, none of the other tiers fitting."""
    found = anchor_quotes(table(spark, d, "documents"), table(spark, d, "benchmark")).where("method = 'fuzzy'")
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("start").alias("start_at"), F.col("end").alias("end_at"))


_LOW = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH t AS (SELECT DISTINCT {_LOW.format(c='w')} AS term FROM (SELECT p_name AS w FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}')) FROM benchmark) WHERE w <> ''),
x AS (SELECT doc_id, {_LOW.format(c='text')} AS low FROM documents)
SELECT doc_id, term, ((length(low) - length(replace(low, term, ''))) / length(term))::BIGINT AS hits, (instr(low, term) - 1)::INTEGER AS first_at FROM x JOIN t ON contains(low, term)""")
def dictionary_terms(spark, d):
    """How often and where first each document has the terms of a dictionary of part names and benchmark words, case apart."""
    part, items = table(spark, d, "part"), table(spark, d, "benchmark")
    names = part.select(F.col("p_name").alias("term")).unionByName(part.select(F.explode(F.split("p_name", " ")).alias("term")))
    terms = names.unionByName(items.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("term")))
    found = find_terms(table(spark, d, "documents"), terms)
    return found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("hits"), F.min("start").alias("first_at"))


@query("SELECT doc_id, sha256(text) AS sha, substr(md5(doc_id::VARCHAR || ':' || source), 1, 12) AS short_id FROM documents")
def hash_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "source")), 1, 12).alias("short_id"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), p AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM benchmark), n AS (SELECT doc_id, w, count(*) AS n FROM t WHERE w IN (SELECT w FROM p) GROUP BY 1, 2)
SELECT doc_id, w AS concept, n FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) = 1""")
def concept_link(spark, d):
    """The dictionary term a document mentions most."""
    terms = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("w")).distinct()
    words = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    n = words.join(terms, "w", "left_semi").groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "w"))).where("r = 1").select("doc_id", F.col("w").alias("concept"), "n")


@query("""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS w FROM part), v AS (SELECT unnest(['red', 'green', 'steel', 'copper', 'small', 'large', 'bolt', 'gear']) AS c)
SELECT w, c AS correction, levenshtein(w, c)::BIGINT AS distance FROM t, v QUALIFY row_number() OVER (PARTITION BY w ORDER BY levenshtein(w, c), c) = 1""")
def token_correction(spark, d):
    """The nearest word of a small dictionary for each distinct token."""
    words = table(spark, d, "part").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    best = F.array_min(F.array(*[F.struct(F.levenshtein("w", F.lit(c)).alias("distance"), F.lit(c).alias("correction")) for c in ("red", "green", "steel", "copper", "small", "large", "bolt", "gear")]))
    return words.select("w", best.alias("b")).select("w", "b.correction", big(F.col("b.distance")).alias("distance"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'b') ORDER BY p_name, p_partkey LIMIT 25")
def prefix_suggest(spark, d):
    """The first 25 names with a prefix: a limit that is the feature."""
    return table(spark, d, "part").where(F.lower("p_name").startswith("b")).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(25)


@query("""WITH h AS (SELECT doc_id, text, regexp_extract(text, '^([A-Z][a-z]{5,})', 1) AS name FROM documents)
SELECT doc_id, name, (len(string_split(text, name)) - 1)::BIGINT AS mentions FROM h WHERE name <> ''""")
def learned_name_mentions(spark, d):
    """A capitalised word that opens a text, and how often the text has it."""
    h = table(spark, d, "documents").select("doc_id", "text", F.regexp_extract("text", "^([A-Z][a-z]{5,})", 1).alias("name")).where("name <> ''")
    return h.select("doc_id", "name", big((F.length("text") - F.length(F.replace("text", F.col("name"), F.lit("")))) / F.length("name")).alias("mentions"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, '. ')) AS s FROM documents), k AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(s), '[a-z]{3,}'))) AS w, s FROM s), o AS (SELECT DISTINCT doc_id, w FROM k WHERE len(w) >= 5)
SELECT doc_id, count(*) AS pairs FROM (SELECT a.doc_id FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.w < b.w AND len(list_intersect(a.w, b.w)) * 4 >= 3 * len(list_distinct(list_concat(a.w, b.w)))) GROUP BY 1""")
def near_dup_lines(spark, d):
    """Pairs of sentences in a document whose word sets overlap by 0.75. Candidates share one of their rarest words."""
    return table(spark, d, "documents").select("doc_id", near_parts(F.lower("text"), ". ", "[a-z]{3,}", 5).alias("pairs")).where("pairs > 0")


#: Corrections of phrases that scanning garbles. Fixed values.
PHRASES = {"teh": "the", "adn": "and", "onhe": "one"}


@query("SELECT doc_id, (len(regexp_extract_all(lower(text), 'teh|adn|onhe')))::BIGINT AS fixes, md5(replace(replace(replace(lower(text), 'teh', 'the'), 'adn', 'and'), 'onhe', 'one')) AS fixed_md5 FROM documents")
def fuzzy_phrase_fix(spark, d):
    c = F.lower("text")
    for bad, good in PHRASES.items():
        c = F.replace(c, F.lit(bad), F.lit(good))
    return table(spark, d, "documents").select("doc_id", T.count_of(F.lower("text"), "|".join(PHRASES)).alias("fixes"), F.md5(c).alias("fixed_md5"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'license|copyright') THEN 'legal' ELSE 'number' END AS field, CASE WHEN regexp_matches(lower(text), 'license|copyright') THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, quality FROM documents JOIN labels USING (doc_id) WHERE regexp_matches(lower(text), 'license|copyright|[0-9]{3}')")
def keyword_label_hydration(spark, d):
    """Weak labels from wording, beside the labels that people gave."""
    legal = F.lower("text").rlike("license|copyright")
    hit = table(spark, d, "documents").where(F.lower("text").rlike("license|copyright|[0-9]{3}"))
    return hit.select("doc_id", F.when(legal, "legal").otherwise("number").alias("field"), F.when(legal, 0.9).otherwise(0.6).alias("confidence")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE regexp_matches(text, '(?:[^ ]{25,})') AND quality = 1")
def omission_scan(spark, d):
    """Documents with a pattern of poor quality whose label says otherwise."""
    hit = table(spark, d, "documents").where(F.col("text").rlike("[^ ]{25,}")).select("doc_id")
    return hit.join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id")


@query(None)
def merged_versions(spark, d):
    """Documents that begin alike, each merged with the first of them as another version of it."""
    # So much of a text as holds 40 characters, each run of others being one.
    head = F.regexp_extract("text", r"^(?:[A-Za-z0-9]|[^A-Za-z0-9]++){40}+", 0)
    docs = table(spark, d, "documents").select("doc_id", "text", F.lower(F.regexp_replace(head, r"[^A-Za-z0-9]+", " ")).alias("opening")).where(F.length("opening") == 40)
    # Of each opening that several documents have the first one's id; texts move after that, only those of such documents.
    many = docs.groupBy("opening").agg(F.min(F.struct("doc_id")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / ALIKE)
    kept = docs.join(many, "opening").withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), parts))
    # Its text goes once to each part of those that begin so, however many they are.
    first = kept.where(F.col("doc_id").eqNullSafe(F.col("head.doc_id"))).groupBy("opening", "n").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    first = first.select("opening", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    pairs = kept.select("opening", "part", "doc_id", "text").join(first, ["opening", "part"]).where(F.col("doc_id") != F.col("first.doc_id"))
    out = pairs.select("doc_id", F.col("first.doc_id").alias("first_id"), merge_versions(F.col("first.text"), F.col("text")).alias("m"))
    return out.select("doc_id", "first_id", "m.aligned", "m.inserted", "m.repaired", F.md5("m.text").alias("text_md5"))


@query(None)
def phrase_repairs(spark, d):
    """Pairs of long words of the benchmark that documents hold in a garbled form, and what they should be."""
    # All neighbours, those that share a word too.
    pair = F.regexp_extract_all("text", F.lit("(?<![A-Za-z])(?=([A-Za-z]{6,} [A-Za-z]{6,}))"), F.lit(1))
    phrases = table(spark, d, "benchmark").select(F.explode(pair).alias("p")).select(F.lower("p").alias("phrase"))
    # A row's place in its file tells rows of one doc_id apart.
    docs = table(spark, d, "documents").select(F.struct("doc_id", "_metadata.file_path", "_metadata.row_index").alias("row"), "text")
    return find_repairs(docs, phrases, id_col="row").select("row.doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "replacement", "score")
