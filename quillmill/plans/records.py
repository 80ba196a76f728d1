"""Queries over records: JSON leaves, patches and merges, and clinical enum fields."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import functions as F

from quillmill.functions import enums
from quillmill.functions import json_docs as D
from quillmill.functions import json_paths as J
from quillmill.plans.registry import query
from quillmill.sources.note_files import note_files, write_list_files
from quillmill.sources.shared import shared_folder


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _record():
    """An event as a record of leaves."""
    return F.map_from_arrays(F.array(*map(F.lit, ("/type", "/props/k", "/day"))), F.array("event_type", F.get_json_object("props", "$.k"), F.date_format("ts", "yyyy-MM-dd")))


@query("SELECT event_id, '/' || key AS path, json_extract_string(props, '$.\"' || key || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) t")
def json_leaves(spark, d):
    return J.leaves(_events(spark, d), "event_id", "props")


@query("""
SELECT event_id, CASE WHEN ok THEN 'sale' ELSE event_type END AS type, CASE WHEN ok THEN k END AS key, CASE WHEN ok THEN NULL ELSE k END AS old_key,
       CASE WHEN ok THEN k END AS was, CASE WHEN ok THEN 'new' END AS flag, CASE WHEN ok THEN 4 ELSE 3 END AS n_leaves
FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, event_type = 'purchase' AS ok FROM events) t
""")
def json_patch(spark, d):
    """Test, move, copy, replace, add and remove in one patch; void where the test fails."""
    steps = [
        {"op": "test", "path": "/type", "value": "purchase"}, {"op": "move", "from": "/props/k", "path": "/key"}, {"op": "copy", "from": "/key", "path": "/was"},
        {"op": "replace", "path": "/type", "value": "sale"}, {"op": "add", "path": "/flag", "value": "new"}, {"op": "remove", "path": "/day"}]
    out = _events(spark, d).select("event_id", J.patch(_record(), steps).alias("r"))
    named = {"type": "/type", "key": "/key", "old_key": "/props/k", "was": "/was", "flag": "/flag"}
    return out.select("event_id", *[J.get(F.col("r"), p).alias(n) for n, p in named.items()], F.size("r").alias("n_leaves"))


_STEPS = [{"op": "test", "path": "/type", "value": "purchase"}, {"op": "add", "path": "/tags/1", "value": "new"}, {"op": "add", "path": "/tags/-", "value": {"n": 1.50}}, {"op": "remove", "path": "/tags/0"},
          {"op": "move", "from": "/p/k~1x", "path": "/k~0"}, {"op": "copy", "from": "/tags/0", "path": "/p/m"}, {"op": "replace", "path": "/day", "value": None}]


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN '["new","b",{"n":1.5}]' ELSE '["a","b"]' END AS tags, CASE WHEN event_type = 'purchase' THEN event_id::VARCHAR END AS moved,
CASE WHEN event_type = 'purchase' THEN 'new' END AS copied, CASE WHEN event_type <> 'purchase' THEN 'another value at /type' END AS error FROM events""")
def json_document_patch(spark, d):
    """A JSON patch with arrays and escaped keys over whole documents; where its test fails the document stays."""
    doc = F.to_json(F.struct(F.col("event_type").alias("type"), F.array(F.lit("a"), F.lit("b")).alias("tags"), F.struct(F.col("event_id").alias("k/x")).alias("p"), F.date_format("ts", "yyyy-MM-dd").alias("day")))
    out = _events(spark, d).select("event_id", D.json_patched(doc, F.lit(json.dumps(_STEPS))).alias("r"))
    at = lambda path: F.get_json_object("r.json", path)
    return out.select("event_id", at("$.tags").alias("tags"), at("$['k~']").alias("moved"), at("$.p.m").alias("copied"), F.col("r.error").alias("error"))


@query("""
SELECT event_id, event_type AS type, CASE WHEN value < 50 THEN NULL WHEN value >= 90 THEN NULL ELSE json_extract_string(props, '$.k') END AS k,
       CASE WHEN value >= 90 THEN 'top' END AS props, CASE WHEN value < 50 THEN 'low' END AS band
FROM events
""")
def json_deep_merge(spark, d):
    """A second record's leaves win over what is at, above and below them; its nulls delete."""
    low = F.create_map(F.lit("/props/k"), F.lit(None).cast("string"), F.lit("/band"), F.lit("low"))
    top = F.create_map(F.lit("/props"), F.lit("top"))
    other = F.when(F.col("value") < 50, low).when(F.col("value") >= 90, top).otherwise(F.create_map().cast("map<string,string>"))
    out = _events(spark, d).select("event_id", J.merge(_record(), other).alias("r"))
    named = {"type": "/type", "k": "/props/k", "props": "/props", "band": "/band"}
    return out.select("event_id", *[J.get(F.col("r"), p).alias(n) for n, p in named.items()])


#: Raw texts that the enum query deals over the orders: a field's phrases, each rule's fragments in a sentence, and texts that mean nothing.
def _raw(field: str) -> list[str]:
    own = enums.FIELDS[field]
    held = [" and ".join(f.lstrip("~^").replace("\\b", "") for f in alternative) for _, alternatives in own.rules for alternative in alternatives]
    return [*own.phrases, *held, *(f"  Patient: {h.upper()} as noted\n" for h in held), *(f"{p} again" for p in own.phrases), "N/A", "unclear", " "]


def _enum_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = lambda rows: ", ".join(f"({', '.join(r)})" for r in rows)
    fragments = lambda x: "[" + ", ".join(map(quote, x)) + "]"
    raw = each((quote(f), str(i), str(len(_raw(f))), quote(t)) for f in enums.FIELDS for i, t in enumerate(_raw(f)))
    phrase = each((quote(f), quote(p), quote(v)) for f, own in enums.FIELDS.items() for p, v in own.phrases.items())
    rule = each((quote(f), str(i), fragments(x), quote(v)) for f, own in enums.FIELDS.items() for i, (v, x) in enumerate((v, x) for v, many in own.rules for x in many))
    never = each((quote(f), fragments(x)) for f, own in enums.FIELDS.items() for x in own.never)
    nothing = each((quote(f), quote(x)) for f, own in enums.FIELDS.items() for x in own.nothing)
    default = each((quote(f), quote("itself" if own.default == enums.ITSELF else own.default)) for f, own in enums.FIELDS.items() if own.default)
    holds = "len(list_filter(frags, lambda f: NOT CASE WHEN starts_with(f, '~') THEN regexp_matches(t.txt, substr(f, 2)) ELSE contains(t.txt, f) END)) = 0"
    return f"""
    WITH raw(field, i, n, own) AS (VALUES {raw}), phrase(field, txt, val) AS (VALUES {phrase}), rule(field, pos, frags, val) AS (VALUES {rule}), never(field, frags) AS (VALUES {never}),
    nothing(field, txt) AS (VALUES {nothing}), fallback(field, val) AS (VALUES {default}),
    t AS (SELECT field, i, n, regexp_replace(own, '^\\s+|\\s+$', '', 'g') AS kept, lower(kept) AS txt FROM raw),
    held AS (SELECT t.field, i, min_by(val, pos) AS val FROM t JOIN rule ON t.field = rule.field AND {holds} GROUP BY ALL),
    meant AS (SELECT t.field, t.i, n, CASE WHEN (t.field, t.txt) IN (SELECT (field, txt) FROM nothing) OR EXISTS (SELECT 1 FROM never WHERE never.field = t.field AND {holds}) THEN NULL
        ELSE coalesce(phrase.val, held.val, CASE WHEN fallback.val = 'itself' THEN kept ELSE fallback.val END) END AS val
        FROM t LEFT JOIN phrase ON phrase.field = t.field AND phrase.txt = t.txt LEFT JOIN held ON held.field = t.field AND held.i = t.i LEFT JOIN fallback ON fallback.field = t.field)
    SELECT field, val AS "value", count(*) AS n FROM orders JOIN meant ON o_orderkey % meant.n = meant.i GROUP BY ALL
    """


@query(_enum_sql())
def clinical_enums(spark, d):
    """Each enum field over raw texts dealt by order: how often each allowed value is meant."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    dealt = F.array(*[F.struct(F.lit(f).alias("field"), F.element_at(F.array(*map(F.lit, _raw(f))), (F.col("o_orderkey") % len(_raw(f)) + 1).cast("int")).alias("raw")) for f in enums.FIELDS])
    # Texts repeat: each is made canonical once.
    texts = orders.select(F.inline(dealt)).groupBy("field", "raw").agg(F.count(F.lit(1)).alias("n"))
    meant = reduce(lambda c, f: c.when(F.col("field") == f, enums.canonical(f, F.col("raw"))), enums.FIELDS, F.when(F.lit(False), F.lit(None).cast("string")))
    return texts.select("field", meant.alias("value"), "n").groupBy("field", "value").agg(F.sum("n").alias("n"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'json_lines' WHEN 1 THEN 'cases' ELSE 'entries' END AS format, md5(trim(text, E' \\t\\r\\n')) AS text_md5 FROM documents WHERE trim(text, E' \\t\\r\\n') <> ''")
def note_formats(spark, d):
    """Documents written as files of four formats and read as one table, the formats told by what the files hold."""
    root = f"{shared_folder(spark)}/notes-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.trim("text", F.lit(" \t\r\n")).alias("text")).where("text <> ''")
    entry = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("note_text"))
    # A thousand documents a file at most: a file is read whole.
    docs.where("doc_id % 4 = 0").select(entry.alias("e")).select("e.*").write.option("maxRecordsPerFile", 1000).json(f"{root}/lines")
    for rest, key in ((1, "cases"), (2, "records"), (3, None)):
        # Some fifty documents a file.
        lists = docs.where(F.col("doc_id") % 4 == rest).groupBy(F.floor(F.col("doc_id") / 200)).agg(F.collect_list(entry).alias("entries")).select("entries")
        write_list_files(lists, f"{root}/{key or 'list'}", key)
    found = note_files(spark, root)
    return found.select(F.col("id").cast("bigint").alias("doc_id"), "format", F.md5("text").alias("text_md5"))


@query("SELECT event_id, [printf('%05d', event_id % 1000 + 31000), 'J' || printf('%04d', user_id % 10000)] AS codes FROM events")
def codes_in_json(spark, d):
    """Codes anywhere in nested JSON: as a number, a key, a text in small letters; what isn't wholly a code isn't one."""
    code, drug = F.format_string("%05d", F.col("event_id") % 1000 + 31000), F.concat(F.lit("j"), F.format_string("%04d", F.col("user_id") % 10000))
    doc = F.concat(F.lit('{"a":['), code, F.lit(',{"b":{"'), drug, F.lit('":null,"c":"code '), code, F.lit('"}}],"d":" '), drug, F.lit(' ","e":1.5,"f":true}'))
    return _events(spark, d).select("event_id", D.codes_anywhere(doc).alias("codes"))
