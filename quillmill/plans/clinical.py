"""Queries over clinical values and detected personal data.

The tables have no clinical notes, so phrases are dealt over all orders by key, with a number of the order
in them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import clinical as C
from quillmill.operators import detectors as D
from quillmill.plans.registry import query

IMAGING = (
    "Nodule of {n} x 12.5 x 9 mm, SUV max {n}.5, increased", "Mass {n} x 8 cm is smaller; SUV: 3.1, delayed SUV 4.2", "a {n}.5 mm lesion, unchanged",
    "New node, {n} cm, resolution of another", "SUV 2.4 and SUVmax 2.4 in the lobe, stable", "SUV 2.4 then SUV {n}", "enlarged, uptake increases to {n}.2", "No finding", "")
DATES = (
    "2024-02-{n}", "3/{n}/2021", "12-{n}-99", "2020/1/{n}", "March {n}, 2022", "{n} Sep 2019", "seen on 4/{n}/23 in clinic", "note {n}Nov17", "13/{n}/2020", "unknown", "null", "")
STATIONS = ("station {n}", "11Rs", "11 li", "4r", "node: 10L", "7", "subcarinal 7", "lung 7", "stn 3p", "42R", "{n}R", "none", "")
CODES = ("31652, 31653-26", "+31654", "31652 convex probe; 31652", " 3162{n}", "316{n}", "none", "")
TIMES = ("{n}30", "7:{n} am", "12:{n} AM", "12:05 pm", "23:{n}", "{n}:15 PM", "noon", "")


def _dealt(spark, d, phrases):
    """(o_orderkey, raw): each order's phrase with the number of its key in place of {n}."""
    key = F.col("o_orderkey")
    phrase = F.element_at(F.array(*map(F.lit, phrases)), (key % len(phrases) + 1).cast("int"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.replace(phrase, F.lit("{n}"), (key % 31 + 1).cast("string")).alias("raw"))


def _dealt_sql(phrases):
    quoted = ", ".join(f"'{p}'" for p in phrases)
    return f"t AS (SELECT o_orderkey, replace(([{quoted}])[(o_orderkey % {len(phrases)} + 1)::INT], '{{n}}', (o_orderkey % 31 + 1)::VARCHAR) AS raw FROM orders)"


def _num_sql(pattern, group=1):
    return f"TRY_CAST(regexp_extract(raw, '{pattern}', {group}) AS DOUBLE)"


def _mm_sql(pattern, group, n):
    return f"round_even({_num_sql(pattern, group)} * CASE WHEN lower(regexp_extract(raw, '{pattern}', {n + 1})) = 'cm' THEN 10 ELSE 1 END, 0)::INT"


def _axis_sql(group):
    cases = " ".join(f"WHEN regexp_matches(raw, '{p}') THEN {_mm_sql(p, group, n) if group <= n else 'NULL'}" for p, n in ((C.SIZE3, 3), (C.SIZE2, 2), (C.SIZE1, 1)))
    return f"CASE {cases} END"


@query(f"WITH {_dealt_sql(IMAGING)} SELECT o_orderkey, {_axis_sql(1)} AS a_mm, {_axis_sql(2)} AS b_mm, {_axis_sql(3)} AS c_mm, CASE WHEN {_axis_sql(1)} IS NULL THEN '' ELSE ({_axis_sql(1)} // 5 * 5)::VARCHAR END AS bucket FROM t")
def imaging_sizes(spark, d):
    s = _dealt(spark, d, IMAGING).withColumn("s", C.sizes_mm(F.col("raw")))
    return s.select("o_orderkey", *[F.col(f"s.{x}").alias(f"{x}_mm") for x in "abc"], C.size_bucket(F.col("s.a")).alias("bucket"))


@query(f"""WITH {_dealt_sql(IMAGING)}, v AS (SELECT *, list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(raw, '{C.SUV_ANY}', 1), lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x <= 100), lambda x: round_even(x, 1))) AS u FROM t)
SELECT o_orderkey, {_num_sql(C.SUV)} AS suv, {_num_sql(C.SUV_DELAYED)} AS delayed, CASE WHEN len(u) = 1 THEN u[1] END AS agreed FROM v""")
def imaging_uptake(spark, d):
    raw = F.col("raw")
    return _dealt(spark, d, IMAGING).select("o_orderkey", C.suv_values(raw)["suv"].alias("suv"), C.suv_values(raw)["delayed"].alias("delayed"), C.agreed_suv(raw).alias("agreed"))


@query(f"""WITH {_dealt_sql(IMAGING)}, f AS (SELECT *, regexp_matches(raw, '{C.INCREASE}') AS up, regexp_matches(raw, '{C.DECREASE}') AS down FROM t)
SELECT o_orderkey, CASE WHEN up AND down THEN 'Mixed' WHEN up THEN 'Progression' WHEN down THEN 'Response' WHEN regexp_matches(raw, '{C.STABLE}') THEN 'Stable' ELSE 'Indeterminate' END AS response,
       CASE {' '.join(f"WHEN regexp_matches(raw, '{p}') THEN '{label}'" for label, p in C.CHANGES.items())} END AS change FROM f""")
def imaging_response(spark, d):
    return _dealt(spark, d, IMAGING).select("o_orderkey", C.response(F.col("raw")).alias("response"), C.change(F.col("raw")).alias("change"))


@query(f"""WITH {_dealt_sql(DATES)}, p AS (SELECT *, regexp_extract(raw, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}') AS n, regexp_extract(raw, '[0-9]{{1,2}}[A-Za-z]{{3}}[0-9]{{2,4}}') AS c FROM t)
SELECT o_orderkey, strftime(CASE WHEN regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime(raw, '%Y-%m-%d')
  ELSE coalesce(try_strptime(raw, ['%m/%d/%y', '%m-%d-%y', '%m/%d/%Y', '%m-%d-%Y', '%Y/%m/%d', '%Y-%m-%d', '%B %d, %Y', '%b %d, %Y', '%d %B %Y', '%d %b %Y']),
    try_strptime(n, ['%m/%d/%y', '%m-%d-%y', '%m/%d/%Y', '%m-%d-%Y']), try_strptime(c, ['%d%b%y', '%d%b%Y'])) END, '%Y-%m-%d') AS day FROM p""")
def clinical_dates(spark, d):
    return _dealt(spark, d, DATES).select("o_orderkey", C.iso_date(F.col("raw")).alias("day"))


@query(f"""WITH {_dealt_sql(STATIONS)}, c AS (SELECT *, upper(raw) AS up, regexp_replace(regexp_replace(upper(raw), '^(STATION|STN|NODE)[\\s:]*', ''), '\\s+', '', 'g') AS cleaned FROM t),
b AS (SELECT *, regexp_extract(cleaned, '{C.STATION}', 1) AS base, regexp_extract(cleaned, '{C.STATION}', 2) AS suffix FROM c)
SELECT o_orderkey, CASE WHEN base = '' THEN NULL WHEN base IN ('11R', '11L') THEN base || suffix
  WHEN base IN ('5', '7', '8', '9') AND cleaned <> base AND NOT contains(cleaned, 'SUBCARINAL') AND NOT contains(up, 'STATION') THEN NULL ELSE base END AS station FROM b""")
def nodal_stations(spark, d):
    return _dealt(spark, d, STATIONS).select("o_orderkey", C.station(F.col("raw")).alias("station"))


@query(f"""WITH {_dealt_sql(CODES)} SELECT o_orderkey, nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(raw, '\\b([0-9]{{5}}(-[0-9]{{2}})?)\\b', 1))), ' '), '') AS codes,
  CASE WHEN regexp_full_match(trim(raw), '\\+?\\s*[0-9]{{5}}') THEN right(trim(raw), 5) END AS bare,
  nullif(array_to_string(list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS items FROM t""")
def code_lists(spark, d):
    raw = F.col("raw")
    return _dealt(spark, d, CODES).select("o_orderkey", F.array_join(F.array_sort(C.procedure_codes(raw)), " ").alias("codes"), C.bare_code(raw).alias("bare"), F.array_join(C.list_items(raw), "|").alias("items"))


_CLOCK = r"(?i)^\s*([0-9]{1,2}):?([0-9]{2})\s*([AP]M)?\s*$"


@query(f"""WITH {_dealt_sql(TIMES)}, p AS (SELECT o_orderkey, TRY_CAST(regexp_extract(raw, '{_CLOCK}', 1) AS INT) AS h, TRY_CAST(regexp_extract(raw, '{_CLOCK}', 2) AS INT) AS m, upper(regexp_extract(raw, '{_CLOCK}', 3)) AS half FROM t),
q AS (SELECT o_orderkey, m, CASE WHEN half = '' OR h NOT BETWEEN 1 AND 12 THEN h WHEN half = 'AM' THEN h % 12 ELSE h % 12 + 12 END AS h FROM p),
r AS (SELECT o_orderkey, CASE WHEN h <= 23 AND m <= 59 THEN format('{{:02d}}:{{:02d}}', h, m) END AS clock, CASE WHEN h <= 23 AND m <= 59 THEN h * 60 + m END AS start FROM q)
SELECT o_orderkey, clock, CASE WHEN o_orderkey % 5 = 0 THEN 40 WHEN start IS NULL THEN NULL WHEN start > 615 THEN 2055 - start ELSE 615 - start END AS minutes FROM r""")
def clock_durations(spark, d):
    """Clock times, and the minutes from them to 10:15 where none are stated."""
    t = _dealt(spark, d, TIMES).withColumn("clock", C.clock_time(F.col("raw")))
    stated = F.when(F.col("o_orderkey") % 5 == 0, 40)
    return t.select("o_orderkey", "clock", C.duration_minutes(stated, F.col("clock"), F.lit("10:15")).alias("minutes"))


@query(None)
def doc_detected_spans(spark, d):
    """All detectors over all documents, overlaps merged; tested against a plain search, as SQL has no look-around."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = docs.select("doc_id", F.inline(D.merge_strongest(D.detect(F.col("text")))))
    return out.select("doc_id", "type", "start", "end", "confidence", D.span_id(F.col("doc_id"), F.col("start"), F.col("end"), F.col("type")).alias("span_id"))
