"""Queries over events and conversations: folds, sessions, windows, metrics, JSON, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.operators import reconcile as C
from quillmill.plans.registry import query
from quillmill.sources.shared import shared_folder
from quillmill.sources.tables import table
from quillmill.streaming import cases, folds

big = lambda c: c.cast("bigint")


def _events(spark, d):
    return table(spark, d, "events")


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS last_value, count(*) AS version FROM events GROUP BY 1")
def event_fold_latest(spark, d):
    return C.latest(_events(spark, d), ["user_id"], ["ts", "event_id"], "value")


@query("""WITH l AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS lock FROM events)
SELECT user_id, arg_max(value, (ts, event_id)) AS last_value, count(*) AS version FROM l WHERE lock IS NULL OR (ts, event_id) <= lock GROUP BY 1""")
def event_fold_locked(spark, d):
    """A purchase locks the user's value: later events don't change it."""
    e = _events(spark, d)
    lock = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("lock"))
    free = e.join(lock, "user_id", "left").where(F.col("lock").isNull() | (F.struct("ts", "event_id") <= F.col("lock")))
    return C.latest(free, ["user_id"], ["ts", "event_id"], "value")


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS last_value, count(*) AS version FROM events GROUP BY 1")
def stream_fold_equals_batch(spark, d):
    """The streaming fold, drained: the same as the batch fold."""
    stream = folds.event_stream(spark, d, _events(spark, d).schema, "events.parquet")
    return folds.drained(folds.latest_by_user(stream), "complete", shared_folder(spark))


@query("""SELECT e.event_id, o.o_orderkey FROM events e ASOF JOIN (SELECT o_custkey, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND o.o_orderdate <= TIMESTAMP '1996-01-01' + (e.event_id % 700) * INTERVAL 1 DAY""")
def asof_latest_order(spark, d):
    """As-of join by a union and one window: each event sees the last order before its moment."""
    e = _events(spark, d).select(F.col("user_id").alias("k"), "event_id", F.expr("timestamp_ntz'1996-01-01' + make_dt_interval(cast(event_id % 700 as int))").alias("at"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at")).agg(F.min("o_orderkey").alias("o_orderkey"))
    both = o.select("k", "at", "o_orderkey", F.lit(None).cast("bigint").alias("event_id"), F.lit(0).alias("side")).unionByName(e.select("k", "at", F.lit(None).cast("bigint").alias("o_orderkey"), "event_id", F.lit(1).alias("side")))
    last = F.last("o_orderkey", ignorenulls=True).over(Window.partitionBy("k").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("found", last).where("side = 1 AND found IS NOT NULL").select("event_id", F.col("found").alias("o_orderkey"))


@query("""WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM n) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS began FROM k GROUP BY 1, 2""")
def sessions(spark, d):
    s = C.sessions(_events(spark, d), "user_id", "ts", 1800)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("began"))


@query("SELECT date_trunc('hour', ts) AS began, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    return _events(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("began"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS began, event_type, count(*) AS n FROM events, range(2) AS r(k) GROUP BY 1, 2")
def sliding_counts(spark, d):
    """Windows of two hours that begin every hour."""
    w = _events(spark, d).groupBy(F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("began"), "event_type", "n")


@query("SELECT date_trunc('day', ts) AS began, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark, d):
    """Watermarked windowed counts from a stream, drained in complete mode."""
    stream = folds.event_stream(spark, d, _events(spark, d).schema, "events.parquet")
    out = folds.drained(folds.windowed(stream, "1 hour", "1 day"), "complete", shared_folder(spark))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("began"), "event_type", "n")


@query(None)
def stream_locked_fold(spark, d):
    """Custom state with locks by user; the last state of each."""
    stream = folds.event_stream(spark, d, _events(spark, d).schema, "events.parquet")
    out = folds.drained(folds.locked_fold(stream), "update", shared_folder(spark))
    return out.groupBy("user_id").agg(F.max_by("last_value", "version").alias("last_value"), F.max("version").alias("version"))


@query(None)
def stream_case_versions(spark, d):
    """Users as versioned cases whose paths are event types: a purchase locks its user's prices, a signup unlocks them; settled changes alone."""
    kind = F.col("event_type")
    changes = lambda e: e.select(
        F.col("user_id").cast("string").alias("case_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("change_id"), F.when(kind == "purchase", "lock").when(kind == "signup", "unlock").otherwise("set").alias("action"),
        F.when(kind.isin("purchase", "signup"), "/price").otherwise(F.concat(F.lit("/price/"), kind)).alias("path"), F.col("value").cast("string").alias("value"), F.lit(None).cast("long").alias("expected"))
    stream = folds.event_stream(spark, d, _events(spark, d).schema, "events.parquet")
    return cases.last_of(folds.drained(cases.fold(changes(stream), "1 hour"), "update", shared_folder(spark)))


_LE = [10, 25, 50, 100, 250]


@query("SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{b}" for b in _LE) + ", count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def histogram_buckets(spark, d):
    """Cumulative buckets, count and sum by type, in one pass."""
    return _events(spark, d).groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in _LE], F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, count(*) AS reviewed, count(*) FILTER (value > 50) AS accepted, count(*) FILTER (value > 50) / count(*) AS rate FROM events GROUP BY ROLLUP (event_type)")
def acceptance_rollup(spark, d):
    r = _events(spark, d).rollup("event_type").agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("value") > 50).alias("accepted"))
    return r.withColumn("rate", F.col("accepted") / F.col("reviewed"))


@query("SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k_sum, count(json_extract_string(props, '$.k')) AS present FROM events GROUP BY 1")
def json_path_get(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return _events(spark, d).groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(k).alias("present"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END, event_type) AS merged FROM events")
def deep_merge_fill(spark, d):
    """An overlay's field over the base's: missing ones are filled."""
    overlay = F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k"))
    return _events(spark, d).select("event_id", F.coalesce(overlay, "event_type").alias("merged"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') IS NOT NULL AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL AS issue FROM events")
def schema_coercion(spark, d):
    raw = F.get_json_object("props", "$.k")
    k = F.try_to_number(raw, F.lit("999999999")).cast("bigint")
    return _events(spark, d).select("event_id", k.alias("k"), (raw.isNotNull() & k.isNull()).alias("issue"))


_SETS = "a AS (SELECT DISTINCT user_id, json_extract_string(props, '$.k')::BIGINT % 20 AS code FROM events WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT DISTINCT user_id, json_extract_string(props, '$.k')::BIGINT % 20 AS code FROM events WHERE event_type = (SELECT max(event_type) FROM events)), j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.code, b.code) AS code, a.code IS NOT NULL AS in_a, b.code IS NOT NULL AS in_b FROM a FULL JOIN b ON a.user_id = b.user_id AND a.code = b.code)"


def _compared(spark, d):
    e = _events(spark, d).select("user_id", "event_type", (F.get_json_object("props", "$.k").cast("bigint") % 20).alias("code"))
    low, high = e.agg(F.min("event_type").alias("t")), e.agg(F.max("event_type").alias("t"))
    return C.compare(e.join(F.broadcast(low), F.col("event_type") == F.col("t")), e.join(F.broadcast(high), F.col("event_type") == F.col("t")), ["user_id", "code"])


@query(f"WITH {_SETS} SELECT user_id, count(*) FILTER (in_a AND in_b) AS matched, count(*) FILTER (in_a AND NOT in_b) AS only_a, count(*) FILTER (in_b AND NOT in_a) AS only_b, count(*) FILTER (in_a AND in_b) / count(*) AS agreement FROM j GROUP BY 1")
def setops_reconcile(spark, d):
    return C.counts(_compared(spark, d), "user_id")


@query(f"WITH {_SETS} SELECT user_id, code, CASE WHEN in_a AND in_b THEN 'accept' WHEN in_a THEN 'rule_only' WHEN code % 2 = 0 THEN 'model_only' ELSE 'review' END AS decision FROM j")
def hybrid_merge(spark, d):
    a, b = F.col("in_a"), F.col("in_b")
    return _compared(spark, d).select("user_id", "code", F.when(a & b, "accept").when(a, "rule_only").when(F.col("code") % 2 == 0, "model_only").otherwise("review").alias("decision"))


@query(f"WITH {_SETS} SELECT user_id, code, CASE WHEN in_a THEN 'missing_in_model' ELSE 'missing_in_rules' END AS finding FROM j WHERE in_a <> in_b")
def audit_compare(spark, d):
    return _compared(spark, d).where("in_a <> in_b").select("user_id", "code", F.when(F.col("in_a"), "missing_in_model").otherwise("missing_in_rules").alias("finding"))


@query("SELECT user_id, event_type, max(value) AS best, CASE WHEN max(value) >= 100 THEN 'model' ELSE 'heuristic' END AS chosen FROM events GROUP BY 1, 2")
def edge_merge(spark, d):
    """The best proposal of each edge where it is sure enough, else the heuristic's."""
    best = _events(spark, d).groupBy("user_id", "event_type").agg(F.max("value").alias("best"))
    return best.withColumn("chosen", F.when(F.col("best") >= 100, "model").otherwise("heuristic"))


@query("SELECT conv_id, role, count(*) AS mentions, min(turn) AS first_turn, substr(md5(conv_id || ':' || role), 1, 12) AS entity_id FROM conversations GROUP BY 1, 2")
def entity_ledger(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("mentions"), F.min("turn").alias("first_turn"))
    return g.withColumn("entity_id", F.substring(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), "role")), 1, 12))


@query("SELECT user_id, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return _events(spark, d).groupBy("user_id").agg(F.round(F.percentile("value", 0.5), 4).alias("median"), F.round(F.percentile("value", 0.95), 4).alias("p95"))
