"""Queries over orders and their lines as encounters and billed codes: rules, bundling, payment, enums, consistency."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as T
from quillmill.operators import bundling as B
from quillmill.operators import rules as R
from quillmill.operators.cycles import cycles
from quillmill.plans.registry import query
from quillmill.sources.tables import table

big = lambda c: c.cast("bigint")

#: Pairs of codes (a code is a part number modulo 20): the first takes in the second. Fixed values.
PAIRS = [(0, 5), (1, 6), (2, 7), (3, 8), (4, 9), (0, 10), (1, 11)]
_PAIRS_SQL = "pairs(primary_code, secondary_code) AS (VALUES " + ", ".join(map(str, PAIRS)) + "), codes AS (SELECT DISTINCT l_orderkey, l_partkey % 20 AS code FROM lineitem)"


def _pairs(spark):
    return spark.createDataFrame(PAIRS, "primary long, secondary long")


def _codes(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 20).alias("code")).distinct()


@query(f"WITH {_PAIRS_SQL} SELECT c.l_orderkey, c.code, (SELECT min(p.primary_code) FROM pairs p JOIN codes o ON o.code = p.primary_code WHERE o.l_orderkey = c.l_orderkey AND p.secondary_code = c.code)::BIGINT AS bundled_into FROM codes c")
def ncci_drop(spark, d):
    return B.drop_bundled(_codes(spark, d), _pairs(spark), "l_orderkey").select("l_orderkey", "code", "bundled_into")


@query(f"WITH {_PAIRS_SQL} SELECT a.l_orderkey, p.primary_code::BIGINT AS primary_code, p.secondary_code::BIGINT AS secondary_code, CASE WHEN (p.primary_code + p.secondary_code) % 2 = 0 THEN 'modifier' ELSE 'deny' END AS action FROM codes a JOIN pairs p ON a.code = p.primary_code JOIN codes b ON b.l_orderkey = a.l_orderkey AND b.code = p.secondary_code")
def ncci_edits(spark, d):
    found = B.ordered_pairs(_codes(spark, d), _pairs(spark), "l_orderkey")
    return found.select("l_orderkey", F.col("primary").alias("primary_code"), F.col("secondary").alias("secondary_code"), F.when((F.col("primary") + F.col("secondary")) % 2 == 0, "modifier").otherwise("deny").alias("action"))


_VALUED = "valued AS (SELECT l_orderkey, l_partkey % 20 AS code, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_PAIRS_SQL}, {_VALUED} SELECT a.l_orderkey, (CASE WHEN a.value < b.value THEN a.code ELSE b.code END)::BIGINT AS dropped FROM valued a JOIN pairs p ON a.code = p.primary_code JOIN valued b ON b.l_orderkey = a.l_orderkey AND b.code = p.secondary_code")
def ncci_hard_bundle(spark, d):
    """Of a pair the code of lower value goes; pairs here don't chain."""
    valued = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 20).alias("code")).agg(F.max("l_extendedprice").alias("value"))
    found = B.ordered_pairs(valued, _pairs(spark), "l_orderkey")
    values = valued.select("l_orderkey", F.col("code").alias("primary"), F.col("value").alias("a")).join(found, ["l_orderkey", "primary"]).join(valued.select("l_orderkey", F.col("code").alias("secondary"), F.col("value").alias("b")), ["l_orderkey", "secondary"])
    return values.select("l_orderkey", F.when(F.col("a") < F.col("b"), F.col("primary")).otherwise(F.col("secondary")).alias("dropped"))


@query("SELECT l_orderkey, p_brand, l_linenumber, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey QUALIFY row_number() OVER (PARTITION BY l_orderkey, p_brand ORDER BY l_extendedprice DESC, l_linenumber) = 1")
def mer_groups(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    kept = B.exclusive_groups(lines.select("l_orderkey", "p_brand", F.col("l_linenumber").alias("code"), "l_extendedprice"), "l_orderkey", "p_brand", "l_extendedprice")
    return kept.select("l_orderkey", "p_brand", F.col("code").alias("l_linenumber"), "l_extendedprice")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN 'primary' ELSE 'secondary' END AS role, CASE WHEN n = 1 THEN l_extendedprice ELSE l_extendedprice * 0.5::DOUBLE END AS allowed FROM r""")
def mer_payment(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("code"), "l_extendedprice")
    return B.multiple_payment(lines, "l_orderkey", "l_extendedprice").select("l_orderkey", F.col("code").alias("l_linenumber"), "role", "allowed")


@query("SELECT p_brand, round(sum(l_quantity * p_retailprice * 33.4009::DOUBLE), 2) AS payment, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def rvu_payment(spark, d):
    """Units times price times the conversion factor, by brand. The sum is rounded far above its rounding error."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    joined = lines.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice"), "l_partkey")
    return joined.groupBy("p_brand").agg(F.round(F.sum(F.col("l_quantity") * F.col("p_retailprice") * 33.4009), 2).alias("payment"), F.count(F.lit(1)).alias("lines"))


@query(f"WITH {_PAIRS_SQL} SELECT l_orderkey, (CASE WHEN code BETWEEN 12 AND 15 AND bool_or(code = 12) OVER (PARTITION BY l_orderkey) AND code <> 12 THEN code + 100 ELSE code END)::BIGINT AS code FROM codes")
def addon_family(spark, d):
    """In a family (12 to 15) codes beside the dominant one become add-on codes."""
    codes = _codes(spark, d)
    dominant = F.max(F.col("code") == 12).over(Window.partitionBy("l_orderkey"))
    return codes.select("l_orderkey", F.when(F.col("code").between(12, 15) & dominant & (F.col("code") != 12), F.col("code") + 100).otherwise(F.col("code")).alias("code"))


#: Rules over an order's facts. Fixed values.
RULES = [
    {"id": "big", "when": {"field": "total", "gte": 200000}},
    {"id": "many", "when": {"field": "lines", "gt": 5}},
    {"id": "urgent_open", "when": {"all": [{"field": "o_orderpriority", "eq": "1-URGENT"}, {"not": {"field": "o_orderstatus", "eq": "F"}}]}},
    {"id": "odd", "when": {"any": [{"field": "o_orderstatus", "in": ["P"]}, {"field": "returned", "gte": 3}]}},
]
_FACTS = "facts AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice AS total, n AS lines, returned FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"
_RULES_SQL = "CASE WHEN total >= 200000 THEN 'big' END, CASE WHEN lines > 5 THEN 'many' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 'urgent_open' END, CASE WHEN o_orderstatus = 'P' OR returned >= 3 THEN 'odd' END"


def _facts(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.col("o_totalprice").alias("total")).join(lines, "o_orderkey", "left")


@query(f"WITH {_FACTS} SELECT o_orderkey, rule FROM (SELECT o_orderkey, unnest([{_RULES_SQL}]) AS rule FROM facts) WHERE rule IS NOT NULL")
def rules_dsl_eval(spark, d):
    return _facts(spark, d).select("o_orderkey", F.explode(R.matched(RULES)).alias("rule"))


STEPS = [
    {"id": "a", "priority": 1, "when": {"field": "total", "gte": 100000}, "add": ["X"]},
    {"id": "b", "priority": 2, "needs": ["X"], "when": {"field": "lines", "gte": 4}, "add": ["Y"], "drop": ["X"]},
    {"id": "c", "priority": 3, "needs": ["Y"], "add": ["Z"]},
]


@query(f"WITH {_FACTS}, a AS (SELECT *, total >= 100000 AS x FROM facts), b AS (SELECT *, x AND coalesce(lines, 0) >= 4 AS y FROM a) SELECT o_orderkey, unnest(CASE WHEN y THEN ['B', 'Y', 'Z'] WHEN x THEN ['B', 'X'] ELSE ['B'] END) AS code FROM b")
def rules_sequential(spark, d):
    return _facts(spark, d).select("o_orderkey", F.explode(R.apply_in_order(F.array(F.lit("B")), STEPS)).alias("code"))


@query(f"WITH {_FACTS} SELECT o_orderkey, total >= 200000 AS old_rule, total >= 190000 AS new_rule FROM facts WHERE (total >= 200000) <> (total >= 190000)")
def rules_shadow_diff(spark, d):
    old, new = (R.compile_predicate({"field": "total", "gte": n}) for n in (200000, 190000))
    return _facts(spark, d).select("o_orderkey", old.alias("old_rule"), new.alias("new_rule")).where("old_rule <> new_rule")


@query("SELECT l_orderkey, CASE WHEN n >= 5 THEN 'many' WHEN n >= 3 THEN 'some' ELSE 'few' END AS code, n FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)")
def station_count_code(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n"))
    return n.select("l_orderkey", F.when(F.col("n") >= 5, "many").when(F.col("n") >= 3, "some").otherwise("few").alias("code"), "n")


@query("SELECT 'part' AS kind, count(*) AS dangling FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) UNION ALL SELECT 'supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def kb_integrity(spark, d):
    """Lines whose code isn't in the (filtered) knowledge tables."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    parts, supp = table(spark, d, "part").where("p_size > 10"), table(spark, d, "supplier").where("s_acctbal > 0")
    a = lines.join(parts, lines["l_partkey"] == parts["p_partkey"], "left_anti").agg(F.count(F.lit(1)).alias("dangling")).select(F.lit("part").alias("kind"), "dangling")
    b = lines.join(supp, lines["l_suppkey"] == supp["s_suppkey"], "left_anti").agg(F.count(F.lit(1)).alias("dangling")).select(F.lit("supplier").alias("kind"), "dangling")
    return a.unionByName(b)


@query("WITH RECURSIVE e(a, b) AS (VALUES (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6)), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a::BIGINT AS node FROM r WHERE a = b")
def kb_cycle_check(spark, d):
    """Nodes of the pair table that reach themselves."""
    return spark.sql("WITH RECURSIVE e(a, b) AS (SELECT * FROM VALUES (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6)), r(a, b, n) AS (SELECT a, b, 1 FROM e UNION ALL SELECT r.a, e.b, n + 1 FROM r JOIN e ON r.b = e.a WHERE n < 6) SELECT DISTINCT CAST(a AS BIGINT) AS node FROM r WHERE a = b")


@query("""WITH RECURSIVE l AS (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem),
e AS (SELECT a, b FROM (SELECT a, b, count(*) AS n FROM l WHERE b IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) <= 2),
p(path, last) AS (SELECT [a, b], b FROM e WHERE a < b UNION ALL SELECT list_append(path, e.b), e.b FROM p JOIN e ON e.a = p.last WHERE e.b > path[1] AND NOT list_contains(path, e.b) AND len(path) < 6)
SELECT array_to_string(path, ' -> ') AS cycle, len(path)::INTEGER AS nodes FROM p JOIN e ON e.a = last AND e.b = path[1] UNION ALL SELECT a::VARCHAR, 1 FROM e WHERE a = b""")
def bundling_cycles(spark, d):
    """Cycles of up to six suppliers, each of which is among the two that most often follow the one before in an order."""
    inside = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.lead("l_suppkey").over(inside).alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    edges = pairs.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where("r <= 2")
    return cycles(edges, 6).select(F.array_join(F.col("cycle").cast("array<string>"), " -> ").alias("cycle"), F.size("cycle").alias("nodes"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END AS quality, toxic, toxic = 1 AND quality = 1 AS flagged FROM labels")
def label_constraints(spark, d):
    both = (F.col("toxic") == 1) & (F.col("quality") == 1)
    return table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality")).alias("quality"), "toxic", both.alias("flagged"))


_ENUM = {"urgent": "stat", "high": "soon", "medium": "routine", "low": "routine"}


@query("SELECT CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'stat' WHEN contains(lower(o_orderpriority), 'high') THEN 'soon' WHEN contains(lower(o_orderpriority), 'medium') OR contains(lower(o_orderpriority), 'low') THEN 'routine' ELSE 'unknown' END AS priority, count(*) AS n FROM orders GROUP BY 1")
def enum_normalize(spark, d):
    return table(spark, d, "orders").groupBy(T.normalized_enum(F.col("o_orderpriority"), _ENUM, "unknown").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%Y-%m-%d') AS iso, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS day_offset FROM orders")
def date_normalize(spark, d):
    """Dates written one way, parsed by the first format that fits, and their offset from an anchor."""
    us = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("us"))
    day = F.coalesce(F.try_to_date("us", "yyyy-MM-dd"), F.try_to_date("us", "MM/dd/yyyy"))
    return us.select("o_orderkey", "us", F.date_format(day, "yyyy-MM-dd").alias("iso"), big(F.datediff(day, F.lit("1992-01-01").cast("date"))).alias("day_offset"))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS statuses, count(*) AS children FROM lineitem GROUP BY 1")
def granular_to_aggregate(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_returnflag") == "R").alias("any_returned"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("statuses"), F.count(F.lit(1)).alias("children"))


@query("SELECT o_orderkey, o_orderstatus, n_open FROM orders JOIN (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'O') AS n_open FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND n_open > 0")
def consistency_check(spark, d):
    """Parents marked final that have open children."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_linestatus") == "O").alias("n_open"))
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus").join(n.where("n_open > 0"), "o_orderkey")


@query("SELECT o_orderkey, ((o_orderpriority IS NOT NULL)::INT + (o_totalprice > 1000)::INT + (o_orderstatus <> 'P')::INT) / 3 AS score FROM orders")
def completeness_score(spark, d):
    have = F.col("o_orderpriority").isNotNull().cast("int") + (F.col("o_totalprice") > 1000).cast("int") + (F.col("o_orderstatus") != "P").cast("int")
    return table(spark, d, "orders").select("o_orderkey", (have / 3).alias("score"))


@query("SELECT o_orderkey, md5('Order ' || o_orderkey || E'\\n' || 'Lines: ' || n || E'\\n' || 'Status: ' || o_orderstatus) AS report_md5 FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def report_render(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(n, "o_orderkey").select("o_orderkey", F.md5(F.format_string("Order %d\nLines: %d\nStatus: %s", "o_orderkey", "n", "o_orderstatus")).alias("report_md5"))


@query("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_flags(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(big(F.grouping_id()).alias("level"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT l_orderkey, max((l_returnflag = 'A')::INT) AS a, max((l_returnflag = 'N')::INT) AS n, max((l_returnflag = 'R')::INT) AS r FROM lineitem GROUP BY 1")
def multi_hot(spark, d):
    one = lambda v: F.max((F.col("l_returnflag") == v).cast("int")).alias(v.lower())
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(one("A"), one("N"), one("R"))


@query("SELECT l_partkey % 50 AS label, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 1200")
def rare_label_filter(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("label")).agg(F.count(F.lit(1)).alias("n")).where("n >= 1200")


@query("SELECT coalesce(a.s, b.s) AS status, coalesce(a.n, 0) AS baseline, coalesce(b.n, 0) AS current_n, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE year(o_orderdate) = 1994 GROUP BY 1) a FULL JOIN (SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1) b ON a.s = b.s")
def report_delta(spark, d):
    n = table(spark, d, "orders").where(F.year("o_orderdate").isin(1994, 1995)).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if(F.year("o_orderdate") == 1994).alias("baseline"), F.count_if(F.year("o_orderdate") == 1995).alias("current_n"))
    return n.withColumn("delta", F.col("current_n") - F.col("baseline"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000) AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def run_list_page(spark, d):
    """A page of a filtered, sorted list with the total: limit and offset are the feature."""
    found = table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 100000))
    page = found.select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50)
    return page.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))), F.lit(True))


@query("SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R')")
def one_hop_expand(spark, d):
    """Neighbours of a region's nations that aren't in the target set."""
    nation, region, supplier = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    near = region.where("r_name = 'ASIA'").join(nation, F.col("n_regionkey") == F.col("r_regionkey")).join(supplier, F.col("s_nationkey") == F.col("n_nationkey"))
    target = table(spark, d, "lineitem").where((F.col("l_quantity") > 49) & (F.col("l_returnflag") == "R")).select("l_suppkey")
    return near.join(target, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("n_name", "s_suppkey")
