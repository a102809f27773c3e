"""Queries over gates, selections, joins and set operations, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import formulas as M
from tessera.functions import text as R
from tessera.operators import aggregates as A
from tessera.operators import gates as G
from tessera.operators import joins as J
from tessera.operators import selection as T
from tessera.operators.quantiles import exact_quantiles, linear_spots
from tessera.plans.registry import query, read

c = F.col


@query("""
WITH g AS (SELECT *, value * 2 AS fitness FROM events WHERE event_type <> 'error' AND value >= 10 AND value <= 400),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fitness DESC, event_id) rn FROM g) WHERE rn = 1)
SELECT event_id, user_id, event_type, round(fitness, 6) AS fitness, CAST(row_number() OVER (ORDER BY fitness DESC, event_id) AS INTEGER) AS rank
FROM b ORDER BY fitness DESC, event_id LIMIT 25""")
def elite_topk(spark: SparkSession, d: str) -> DataFrame:
    e = G.gate(read(spark, d, "events"), [("value", ">=", 10.0), ("value", "<=", 400.0)]).where((c("is_valid") == 1) & (c("event_type") != "error"))
    best = T.keep_best(e.withColumn("fitness", c("value") * 2), ["user_id"], [c("fitness").desc(), c("event_id")])
    top = T.numbered(best, [c("fitness").desc(), c("event_id")], 25)
    return top.select("event_id", "user_id", "event_type", F.round("fitness", 6).alias("fitness"), "rank")


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 50000 AND o_totalprice <= 300000 AND o_orderstatus <> 'P' THEN 1 ELSE 0 END AS is_valid FROM orders")
def gate_flag(spark, d):
    o = read(spark, d, "orders").withColumn("open", (c("o_orderstatus") != "P").cast("int"))
    return G.gate(o, [("o_totalprice", ">=", 50000.0), ("o_totalprice", "<=", 300000.0), ("open", "==", 1), ("absent", "<=", 1)], optional={"absent"}).select("o_orderkey", "is_valid")


@query("""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN lang NOT IN ('en', 'fr') THEN 'language' WHEN n_chars > 8000 THEN 'long' ELSE 'ok' END AS reason FROM documents) GROUP BY reason""")
def reason_counts(spark, d):
    docs = read(spark, d, "documents").select("n_chars", "lang")
    return A.value_counts(G.first_failure(docs, [("short", c("n_chars") >= 200), ("language", c("lang").isin("en", "fr")), ("long", c("n_chars") <= 8000)]), ["reason"])


@query("""
WITH t AS (SELECT count(*) FILTER (l_quantity >= 10) a0, count(*) FILTER (l_quantity >= 10 AND l_discount <= 0.05) n1, count(*) FILTER (l_discount <= 0.05) a1,
 count(*) FILTER (l_quantity >= 10 AND l_discount <= 0.05 AND l_returnflag = 'N') n2, count(*) FILTER (l_returnflag = 'N') a2 FROM lineitem)
SELECT 0 AS step_no, 'quantity' AS step, a0 AS n, a0 AS n_alone FROM t UNION ALL SELECT 1, 'discount', n1, a1 FROM t UNION ALL SELECT 2, 'flag', n2, a2 FROM t""")
def filter_funnel(spark, d):
    return G.funnel(read(spark, d, "lineitem"), [("quantity", c("l_quantity") >= 10), ("discount", c("l_discount") <= 0.05), ("flag", c("l_returnflag") == "N")])


@query("SELECT count(*) AS n FROM (SELECT CASE WHEN l_tax > 0.02 THEN l_tax END t, CASE WHEN l_discount > 0.02 THEN l_discount END s FROM lineitem) WHERE t IS NOT NULL AND s IS NOT NULL")
def required_nonnull(spark, d):
    li = read(spark, d, "lineitem").select(F.when(c("l_tax") > 0.02, c("l_tax")).alias("t"), F.when(c("l_discount") > 0.02, c("l_discount")).alias("s"))
    return G.all_present(li, ["t", "s"]).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT CASE WHEN l_tax > 0.02 THEN l_tax END t, CASE WHEN l_discount > 0.02 THEN l_discount END s FROM lineitem) WHERE t IS NOT NULL OR s IS NOT NULL")
def any_nonnull(spark, d):
    li = read(spark, d, "lineitem").select(F.when(c("l_tax") > 0.02, c("l_tax")).alias("t"), F.when(c("l_discount") > 0.02, c("l_discount")).alias("s"))
    return G.any_present(li, ["t", "s"]).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE NOT (l_quantity > 45 OR l_extendedprice > 60000) AND (l_tax <= 0.06 OR l_tax IS NULL) GROUP BY l_returnflag")
def outlier_any_column(spark, d):
    li = G.without_outliers(read(spark, d, "lineitem"), ["l_quantity"], high=45)
    return A.value_counts(G.at_most_or_missing(G.without_outliers(li, ["l_extendedprice"], low=0, high=60000), "l_tax", 0.06), ["l_returnflag"])


@query("SELECT count(*) AS n FROM part WHERE p_retailprice BETWEEN 950 AND 1400 AND abs(p_retailprice) < 1e308")
def range_finite(spark, d):
    return G.finite(G.in_range(read(spark, d, "part"), "p_retailprice", 950, 1400), ["p_retailprice"]).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size > 45 THEN 'excluded' WHEN p_type LIKE '%STEEL%' THEN 'steel' ELSE 'other' END AS category FROM part")
def category_assign(spark, d):
    return read(spark, d, "part").select("p_partkey", G.categorise([(c("p_size") > 45, "excluded"), (c("p_type").contains("STEEL"), "steel")], "other").alias("category"))


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.9) AS p90, quantile_cont(o_totalprice, 0.95) AS p95 FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice <= p90 THEN 'green' WHEN o_totalprice <= p95 THEN 'amber' ELSE 'red' END AS zone FROM orders, q""")
def zone_classify(spark, d):
    o = read(spark, d, "orders")
    p90, p95 = exact_quantiles(o, [], c("o_totalprice"), linear_spots([0.9, 0.95])).first().quantiles
    return o.select("o_orderkey", G.zone(c("o_totalprice"), p90, p95).alias("zone"))


@query("""
SELECT p_partkey, CASE WHEN n >= 3 THEN 1 WHEN n >= 2 THEN 2 WHEN n >= 1 THEN 3 ELSE 4 END AS tier FROM (
 SELECT p_partkey, CAST(p_size <= 25 AS INT) + CAST(p_retailprice <= 1200 AS INT) + CAST(p_brand < 'Brand#3' AS INT) AS n FROM part)""")
def tier_assign(spark, d):
    return read(spark, d, "part").select("p_partkey", G.tier([c("p_size") <= 25, c("p_retailprice") <= 1200, c("p_brand") < "Brand#3"], [3, 2, 1]).alias("tier"))


@query("""
WITH m AS (SELECT p_brand, 'size' AS prop, avg(p_size) AS mean, stddev_samp(p_size) AS sd FROM part GROUP BY p_brand
 UNION ALL SELECT p_brand, 'price', avg(p_retailprice), stddev_samp(p_retailprice) FROM part GROUP BY p_brand),
g AS (SELECT * FROM (VALUES ('size', 'max', 25.0), ('price', 'min', 1300.0)) v(prop, sense, threshold))
SELECT p_brand, prop, CASE WHEN sense = 'max' THEN mean <= threshold ELSE mean >= threshold END AS passed, coalesce(abs(mean - threshold) <= sd, false) AS marginal FROM m JOIN g USING (prop)""")
def gate_marginal(spark, d):
    p = read(spark, d, "part")
    m = p.groupBy("p_brand").agg(F.avg("p_size").alias("a"), F.stddev_samp("p_size").alias("b"), F.avg("p_retailprice").alias("e"), F.stddev_samp("p_retailprice").alias("f"))
    m = m.selectExpr("p_brand", "stack(2, 'size', a, b, 'price', e, f) as (prop, mean, sd)")
    gates = spark.createDataFrame([("size", "max", 25.0), ("price", "min", 1300.0)], "prop string, sense string, threshold double")
    return G.gate_margins(m, gates, ["p_brand"])


# ---------------------------------------------------------------- joins


@query("SELECT o_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_inner_props(spark, d):
    li = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return li.join(read(spark, d, "orders"), "o_orderkey").select("o_orderkey", "l_linenumber", F.round(c("l_extendedprice") * (1 - c("l_discount")), 6).alias("net"), "o_orderpriority")


@query("""
SELECT o_orderkey, c_name, n_name, r_name, n_lines FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def left_chain5(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", c("o_custkey").alias("c_custkey"))
    lines = read(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    cust = read(spark, d, "customer").select("c_custkey", "c_name", c("c_nationkey").alias("n_nationkey"))
    nation = read(spark, d, "nation").select("n_nationkey", "n_name", c("n_regionkey").alias("r_regionkey"))
    out = J.left_chain(o, [(cust, "c_custkey"), (nation, "n_nationkey"), (read(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey"), (lines, "o_orderkey")])
    return out.select("o_orderkey", "c_name", "n_name", "r_name", "n_lines")


@query("""
WITH a AS (SELECT o_custkey, count(*) n, round(sum(o_totalprice), 4) total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, count(*) n, round(sum(o_totalprice), 4) total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_custkey, a.n AS n_done, b.n AS n_open, a.total AS total_done, b.total AS total_open FROM a JOIN b USING (o_custkey)""")
def overlap_suffix(spark, d):
    o = read(spark, d, "orders")
    of = lambda s: o.where(c("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"))
    return J.overlap(of("F"), of("O"), "o_custkey", ("_done", "_open"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def lookup_default(spark, d):
    n = read(spark, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return J.lookup(read(spark, d, "customer").select("c_custkey"), n, "c_custkey", "n", 0, "n_orders")


@query("""
WITH u AS (SELECT o_custkey k, max(o_totalprice) v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), h AS (SELECT o_custkey k, max(o_totalprice) v FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1)
SELECT c_custkey, round(coalesce(u.v, h.v, c_acctbal), 6) AS price FROM customer LEFT JOIN u ON u.k = c_custkey LEFT JOIN h ON h.k = c_custkey""")
def lookup_priority(spark, d):
    o = read(spark, d, "orders")
    of = lambda p: o.where(c("o_orderpriority") == p).groupBy(c("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    out = J.lookup_first(read(spark, d, "customer"), [(of("1-URGENT"), "v"), (of("2-HIGH"), "v")], "c_custkey", "price", c("c_acctbal"))
    return out.select("c_custkey", F.round("price", 6).alias("price"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_train(spark, d):
    return J.seen(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), read(spark, d, "orders").where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_new(spark, d):
    return J.unseen(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT p_partkey, p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS is_novel FROM part")
def novelty_flag(spark, d):
    return J.novelty(read(spark, d, "part").select("p_partkey"), read(spark, d, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey")


@query("""
WITH e AS (SELECT user_id, event_type, value, (event_id % 100) * 1.0 AS x FROM events),
g AS (SELECT user_id, event_type, avg(CASE WHEN x = 50 THEN value END) AS direct, max(CASE WHEN x < 50 THEN {'x': x, 'v': value} END) AS lo, min(CASE WHEN x > 50 THEN {'x': x, 'v': value} END) AS hi, count(*) AS n FROM e GROUP BY 1, 2)
SELECT user_id, event_type, round(CASE WHEN direct IS NOT NULL THEN direct WHEN hi.x - lo.x <= 30 THEN lo.v + (hi.v - lo.v) * (50 - lo.x) / (hi.x - lo.x) END, 6) AS value,
 CASE WHEN direct IS NOT NULL THEN 'direct' WHEN hi.x - lo.x <= 30 THEN 'interpolated' ELSE 'none' END AS method, n FROM g""")
def bracket_interp(spark, d):
    e = read(spark, d, "events").withColumn("x", (c("event_id") % 100).cast("double"))
    out = J.bracket(e, ["user_id", "event_type"], "x", "value", 50.0, 30.0)
    return out.withColumn("value", F.round("value", 6))


@query("""
SELECT p_partkey, round(CASE WHEN p_retailprice <= 950 THEN 1.0 WHEN p_retailprice <= 1200 THEN 1 + (p_retailprice - 950) * (2.0 / 250) WHEN p_retailprice <= 1500 THEN 3 + (p_retailprice - 1200) * (1.0 / 300) ELSE 4 END, 6) AS y FROM part""")
def interp_clamped(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(J.interpolate(c("p_retailprice"), [(950.0, 1.0), (1200.0, 3.0), (1500.0, 4.0)]), 6).alias("y"))


@query("""
SELECT a_min, b_max, count(p_partkey) AS n, max(p_partkey) AS best FROM (VALUES (10.0::DOUBLE), (25.0), (40.0)) a(a_min) CROSS JOIN (VALUES (950.0::DOUBLE), (1100.0), (1300.0)) b(b_max)
LEFT JOIN part ON p_size >= a_min AND p_retailprice <= b_max GROUP BY a_min, b_max""")
def threshold_grid(spark, d):
    return J.threshold_grid(read(spark, d, "part"), "p_size", [10.0, 25.0, 40.0], "p_retailprice", [950.0, 1100.0, 1300.0], "p_partkey")


@query("""
WITH f AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20), s AS (SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM f) ORDER BY p_size DESC, p_partkey LIMIT 10)
SELECT p_partkey, 'first' AS pick FROM f UNION ALL SELECT p_partkey, 'second' FROM s""")
def hybrid_elite(spark, d):
    return T.hybrid_elite(read(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), [c("p_retailprice").desc(), c("p_partkey")], 20, [c("p_size").desc(), c("p_partkey")], 10, "p_partkey").select("p_partkey", "pick")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END DESC, event_id DESC) rn FROM events) WHERE rn = 1""")
def keep_last_priority(spark, d):
    p = F.when(c("event_type") == "purchase", 3).when(c("event_type") == "click", 2).otherwise(1)
    return T.keep_last(read(spark, d, "events"), ["user_id"], p, [c("event_id").desc()]).select("user_id", "event_id", "event_type")


@query("""
SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) a, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) b FROM part) WHERE a <= 5 OR b <= 5""")
def groupwise_topk(spark, d):
    return T.groupwise_top(read(spark, d, "part"), ["p_brand"], [[c("p_retailprice").desc(), c("p_partkey")], [c("p_size"), c("p_partkey")]], 5).select("p_brand", "p_partkey")


_DRAW = "(('0x' || substr(md5({k} || '#{s}'), 1, 8))::BIGINT + 0.5) / 4294967296.0"


@query(f"""
WITH s AS (SELECT *, {_DRAW.format(k="o_orderkey::VARCHAR", s=3)} AS u FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY u, o_orderkey) rn, count(*) OVER (PARTITION BY o_orderpriority) n FROM s)
SELECT o_orderkey, o_orderpriority FROM r WHERE rn <= greatest(1, floor(n * 0.05))""")
def stratified_sample(spark, d):
    return T.stratified(read(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", 0.05, 3).select("o_orderkey", "o_orderpriority")


@query(f"SELECT c_custkey FROM customer ORDER BY {_DRAW.format(k='c_custkey::VARCHAR', s=1)}, c_custkey LIMIT 100")
def random_sample(spark, d):
    return T.random_sample(read(spark, d, "customer").select("c_custkey"), "c_custkey", 100, 1)


@query(f"SELECT p_partkey FROM part ORDER BY -ln({_DRAW.format(k='p_partkey::VARCHAR', s=2)}) / greatest(p_size / 10.0, 0.01), p_partkey LIMIT 50")
def weighted_sample(spark, d):
    return T.weighted_sample(read(spark, d, "part"), "p_partkey", c("p_size") / 10.0, 50, 2).select("p_partkey")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) rn FROM events) WHERE rn <= 3")
def capped_per_key(spark, d):
    return T.capped(read(spark, d, "events"), ["user_id", "event_type"], [c("ts"), c("event_id")], 3).select("user_id", "event_type", "event_id")


@query("""
SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) rn FROM events) WHERE rn <= 10 ORDER BY value DESC, event_id LIMIT 100""")
def replay_buffer(spark, d):
    return T.replay_buffer(read(spark, d, "events"), "user_id", [c("value").desc(), c("event_id")], 10, 100).select("event_id", "user_id")


@query("SELECT doc_id, toxic, CAST(i AS INTEGER) AS copy FROM labels, range(0, 3) r(i) WHERE toxic = 1 OR i = 0")
def oversample_minority(spark, d):
    return T.oversample(read(spark, d, "labels"), "toxic", 1, 3).select("doc_id", "toxic", "copy")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return read(spark, d, "customer").select(c("c_nationkey").alias("k")).intersect(read(spark, d, "supplier").select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_except(spark, d):
    return read(spark, d, "orders").select(c("o_custkey").alias("k")).subtract(read(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return read(spark, d, "customer").select(c("c_nationkey").alias("k")).union(read(spark, d, "supplier").select("s_nationkey")).distinct()


@query("""
WITH a AS (SELECT DISTINCT l_partkey k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey k FROM lineitem WHERE l_returnflag = 'A')
SELECT CASE WHEN a.k IS NULL THEN 'b' WHEN b.k IS NULL THEN 'a' ELSE 'both' END AS source, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def source_tags(spark, d):
    li = read(spark, d, "lineitem")
    of = lambda f, n: li.where(c("l_returnflag") == f).select(c("l_partkey").alias("k")).distinct().withColumn(n, F.lit(True))
    j = of("R", "a").join(of("A", "b"), "k", "full")
    return j.groupBy(F.when(c("a").isNull(), "b").when(c("b").isNull(), "a").otherwise("both").alias("source")).agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey AS k, round(c_acctbal, 6) AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, round(-c_acctbal, 6) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0""")
def merge_existing(spark, d):
    cu = read(spark, d, "customer")
    old = cu.where("c_custkey % 3 = 0").select(c("c_custkey").alias("k"), F.round("c_acctbal", 6).alias("v"))
    new = cu.where("c_custkey % 2 = 0").select(c("c_custkey").alias("k"), F.round(-c("c_acctbal"), 6).alias("v"))
    return J.merge_keep_existing(old, new, "k")


# ---------------------------------------------------------------- formulae and text


@query("""
SELECT p_partkey, CASE WHEN p_size > 0 THEN round((p_size / 100.0) * pow((p_retailprice * 2.5) / (p_size * (p_size / 100.0)), 0.2813), 6) END AS fom FROM part""")
def fom1(spark, d):
    one = F.lit(1.0)
    return read(spark, d, "part").select("p_partkey", F.round(M.merit(c("p_retailprice"), F.lit(2.5), one, c("p_size").cast("double"), c("p_size") / 100.0), 6).alias("fom"))


@query("""
SELECT p_partkey, round(CASE WHEN p_retailprice <= 1000 THEN 1.0 WHEN p_retailprice >= 1400 THEN 0.0 ELSE (1 + cos(3.141592653589793 * (p_retailprice - 1000) / 400)) / 2 END, 6) AS factor FROM part""")
def cosine_penalty(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(M.cosine_penalty(c("p_retailprice"), 1000.0, 1400.0), 6).alias("factor"))


@query("""
SELECT p_partkey, round(CASE WHEN p_retailprice > 1200 THEN 1 / (1 + exp(-((1200 - p_retailprice) / 20.0))) ELSE 1 END * CASE WHEN p_size < 10 THEN 1 / (1 + exp(-((p_size - 10) / 2.0))) ELSE 1 END * CASE WHEN p_type LIKE '%STEEL%' THEN 1 ELSE 0.1 END, 6) AS score FROM part""")
def soft_constraint(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(M.soft_gate([(c("p_retailprice"), "max", 1200.0, 20.0), (c("p_size"), "min", 10.0, 2.0)], c("p_type").contains("STEEL")), 6).alias("score"))


@query("""
SELECT p_partkey, round(CASE WHEN s > 0 THEN log10(s) END, 6) AS dvi FROM (SELECT p_partkey, CASE WHEN p_retailprice + 0.7 > 1 THEN log10(log10(p_retailprice + 0.7)) END - CASE WHEN p_size + 0.7 > 1 THEN log10(log10(p_size + 0.7)) END AS s FROM part)""")
def dvi(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(M.viscosity_index(c("p_retailprice"), c("p_size").cast("double")), 6).alias("dvi"))


@query("SELECT p_partkey, round((p_retailprice - p_size) / (p_retailprice * 60.0), 9) AS beta, round(p_retailprice / (1 + 0.001 * 60.0), 6) AS later, round(p_size - 273.15::DOUBLE, 6) AS celsius FROM part")
def beta_linear(spark, d):
    return read(spark, d, "part").select(
        "p_partkey", F.round(M.beta_from_two(c("p_retailprice"), c("p_size"), 60.0), 9).alias("beta"), F.round(M.density_at(c("p_retailprice"), F.lit(0.001), 60.0), 6).alias("later"), F.round(M.celsius(c("p_size")), 6).alias("celsius")
    )


@query("""
WITH t AS (SELECT l_suppkey, (l_quantity - 25) / 25 AS x, l_extendedprice / 10000 AS y FROM lineitem),
s AS (SELECT l_suppkey, count(*)::DOUBLE s0, sum(x) s1, sum(x*x) s2, sum(x*x*x) s3, sum(x*x*x*x) s4, sum(y) t0, sum(x*y) t1, sum(x*x*y) t2 FROM t GROUP BY 1),
q AS (SELECT *, s0*(s2*s4-s3*s3)-s1*(s1*s4-s3*s2)+s2*(s1*s3-s2*s2) AS dt FROM s)
SELECT l_suppkey, round((t0*(s2*s4-s3*s3)-s1*(t1*s4-s3*t2)+s2*(t1*s3-s2*t2))/dt, 6) AS a, round((s0*(t1*s4-s3*t2)-t0*(s1*s4-s3*s2)+s2*(s1*t2-t1*s2))/dt, 6) AS b, round((s0*(s2*t2-t1*s3)-s1*(s1*t2-t1*s2)+t0*(s1*s3-s2*s2))/dt, 6) AS c FROM q""")
def beta_quadratic(spark, d):
    t = read(spark, d, "lineitem").select("l_suppkey", ((c("l_quantity") - 25) / 25).alias("x"), (c("l_extendedprice") / 10000).alias("y"))
    x, y = c("x"), c("y")
    s = t.groupBy("l_suppkey").agg(F.count("*").alias("n"), *[F.sum(e).alias(a) for a, e in (("s1", x), ("s2", x * x), ("s3", x * x * x), ("s4", x * x * x * x), ("t0", y), ("t1", x * y), ("t2", x * x * y))])
    a, b, q = M.quadratic_fit(c("n"), [c(f"s{k}") for k in (1, 2, 3, 4)], [c("t0"), c("t1"), c("t2")])
    return s.select("l_suppkey", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(q, 6).alias("c"))


@query("SELECT o_orderkey, CAST(md5_number(o_orderkey::VARCHAR) % 5 AS INTEGER) AS fold FROM orders")
def fold_assign(spark, d):
    return read(spark, d, "orders").select("o_orderkey", R.md5_fold(c("o_orderkey"), 5).cast("int").alias("fold"))


@query(r"SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/([0-9]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/([0-9]+)', 2) AS host, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/([0-9]+)', 3) AS lang, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/([0-9]+)', 4) AS num FROM pages")
def path_params(spark, d):
    return read(spark, d, "pages").select("page_id", *R.path_params(c("url"), r"^(https?)://([^/]+)/([a-z]+)/([0-9]+)", ["scheme", "host", "lang", "num"]))


@query(r"""
WITH v AS (SELECT p_partkey, trim(p_name) b, trim(regexp_replace(trim(p_name), '\([^)]*\)', '', 'g')) p FROM part)
SELECT DISTINCT p_partkey, variant FROM (SELECT p_partkey, unnest([b, p, regexp_replace(p, '^(?:[RSEZDL]|cis|trans)-', '')]) AS variant FROM v) WHERE variant <> ''""")
def name_variants(spark, d):
    return read(spark, d, "part").select("p_partkey", F.explode(R.name_variants(c("p_name"))).alias("variant"))


@query("SELECT p_brand, printf('%.1f +/- %.1f', avg(p_size), stddev_samp(p_size)) AS readable FROM part GROUP BY p_brand")
def readable_pm(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(R.plus_minus(F.avg("p_size"), F.stddev_samp("p_size"), 1).alias("readable"))


@query("SELECT page_id, CASE WHEN length(url) > 32 THEN substr(url, 1, 29) || '...' ELSE url END AS short FROM pages")
def ellipsis(spark, d):
    return read(spark, d, "pages").select("page_id", R.ellipsis(c("url"), 32).alias("short"))


@query("""
WITH t AS (SELECT item_id, text, unnest(range(1, length(text) - 2)) AS i FROM benchmark WHERE length(text) > 3)
SELECT substr(text, i, 3) AS prefix, substr(text, i + 3, 1) AS next, count(*) AS n FROM t GROUP BY 1, 2""")
def ngram_counts(spark, d):
    return R.ngrams(read(spark, d, "benchmark"), "text", 3)


@query("SELECT char, CAST(row_number() OVER (ORDER BY char) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM benchmark) WHERE char <> ''")
def vocab_index(spark, d):
    return R.vocabulary(read(spark, d, "benchmark"), "text")


@query(r"""
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN nullif(regexp_extract(text, '^(\S+)', 1), '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS topic FROM conversations""")
def line_state_machine(spark, d):
    t = read(spark, d, "conversations").withColumn("line", F.when(c("role") == "user", c("text")).otherwise(""))
    return R.carried(t, ["conv_id"], "turn", "line", {"topic": r"^(\S+)"}).select("conv_id", "turn", "role", "topic")
