"""Queries over summaries, windows, skylines, similarity and models, each with the same question in SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as R
from tessera.operators import aggregates as A
from tessera.operators import models as ML
from tessera.operators import pareto as P
from tessera.operators import similarity as S
from tessera.operators import windows as W
from tessera.plans.registry import query, read

c = F.col


def _r(df, columns: dict[str, int] | list[str], digits: int = 6):
    names = columns if isinstance(columns, dict) else {n: digits for n in columns}
    return df.select(*[F.round(n, names[n]).alias(n) if n in names else n for n in df.columns])


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, count(l_quantity) AS n FROM lineitem GROUP BY 1, 2")
def group_stats(spark, d):
    return _r(A.group_stats(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"), ["mean", "sd"])


@query("""
SELECT l_suppkey, round(avg(l_quantity), 6) AS l_quantity_avg, round(stddev_samp(l_quantity), 6) AS l_quantity_stddev_samp, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
 round(avg(l_tax), 6) AS l_tax_avg, round(stddev_samp(l_tax), 6) AS l_tax_stddev_samp, min(l_tax) AS l_tax_min, max(l_tax) AS l_tax_max FROM lineitem GROUP BY 1""")
def generation_stats(spark, d):
    return _r(A.many_stats(read(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity", "l_tax"]), ["l_quantity_avg", "l_quantity_stddev_samp", "l_tax_avg", "l_tax_stddev_samp"])


@query("""
SELECT o_orderpriority, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS sd, count(m) AS n FROM (SELECT o_orderpriority, o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY 1""")
def two_level_summary(spark, d):
    return _r(A.two_level(read(spark, d, "orders"), ["o_orderpriority"], ["o_custkey"], "o_totalprice"), ["mean", "sd"], 4)


@query("SELECT l_linenumber, round(stddev_pop(l_extendedprice), 4) AS sd FROM lineitem GROUP BY 1")
def pop_std(spark, d):
    return _r(read(spark, d, "lineitem").groupBy("l_linenumber").agg(F.stddev_pop("l_extendedprice").alias("sd")), ["sd"], 4)


@query("""
SELECT CASE grouping_id(o_orderstatus, o_orderpriority) WHEN 1 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS parameter, coalesce(o_orderstatus, o_orderpriority) AS level, round(avg(o_totalprice), 4) AS mean, count(o_totalprice) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))""")
def marginals_grouping_sets(spark, d):
    return _r(A.marginals(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice"), ["mean"], 4)


@query("""
WITH g AS (SELECT avg(o_totalprice) m, var_pop(o_totalprice) * count(*) ss FROM orders),
e AS (SELECT 'o_orderstatus' AS parameter, sum(n * pow(x - m, 2)) / max(ss) AS eta2 FROM (SELECT o_orderstatus, count(*) n, avg(o_totalprice) x FROM orders GROUP BY 1), g
 UNION ALL SELECT 'o_orderpriority', sum(n * pow(x - m, 2)) / max(ss) FROM (SELECT o_orderpriority, count(*) n, avg(o_totalprice) x FROM orders GROUP BY 1), g)
SELECT parameter, round(eta2, 8) AS eta2 FROM e UNION ALL SELECT 'residual', round(1 - sum(eta2), 8) FROM e""")
def eta_squared(spark, d):
    return _r(A.eta_squared(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice"), ["eta2"], 8)


@query("SELECT round(stddev_samp(m), 4) AS between_sd, round(avg(s), 4) AS within_sd FROM (SELECT avg(o_totalprice) m, stddev_samp(o_totalprice) s FROM orders GROUP BY o_orderpriority)")
def between_within(spark, d):
    return _r(A.between_within(read(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"), ["between_sd", "within_sd"], 4)


@query("""
SELECT l_shipmode AS level, round(mean, 4) AS mean, round(mean - h, 4) AS low, round(mean + h, 4) AS high FROM (SELECT l_returnflag AS l_shipmode, avg(l_extendedprice) mean, 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)) h FROM lineitem GROUP BY 1)""")
def ci95(spark, d):
    return _r(A.ci95(read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "level"), ["level"], "l_extendedprice"), ["mean", "low", "high"], 4)


@query("SELECT user_id, event_type, round(median(value), 6) AS median, count(value) AS n FROM events GROUP BY 1, 2 HAVING count(value) = 1 OR coalesce(stddev_samp(value), 0) <= 60")
def median_dedup_std(spark, d):
    return _r(A.median_if_steady(read(spark, d, "events"), ["user_id", "event_type"], "value", 60.0), ["median"])


@query("""
SELECT l_returnflag, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, count(m) AS n FROM (SELECT l_returnflag, l_linenumber, avg(l_quantity) m FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def consensus_two_level(spark, d):
    return _r(A.two_level(read(spark, d, "lineitem"), ["l_returnflag"], ["l_linenumber"], "l_quantity"), ["mean", "sd"])


@query("""
SELECT l_linenumber, round(avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 6) AS q_A, round(avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 6) AS q_N, round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 6) AS q_R FROM lineitem GROUP BY 1""")
def pivot_wide(spark, d):
    return _r(A.pivot(read(spark, d, "lineitem"), ["l_linenumber"], "l_returnflag", ["A", "N", "R"], F.avg("l_quantity"), "q_"), ["q_A", "q_N", "q_R"])


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def tier_crosstab(spark, d):
    return A.crosstab(read(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity + l_discount + l_tax) / 3, 6) AS mean, round(greatest(l_quantity, l_discount, l_tax), 6) AS max,
 round(sqrt((pow(l_quantity - (l_quantity + l_discount + l_tax) / 3, 2) + pow(l_discount - (l_quantity + l_discount + l_tax) / 3, 2) + pow(l_tax - (l_quantity + l_discount + l_tax) / 3, 2)) / 2), 6) AS sd FROM lineitem""")
def rowwise_stats(spark, d):
    x = A.across(["l_quantity", "l_discount", "l_tax"])
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(x[n], 6).alias(n) for n in ("mean", "max", "sd")])


_FIT = "1000.0 * l_quantity + 500"


@query(f"""
WITH r AS (SELECT l_returnflag, abs(l_extendedprice - ({_FIT})) AS r FROM lineitem), n AS (SELECT l_returnflag, count(*) n FROM r GROUP BY 1)
SELECT l_returnflag, round(s[CAST(floor(spot) AS BIGINT) + 1] + (s[CAST(ceil(spot) AS BIGINT) + 1] - s[CAST(floor(spot) AS BIGINT) + 1]) * (spot - floor(spot)), 4) AS q, n
FROM (SELECT r.l_returnflag, max(n) AS n, list_sort(list(r)) AS s, least(0.9::DOUBLE * (max(n) + 1) / max(n), 1.0) * (max(n) - 1) AS spot FROM r JOIN n USING (l_returnflag) GROUP BY 1) t""")
def conformal_q(spark, d):
    li = read(spark, d, "lineitem").withColumn("residual", c("l_extendedprice") - (1000.0 * c("l_quantity") + 500))
    return _r(A.conformal_quantile(li, ["l_returnflag"], c("residual"), 0.1), ["q"], 4)


@query(f"""
WITH t AS (SELECT l_extendedprice y, ({_FIT}) - l_extendedprice AS e FROM lineitem)
SELECT round(1 - sum(e*e) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg(e*e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(median(abs(e)), 4) AS medae, round(avg(e), 4) AS bias, count(*) AS n FROM t""")
def regression_metrics(spark, d):
    li = read(spark, d, "lineitem").withColumn("pred", 1000.0 * c("l_quantity") + 500)
    return _r(A.regression_metrics(li, [], "l_extendedprice", "pred"), {"r2": 6, "rmse": 4, "mae": 4, "medae": 4, "bias": 4})


@query(f"SELECT l_suppkey, round(1 - sum(pow(({_FIT}) - l_extendedprice, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 5")
def per_bucket_r2(spark, d):
    li = read(spark, d, "lineitem").withColumn("pred", 1000.0 * c("l_quantity") + 500)
    return _r(A.regression_metrics(li, ["l_suppkey"], "l_extendedprice", "pred", least=5, median=False).select("l_suppkey", "r2", "n"), ["r2"])


_SCORED = "SELECT quality = 1 AS t, n_chars / 10000.0 AS s FROM labels JOIN documents USING (doc_id)"


def _scored(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select((c("quality") == 1).alias("t"), (c("n_chars") / 10000.0).alias("s"))


@query(f"""
WITH x AS (SELECT count(*) FILTER (t AND s >= 0.1)::DOUBLE tp, count(*) FILTER (NOT t AND s >= 0.1)::DOUBLE fp, count(*) FILTER (NOT t AND s < 0.1)::DOUBLE tn, count(*) FILTER (t AND s < 0.1)::DOUBLE fn FROM ({_SCORED}))
SELECT round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
 round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM x""")
def classification_metrics(spark, d):
    return _r(A.classification_metrics(_scored(spark, d), c("t"), c("s") >= 0.1), ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc"])


@query(f"""
WITH x AS ({_SCORED}), g AS (SELECT s, count(*) FILTER (t) p, count(*) FILTER (NOT t) n FROM x GROUP BY s), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
SELECT round(sum(p * (b + n / 2.0)) / (sum(p) * sum(n)), 8) AS roc_auc FROM w""")
def roc_auc(spark, d):
    return _r(A.roc_auc(_scored(spark, d), c("t"), c("s")), ["roc_auc"], 8)


@query(f"""
WITH x AS ({_SCORED}), g AS (SELECT s, count(*) FILTER (t) p, count(*) FILTER (NOT t) n FROM x GROUP BY s), w AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM g)
SELECT round(sum(p * tp / (tp + fp)) / sum(p), 8) AS average_precision FROM w""")
def average_precision(spark, d):
    return _r(A.average_precision(_scored(spark, d), c("t"), c("s")), ["average_precision"], 8)


@query(f"""
WITH x AS ({_SCORED}), g AS (SELECT k, k / 100.0 AS threshold FROM range(5, 96) r(k)), f AS (SELECT k, threshold, coalesce(2.0 * count(*) FILTER (t AND s >= threshold) / nullif(count(*) FILTER (s >= threshold) + count(*) FILTER (t), 0), 0) AS f1 FROM x, g GROUP BY 1, 2)
SELECT round(threshold::DOUBLE, 6) AS threshold, round(f1, 8) AS f1 FROM f ORDER BY f.f1 DESC, k LIMIT 1""")
def best_f1_threshold(spark, d):
    return _r(A.best_f1(_scored(spark, d), c("t"), c("s"), [k / 100 for k in range(5, 96)]), {"threshold": 6, "f1": 8})


@query("""
WITH m AS (SELECT min(p_size) a, max(p_size) b, min(p_retailprice) e, max(p_retailprice) f FROM part)
SELECT p_partkey, round(0.7 * ((p_size - a)::DOUBLE / (b - a)) + 0.3 * (1 - (p_retailprice - e) / (f - e)), 6) AS fitness FROM part, m""")
def minmax_weighted_fitness(spark, d):
    p = A.minmax(read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), {"p_size": False, "p_retailprice": True})
    return p.select("p_partkey", F.round(A.weighted_sum({"p_size_scaled": 0.7, "p_retailprice_scaled": 0.3}), 6).alias("fitness"))


@query("""
WITH e AS (SELECT label, floor((embedding[1] + 4) / 0.5) x, floor((embedding[2] + 4) / 0.5) y FROM embeddings), a AS (SELECT DISTINCT x, y FROM e WHERE label < 5), b AS (SELECT DISTINCT x, y FROM e WHERE label >= 5)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS n_novel""")
def grid_coverage(spark, d):
    e = read(spark, d, "embeddings").select("label", *[F.floor((F.element_at("embedding", k).cast("double") + 4) / 0.5).alias(n) for k, n in ((1, "x"), (2, "y"))])
    cells = e.groupBy("x", "y").agg(F.max(c("label") < 5).alias("a"), F.max(c("label") >= 5).alias("b"))
    return cells.agg(F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(c("a") & c("b")).alias("n_both"), F.count_if(c("b") & ~c("a")).alias("n_novel"))


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem")
def correlation_matrix(spark, d):
    return _r(A.correlations(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), ["r"])


@query("SELECT CAST(floor((p_size - 1) / 7.0) AS INTEGER) AS bin, round(avg(CAST(p_retailprice > 1300 AS DOUBLE)), 6) AS dear FROM part WHERE floor((p_size - 1) / 7.0) < 7 GROUP BY 1")
def prevalence_by_bin(spark, d):
    p = read(spark, d, "part").withColumn("dear", c("p_retailprice") > 1300)
    return _r(A.bin_rates(p, "p_size", ["dear"], 7, 1.0, 50.0), ["dear"])


# ---------------------------------------------------------------- windows


@query("SELECT event_id, user_id, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS best FROM events")
def running_best(spark, d):
    return _r(W.running_best(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "best"), ["best"])


@query("SELECT event_id, round(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS filled FROM events")
def ffill_curve(spark, d):
    e = read(spark, d, "events").withColumn("v", F.when(c("event_type") == "purchase", c("value")))
    return _r(W.forward_fill(e, ["user_id"], ["ts", "event_id"], "v", "filled").select("event_id", "filled"), ["filled"])


@query("""
SELECT event_id, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS filled
FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)""")
def bfill_curve(spark, d):
    e = read(spark, d, "events").withColumn("v", F.when(c("event_type") == "purchase", c("value")))
    return _r(W.fill_both(e, ["user_id"], ["ts", "event_id"], "v", "filled").select("event_id", "filled"), ["filled"])


@query("""
WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events)
SELECT CAST(step AS INTEGER) AS arrival, round(avg(best), 4) AS mean, round(stddev_samp(best), 4) AS sd, count(best) AS n FROM a GROUP BY 1""")
def convergence_band(spark, d):
    e = W.arrival_index(W.running_best(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value"), ["user_id"], ["ts", "event_id"])
    return _r(A.group_stats(e, ["arrival"], "best"), ["mean", "sd"], 4)


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS arrival FROM events")
def arrival_index(spark, d):
    return W.arrival_index(read(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "arrival")


@query("SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 6) AS group_mean FROM part")
def group_mean_broadcast(spark, d):
    return _r(W.with_group_mean(read(spark, d, "part"), ["p_brand"], "p_retailprice").select("p_partkey", "group_mean"), ["group_mean"])


@query("""
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [k / 10.0 for k in range(0, 11)]))) AS e FROM orders)
SELECT o_orderkey, CAST(greatest(len(list_filter(e, lambda x: x < o_totalprice)) - 1, 0) AS INTEGER) AS bin FROM orders, e""")
def qcut10(spark, d):
    return W.qcut(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10).select("o_orderkey", "bin")


@query("WITH m AS (SELECT min(o_totalprice) a, max(o_totalprice) b FROM orders) SELECT o_orderkey, CAST(greatest(ceil((o_totalprice - a) / ((b - a) / 50)) - 1, 0) AS INTEGER) AS bin FROM orders, m")
def cut50(spark, d):
    return W.cut(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 50).select("o_orderkey", "bin")


@query("SELECT p_partkey, CAST(p_size >= 5 AS INT) + CAST(p_size >= 15 AS INT) + CAST(p_size >= 30 AS INT) AS bin FROM part")
def digitize_edges(spark, d):
    return read(spark, d, "part").select("p_partkey", W.digitize(c("p_size"), [5, 15, 30]).alias("bin"))


@query("WITH m AS (SELECT min(event_id) a, max(event_id) b FROM events) SELECT event_id, round((event_id - a) / (b - a)::DOUBLE, 8) AS progress FROM events, m")
def temporal_progress(spark, d):
    return _r(W.progress(read(spark, d, "events").select("event_id"), "event_id"), ["progress"], 8)


@query("""
WITH t AS (SELECT p_brand, p_partkey, lead(p_size) OVER s - lag(p_size) OVER s AS ds, max(p_size) OVER b - min(p_size) OVER b AS rs, lead(p_retailprice) OVER p - lag(p_retailprice) OVER p AS dp, max(p_retailprice) OVER b - min(p_retailprice) OVER b AS rp, count(*) OVER b AS n
 FROM part WINDOW b AS (PARTITION BY p_brand), s AS (PARTITION BY p_brand ORDER BY p_size, p_partkey), p AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey))
SELECT p_brand, p_partkey, round(CASE WHEN ds IS NULL OR dp IS NULL OR n <= 2 THEN -1 ELSE ds / rs::DOUBLE + dp / rp END, 6) AS crowding FROM t""")
def crowding_distance(spark, d):
    return _r(W.crowding(read(spark, d, "part"), ["p_brand"], ["p_size", "p_retailprice"], "p_partkey", far=-1.0).select("p_brand", "p_partkey", "crowding"), ["crowding"])


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS value FROM events GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1.0, true) THEN 1 ELSE 0 END AS rose FROM d),
i AS (SELECT *, sum(rose) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(island AS BIGINT) AS island, CAST(row_number() OVER (PARTITION BY user_id, island ORDER BY day) - 1 AS INTEGER) AS stagnant FROM i""")
def stagnation_islands(spark, d):
    days = read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("value"))
    return W.stagnation(days, ["user_id"], "day", "value", 1.0).select("user_id", c("day").cast("string").alias("day"), "island", "stagnant")


# ---------------------------------------------------------------- skylines

_DOM2 = "EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice >= a.p_retailprice AND -b.p_size >= -a.p_size AND (b.p_retailprice > a.p_retailprice OR -b.p_size > -a.p_size))"


def _objectives(spark, d):
    return read(spark, d, "part").select("p_partkey", "p_brand", c("p_retailprice").alias("price"), (-c("p_size")).cast("double").alias("small"), F.pmod(c("p_partkey") * 37, F.lit(101)).cast("double").alias("third"))


@query(f"SELECT p_partkey FROM part a WHERE NOT {_DOM2}")
def skyline2d(spark, d):
    return P.skyline2(_objectives(spark, d), "price", "small").select("p_partkey")


_DOM3 = "b.p_retailprice >= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_partkey * 37) % 101 >= (a.p_partkey * 37) % 101 AND (b.p_retailprice > a.p_retailprice OR b.p_size < a.p_size OR (b.p_partkey * 37) % 101 > (a.p_partkey * 37) % 101)"


@query(f"SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE {_DOM3})")
def skyline3d(spark, d):
    return P.skyline(_objectives(spark, d), ["price", "small", "third"]).select("p_partkey")


_PEEL = "WITH " + ", ".join(
    x
    for k in range(3)
    for x in (
        f"f{k} AS (SELECT * FROM {'part' if k == 0 else f'r{k}'} a WHERE NOT EXISTS (SELECT 1 FROM {'part' if k == 0 else f'r{k}'} b WHERE {_DOM3}))",
        f"r{k + 1} AS (SELECT * FROM {'part' if k == 0 else f'r{k}'} WHERE p_partkey NOT IN (SELECT p_partkey FROM f{k}))",
    )
)


@query(_PEEL + " SELECT p_partkey, 0 AS front FROM f0 UNION ALL SELECT p_partkey, 1 FROM f1 UNION ALL SELECT p_partkey, 2 FROM f2")
def front_ranks3(spark, d):
    return P.front_ranks(_objectives(spark, d), ["price", "small", "third"], "p_partkey", 3).select("p_partkey", "front")


@query(
    _PEEL
    + """, u AS (SELECT *, 0 AS front FROM f0 UNION ALL SELECT *, 1 FROM f1 UNION ALL SELECT *, 2 FROM f2),
o AS (SELECT p_partkey, front, p_retailprice::DOUBLE a, -p_size::DOUBLE b, ((p_partkey * 37) % 101)::DOUBLE c FROM u),
t AS (SELECT p_partkey, front, lead(a) OVER wa - lag(a) OVER wa AS da, lead(b) OVER wb - lag(b) OVER wb AS db, lead(c) OVER wc - lag(c) OVER wc AS dc,
 max(a) OVER w - min(a) OVER w AS ra, max(b) OVER w - min(b) OVER w AS rb, max(c) OVER w - min(c) OVER w AS rc, count(*) OVER w AS n FROM o
 WINDOW w AS (PARTITION BY front), wa AS (PARTITION BY front ORDER BY a, p_partkey), wb AS (PARTITION BY front ORDER BY b, p_partkey), wc AS (PARTITION BY front ORDER BY c, p_partkey))
SELECT p_partkey, front FROM t ORDER BY front, CASE WHEN da IS NULL OR db IS NULL OR dc IS NULL OR n <= 2 THEN 1e308 ELSE CASE WHEN ra > 0 THEN da / ra ELSE 0 END + CASE WHEN rb > 0 THEN db / rb ELSE 0 END + CASE WHEN rc > 0 THEN dc / rc ELSE 0 END END DESC, p_partkey LIMIT 40"""
)
def nsga_select(spark, d):
    return P.survivors(_objectives(spark, d), ["price", "small", "third"], "p_partkey", 40).select("p_partkey", "front")


@query("""
WITH s AS (SELECT p_brand, p_retailprice x, max(60 - p_size)::DOUBLE y FROM part WHERE p_retailprice > 900 AND 60 - p_size > 5 GROUP BY 1, 2),
w AS (SELECT *, greatest(y - coalesce(max(y) OVER (PARTITION BY p_brand ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 5), 0) * (x - 900) AS a FROM s)
SELECT p_brand, round(sum(a), 4) AS hypervolume FROM w GROUP BY 1""")
def hypervolume2d(spark, d):
    p = read(spark, d, "part").select("p_brand", c("p_retailprice").alias("x"), (60 - c("p_size")).cast("double").alias("y"))
    return _r(W.hypervolume(p, ["p_brand"], "x", "y", (900.0, 5.0)), ["hypervolume"], 4)


@query("""
WITH o AS (SELECT p_partkey, p_retailprice a, -p_size b FROM part WHERE p_brand < 'Brand#2' UNION SELECT p_partkey, p_retailprice, -p_size FROM part WHERE p_size < 20)
SELECT p_partkey FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b))""")
def merged_fronts(spark, d):
    o = _objectives(spark, d)
    return P.merged_front([o.where("p_brand < 'Brand#2'").drop("p_brand"), o.where("small > -20").drop("p_brand")], "price", "small").select("p_partkey")


# ---------------------------------------------------------------- similarity

_HALF = "list_aggregate([CASE WHEN embedding[k] > 0 THEN 1::BIGINT << ({last} - k) ELSE 0 END for k in range({first}, {last} + 1)], 'sum')::BIGINT"
_WORD = f"SELECT vec_id, {_HALF.format(first=1, last=32)} AS h, {_HALF.format(first=33, last=64)} AS l FROM embeddings"
_SIM = "CASE WHEN bit_count(a.h | b.h) + bit_count(a.l | b.l) > 0 THEN (bit_count(a.h & b.h) + bit_count(a.l & b.l)) / (bit_count(a.h | b.h) + bit_count(a.l | b.l))::DOUBLE ELSE 0 END"


def _words(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", S.sign_word(c("embedding")).alias("w"))


@query(f"WITH e AS ({_WORD}) SELECT a.vec_id, round(sum({_SIM}) / (SELECT count(*) - 1 FROM e), 6) AS mean_similarity FROM e a, e b WHERE a.vec_id <> b.vec_id GROUP BY 1")
def tanimoto_mean(spark, d):
    return _r(S.mean_tanimoto(_words(spark, d), "vec_id", "w"), ["mean_similarity"])


@query(f"""
WITH e AS ({_WORD}), m AS (SELECT a.vec_id, sum({_SIM}) / (SELECT count(*) - 1 FROM e) AS s FROM e a, e b WHERE a.vec_id <> b.vec_id GROUP BY 1)
SELECT vec_id, round(vec_id * exp(-1000.0 * pow(greatest(s - 0.33, 0), 2)) * (1 - s), 4) AS niched FROM m""")
def niching_penalty(spark, d):
    s = S.mean_tanimoto(_words(spark, d), "vec_id", "w")
    return s.select("vec_id", F.round(S.niched(c("vec_id").cast("double"), c("mean_similarity"), 0.33), 4).alias("niched"))


@query(f"WITH e AS ({_WORD}), m AS (SELECT a.vec_id, sum({_SIM}) / (SELECT count(*) - 1 FROM e) AS s FROM e a, e b WHERE a.vec_id <> b.vec_id GROUP BY 1) SELECT round(avg(s), 6) AS mean_pairwise FROM m")
def mean_pairwise(spark, d):
    return _r(S.mean_pairwise(_words(spark, d), "vec_id", "w"), ["mean_pairwise"])


@query("""
WITH p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)
SELECT vec_id, CAST(rn AS INTEGER) AS rank, neighbour, round(dist, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour) rn FROM p) WHERE rn <= 5""")
def knn5(spark, d):
    return _r(S.nearest(read(spark, d, "embeddings"), "vec_id", "embedding", 5), ["distance"], 5)


@query(f"WITH e AS ({_WORD}) SELECT a.vec_id, round(max({_SIM}), 6) AS best_similarity FROM e a, e b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY 1")
def query_vs_ref(spark, d):
    words = _words(spark, d)
    return _r(S.against(words.where("vec_id % 20 = 0"), words, "vec_id", "w"), ["best_similarity"])


@query()
def leader_clusters(spark, d):
    return S.leaders(_words(spark, d), "label", "vec_id", "w", "vec_id", 0.4)


# ---------------------------------------------------------------- models


_X3 = ("l_quantity", "l_extendedprice", "l_tax")
_COV = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
_SHRUNK = [[f"s{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]


def _minor(i, j):
    (a, b), (e, f) = [[_SHRUNK[r][k] for k in range(3) if k != j] for r in range(3) if r != i]
    return f"({a} * {f} - {b} * {e})"


# shrinkage of the covariance to a multiple of the identity, its inverse by minors
@query(f"""
WITH m AS (SELECT count(*)::DOUBLE AS n, {", ".join(f"avg({x}) AS m{k}" for k, x in enumerate(_X3))} FROM lineitem),
z AS (SELECT {", ".join(f"{x} - m{k} AS z{k}" for k, x in enumerate(_X3))} FROM lineitem, m),
c AS (SELECT {", ".join(f"avg(z{i} * z{j}) AS c{i}{j}" for i in range(3) for j in range(i, 3))}, avg(pow(z0 * z0 + z1 * z1 + z2 * z2, 2)) AS fourth FROM z),
u AS (SELECT *, (c00 + c11 + c22) / 3 AS mu, {" + ".join(f"{_COV[i][j]} * {_COV[i][j]}" for i in range(3) for j in range(3))} AS squares FROM c),
d AS (SELECT *, (squares - 3 * mu * mu) / 3 AS delta FROM u),
w AS (SELECT *, greatest(least((fourth - squares) / (n * 3), delta) / delta, 0) AS r FROM d, m),
s AS (SELECT {", ".join(f"(1 - r) * c{i}{j}" + (" + r * mu" if i == j else "") + f" AS s{i}{j}" for i in range(3) for j in range(i, 3))} FROM w),
v AS (SELECT *, s00 * {_minor(0, 0)} - s01 * {_minor(0, 1)} + s02 * {_minor(0, 2)} AS det FROM s),
x AS (SELECT sqrt(({" + ".join(f"z{i} * z{j} * {'' if (i + j) % 2 == 0 else '-'}{_minor(i, j)}" for i in range(3) for j in range(3))}) / det) AS distance FROM z, v),
t AS (SELECT quantile_cont(distance, 0.975) AS t FROM x)
SELECT count(*) AS n, count(*) FILTER (distance > t) AS n_ood, round(avg(distance), 6) AS mean_distance, round(any_value(t), 6) AS threshold FROM x, t""")
def mahalanobis_ood(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_X3)
    params = ML.fit_mahalanobis(li, list(_X3))
    out = ML.mahalanobis(li, params).agg(F.count("*").alias("n"), F.count_if("ood").alias("n_ood"), F.avg("distance").alias("mean_distance"), F.lit(params.threshold).alias("threshold"))
    return _r(out, ["mean_distance", "threshold"])


@query()
def ensemble_interval(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_extendedprice")
    x = x.withColumn("fold", R.md5_fold(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"), 5))
    models = ML.linear_folds(x, ["l_quantity", "l_tax"], "l_extendedprice", "fold", 5)
    return ML.ensemble(x, ["l_quantity", "l_tax"], models, "l_extendedprice", "fold", 0.1).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("mean", 3).alias("mean"), F.round("sd", 3).alias("sd"), F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query()
def boosted_regression(spark, d):
    p = read(spark, d, "part").select("p_partkey", c("p_size").cast("double").alias("p_size"), "p_retailprice", F.pmod("p_partkey", F.lit(10)).cast("double").alias("digit"))
    return ML.boosted(p, ["p_size", "digit"], "p_retailprice", R.md5_fold(c("p_partkey"), 5), 3)


@query()
def ngram_generator(spark, d):
    texts = read(spark, d, "benchmark").select(F.concat(F.lit("^^^"), F.lower("text"), F.lit("$")).alias("text"))
    return R.generate_from(R.ngrams(texts, "text", 3), spark.range(100).withColumnRenamed("id", "seed"), 3, 80, "^^^", "$")
