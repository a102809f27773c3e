"""Queries over prediction cubes, generations, fronts, rates and controls, each with the same question in SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import formulas as M
from tessera.functions import text as R
from tessera.operators import models as ML
from tessera.operators import pareto as P
from tessera.operators import selection as T
from tessera.operators import similarity as S
from tessera.operators import studies as U
from tessera.operators import windows as W
from tessera.plans.analytics import _SIM, _WORD, _r, _words
from tessera.plans.registry import query, read
from tessera.session import dealt

c = F.col

# four invented models of two properties, three folds each: value * (1 + arch / 100) + fold
#: Parts in a task where predictions are grouped: all groups of a part are made and used in the task that has it.
_SHARE = 50_000
_CELLS = [(p, f"a{a}", f) for p in ("size", "price") for a in range(4) for f in range(3)]


def _cube(spark, d, share=None):
    value = {"size": c("p_size").cast("double"), "price": c("p_retailprice")}
    parts = read(spark, d, "part")
    return U.cube(dealt(parts, share, "p_partkey") if share else parts, "p_partkey", {(p, a, f): value[p] * (1 + int(a[1:]) / 100.0) + float(f) for p, a, f in _CELLS})


_CUBE = " UNION ALL ".join(f"SELECT p_partkey, '{p}' AS prop, '{a}' AS arch, {f} AS fold, {'p_size::DOUBLE' if p == 'size' else 'p_retailprice'} * (1 + {a[1:]} / 100.0::DOUBLE) + {f} AS pred FROM part" for p, a, f in _CELLS)
_ARCH = f"SELECT p_partkey, prop, arch, avg(pred) AS arch_mean FROM ({_CUBE}) GROUP BY ALL"


@query(f"SELECT p_partkey, prop, arch, CAST(fold AS INTEGER) AS fold, round(pred, 6) AS pred FROM ({_CUBE})")
def prediction_cube(spark, d):
    return _r(_cube(spark, d), ["pred"])


@query("SELECT p_partkey, " + ", ".join(f"round(avg(arch_mean) FILTER (prop = '{p}' AND arch = 'a{a}'), 6) AS {p}_a{a}" for p in ("size", "price") for a in range(4)) + f" FROM ({_ARCH}) GROUP BY 1")
def two_level_pivot(spark, d):
    names = [(p, f"a{a}") for p in ("size", "price") for a in range(4)]
    return _r(U.wide(U.arch_values(_cube(spark, d, _SHARE), "p_partkey"), ["p_partkey"], ["prop", "arch"], names, F.avg("arch_mean")), ["_".join(n) for n in names])


@query(f"""
WITH w AS (SELECT p_partkey, avg(arch_mean) FILTER (prop = 'size') AS size_mean, stddev_samp(arch_mean) FILTER (prop = 'size') AS size_sd, count(*) FILTER (prop = 'size' AND arch_mean <= 25) AS size_n_arch_pass,
 avg(arch_mean) FILTER (prop = 'price') AS price_mean, stddev_samp(arch_mean) FILTER (prop = 'price') AS price_sd, count(*) FILTER (prop = 'price' AND arch_mean >= 1300) AS price_n_arch_pass FROM ({_ARCH}) GROUP BY 1)
SELECT p_partkey, round(size_mean, 6) AS size_mean, round(size_sd, 6) AS size_sd, size_n_arch_pass, round(price_mean, 6) AS price_mean, round(price_sd, 6) AS price_sd, price_n_arch_pass, size_mean <= 25 AS size_pass, abs(size_mean - 25) <= size_sd AS size_marginal,
 price_mean >= 1300 AS price_pass, abs(price_mean - 1300) <= price_sd AS price_marginal, size_mean <= 25 AND price_mean >= 1300 AS all_pass, abs(size_mean - 25) <= size_sd OR abs(price_mean - 1300) <= price_sd AS any_marginal FROM w""")
def consensus_gates(spark, d):
    out = U.consensus_gates(U.arch_values(_cube(spark, d, _SHARE), "p_partkey"), "p_partkey", [("size", "max", 25.0), ("price", "min", 1300.0)])
    return _r(out, ["size_mean", "size_sd", "price_mean", "price_sd"])


@query("WITH g AS (SELECT user_id, event_type, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1, 2) SELECT event_type, round(median(sd), 6) AS sd, round(median(100 * sd / abs(mean)), 6) AS relative FROM g GROUP BY 1")
def relative_spread(spark, d):
    g = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return _r(U.relative_spread(g, "event_type"), ["sd", "relative"])


_FOLDS = ", ".join(f"(SELECT [regr_intercept(p_retailprice, p_size), regr_slope(p_retailprice, p_size)] FROM part WHERE p_partkey % 5 <> {k}) AS m{k}" for k in range(5))
_LINES = ", ".join(f"m{k}[1] + m{k}[2] * p_size AS p{k}" for k in range(5))


def _linear(spark, d):
    p = read(spark, d, "part").withColumn("fold", F.pmod("p_partkey", F.lit(5)).cast("int"))
    return p, ML.linear_folds(p, ["p_size"], "p_retailprice", "fold", 5), ML.linear_folds(p.withColumn("fold", F.lit(-1)), ["p_size"], "p_retailprice", "fold", 1)[0]


@query(f"""
WITH f AS (SELECT {_FOLDS}, (SELECT [regr_intercept(p_retailprice, p_size), regr_slope(p_retailprice, p_size)] FROM part) AS m),
x AS (SELECT m[1] + m[2] * p_size AS refit, {_LINES} FROM part, f),
y AS (SELECT refit, (p0 + p1 + p2 + p3 + p4) / 5 AS mean, p0, p1, p2, p3, p4 FROM x),
z AS (SELECT refit, mean, sqrt((pow(p0 - mean, 2) + pow(p1 - mean, 2) + pow(p2 - mean, 2) + pow(p3 - mean, 2) + pow(p4 - mean, 2)) / 4) AS sd FROM y)
SELECT count(*) AS n, count(*) FILTER (refit <= 1250) AS full_pass, count(*) FILTER (mean <= 1250) AS fold_pass, round(avg(mean - refit), 5) AS mean_shift, round(median(mean - refit), 5) AS median_shift, round(median(sd), 5) AS median_fold_sd FROM z""")
def refit_control(spark, d):
    p, folds, full = _linear(spark, d)
    line = lambda w: float(w[0]) + float(w[1]) * c("p_size")
    rows = p.select(line(full).alias("full"), *[line(w).alias(f"p{k}") for k, w in enumerate(folds)])
    return _r(U.refit_control(rows, "full", [f"p{k}" for k in range(5)], "max", 1250.0), ["mean_shift", "median_shift", "median_fold_sd"], 5)


@query(f"WITH f AS (SELECT {_FOLDS}), x AS (SELECT p_partkey, p_retailprice, [{', '.join(f'm{k}[1] + m{k}[2] * p_size' for k in range(5))}] AS p FROM part, f) SELECT p_partkey, CAST(p_partkey % 5 AS INTEGER) AS fold, p_retailprice AS y_true, round(p[p_partkey % 5 + 1], 5) AS y_pred FROM x")
def out_of_fold_linear(spark, d):
    p, folds, _ = _linear(spark, d)
    own = F.array(*[float(w[0]) + float(w[1]) * c("p_size") for w in folds])
    return p.select("p_partkey", "fold", c("p_retailprice").alias("y_true"), F.round(F.get(own, c("fold")), 5).alias("y_pred"))


@query("""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std, min(value) AS value_min, max(value) AS value_max, count(*) FILTER (event_type <> 'error') AS n_valid,
 round(100 * avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS pct_valid FROM events GROUP BY 1""")
def generation_report(spark, d):
    e = read(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    return _r(U.generation_report(e, ["day"], ["value"], c("event_type") != "error"), ["value_mean", "value_std", "pct_valid"])


@query("""
WITH o AS (SELECT p_brand, p_retailprice AS x, (60 - p_size)::DOUBLE AS y, p_type LIKE '%STEEL%' AS ok FROM part),
f AS (SELECT p_brand, count(*) AS n_front FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.p_brand = a.p_brand AND b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y)) GROUP BY 1),
s AS (SELECT p_brand, x, max(y) AS y FROM o WHERE x > 900 AND y > 5 GROUP BY 1, 2),
w AS (SELECT p_brand, greatest(y - coalesce(max(y) OVER (PARTITION BY p_brand ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 5), 0) * (x - 900) AS a FROM s),
h AS (SELECT p_brand, sum(a) AS hypervolume FROM w GROUP BY 1)
SELECT o.p_brand, round(avg(x), 8) AS x_mean, round(stddev_samp(x), 8) AS x_std, min(x) AS x_min, max(x) AS x_max, count(*) FILTER (ok) AS n_valid, round(100 * avg(ok::INT), 6) AS pct_valid, any_value(n_front) AS n_front, round(any_value(coalesce(hypervolume, 0)), 4) AS hypervolume
FROM o JOIN f USING (p_brand) LEFT JOIN h USING (p_brand) GROUP BY o.p_brand""")
def front_report(spark, d):
    p = read(spark, d, "part").select("p_brand", "p_type", c("p_retailprice").alias("x"), (60 - c("p_size")).cast("double").alias("y"))
    return _r(U.front_report(p, ["p_brand"], "x", "y", (900.0, 5.0), ["x"], c("p_type").contains("STEEL")), {"x_mean": 8, "x_std": 8, "pct_valid": 6, "hypervolume": 4})


@query("""
WITH o AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS method, p_brand, p_retailprice AS gain, p_size::DOUBLE AS price FROM part),
f AS (SELECT * FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.method = a.method AND b.p_brand = a.p_brand AND b.gain >= a.gain AND b.price <= a.price AND (b.gain > a.gain OR b.price < a.price))),
s AS (SELECT method, p_brand, gain AS x, max(-price) AS y FROM f WHERE gain > 900 AND -price > -40 GROUP BY 1, 2, 3),
w AS (SELECT method, p_brand, greatest(y - coalesce(max(y) OVER (PARTITION BY method, p_brand ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -40), 0) * (x - 900) AS a FROM s),
h AS (SELECT method, p_brand, sum(a) AS hv FROM w GROUP BY 1, 2)
SELECT f.method, f.p_brand, count(*) AS front_size, max(gain) AS best, round(max(gain) - min(gain), 6) AS gain_spread, max(price) - min(price) AS price_spread, count(*) FILTER (price < 3) AS cheap_count, round(coalesce(any_value(hv), 0), 4) AS hypervolume
FROM f LEFT JOIN h USING (method, p_brand) GROUP BY 1, 2""")
def method_comparison(spark, d):
    p = read(spark, d, "part").select(F.when(c("p_partkey") % 2 == 0, "even").otherwise("odd").alias("method"), "p_brand", c("p_retailprice").alias("gain"), c("p_size").cast("double").alias("price"))
    return _r(U.compare_methods(p, "method", "p_brand", "gain", "price", (900.0, -40.0), 3.0), {"gain_spread": 6, "hypervolume": 4})


_NOT3 = "NOT EXISTS (SELECT 1 FROM {t} b WHERE b.x >= a.x AND b.y >= a.y AND b.z >= a.z AND (b.x > a.x OR b.y > a.y OR b.z > a.z))"


@query(f"""
WITH o AS (SELECT p_partkey, p_retailprice AS x, -p_size::DOUBLE AS y, ((p_partkey * 37) % 101)::DOUBLE AS z FROM part),
k AS (SELECT * FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE floor(b.z / 20) = floor(a.z / 20) AND b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y)))
SELECT p_partkey FROM k a WHERE {_NOT3.format(t='k')}""")
def skyline_by_bins(spark, d):
    o = read(spark, d, "part").select("p_partkey", c("p_retailprice").alias("x"), (-c("p_size")).cast("double").alias("y"), F.pmod(c("p_partkey") * 37, F.lit(101)).cast("double").alias("z"))
    return U.skyline_by_bins(o, ["x", "y", "z"], "z", 20.0).select("p_partkey")


@query("""
WITH r AS (SELECT o_orderpriority, o_custkey % 7 AS run, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 7 ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders),
p AS (SELECT o_orderpriority, run, max(o_totalprice) AS b, avg(o_totalprice) FILTER (rn <= 10) AS t, count(*) AS n FROM r GROUP BY 1, 2)
SELECT o_orderpriority, count(*) AS n_runs, round(avg(b), 4) AS best_mean, round(stddev_samp(b), 4) AS best_std, round(avg(t), 4) AS top_mean, round(stddev_samp(t), 4) AS top_std, round(avg(n), 4) AS n_valid_mean, round(stddev_samp(n), 4) AS n_valid_std FROM p GROUP BY 1""")
def top_summary(spark, d):
    o = read(spark, d, "orders").withColumn("run", c("o_custkey") % 7)
    return _r(U.top_summary(o, ["o_orderpriority"], "run", "o_totalprice", "o_orderkey"), ["best_mean", "best_std", "top_mean", "top_std", "n_valid_mean", "n_valid_std"], 4)


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS value FROM events GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1.0, true) THEN 1 ELSE 0 END AS rose FROM d),
i AS (SELECT *, sum(rose) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY day) - 1 AS stagnant FROM i)
SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(stagnant AS INTEGER) AS stagnant, CAST(least(sum(CASE WHEN stagnant > 0 AND stagnant % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), 5) AS BIGINT) AS n_restarts FROM s""")
def stagnation_restarts(spark, d):
    days = read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("value"))
    return U.restarts(W.stagnation(days, ["user_id"], "day", "value", 1.0), ["user_id"], "day", 3, 5).select("user_id", c("day").cast("string").alias("day"), "stagnant", "n_restarts")


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey FROM lineitem GROUP BY 1")
def distinct_counts(spark, d):
    return U.distinct_counts(read(spark, d, "lineitem"), ["l_returnflag"], ["l_partkey", "l_suppkey"])


@query("SELECT l_linenumber, round(avg((l_quantity > 40)::INT), 8) AS far_quantity, round(avg((l_tax > 0.06)::INT), 8) AS far_tax, count(*) AS n FROM lineitem GROUP BY 1")
def ood_rates(spark, d):
    return _r(U.rates(read(spark, d, "lineitem"), ["l_linenumber"], {"far_quantity": c("l_quantity") > 40, "far_tax": c("l_tax") > 0.06}), ["far_quantity", "far_tax"], 8)


@query("SELECT user_id, round(avg((event_type <> 'error' AND value >= 10)::INT), 8) AS feasible, count(*) AS n FROM events GROUP BY 1")
def feasibility_rate(spark, d):
    return _r(U.rates(read(spark, d, "events"), ["user_id"], {"feasible": (c("event_type") != "error") & (c("value") >= 10)}), ["feasible"], 8)


@query("""
WITH o AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), n AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45),
u AS (SELECT k, max(o) AS o, max(n) AS n FROM (SELECT k, 1 AS o, 0 AS n FROM o UNION ALL SELECT k, 0, 1 FROM n) GROUP BY k)
SELECT CAST(sum(o) AS BIGINT) AS n_old, CAST(sum(n) AS BIGINT) AS n_new, count(*) FILTER (o = 1 AND n = 1) AS n_overlap, count(*) FILTER (o = 0) AS n_added, count(*) AS n_merged FROM u""")
def merge_report(spark, d):
    li = read(spark, d, "lineitem")
    return U.merge_report(li.where("l_returnflag = 'A'"), li.where("l_quantity > 45"), "l_partkey")


@query(" UNION ALL ".join(f"SELECT '{n}' AS category, p_partkey FROM part WHERE {w}" for n, w in (("bio_stable", "p_type LIKE '%STEEL%' AND p_size < 30"), ("bio_unstable", "p_type LIKE '%STEEL%'"), ("nonbio_stable", "p_size < 30"), ("nonbio_unstable", "true"))))
def category_filter(spark, d):
    p = read(spark, d, "part").select("p_partkey", c("p_type").contains("STEEL").alias("is_biodegradable"), (c("p_size") < 30).alias("is_stable"))
    out = None
    for name in ("bio_stable", "bio_unstable", "nonbio_stable", "nonbio_unstable"):
        one = U.for_category(p, name).select(F.lit(name).alias("category"), "p_partkey")
        out = one if out is None else out.union(one)
    return out


@query("""
WITH s AS (SELECT l_suppkey, count(*) AS n, min(l_orderkey) AS f FROM lineitem GROUP BY 1), r AS (SELECT l_suppkey, row_number() OVER (ORDER BY n DESC, f, l_suppkey) - 1 AS rank FROM s)
SELECT l_suppkey, CAST(rank AS INTEGER) AS rank, count(*) AS n FROM lineitem JOIN r USING (l_suppkey) GROUP BY 1, 2""")
def cluster_ranks(spark, d):
    return U.renumber_by_size(read(spark, d, "lineitem").select("l_suppkey", "l_orderkey"), "l_suppkey", "l_orderkey").groupBy("l_suppkey", "rank").agg(F.count("*").alias("n"))


@query("SELECT trim(' ' || c_mktsegment) AS name FROM customer INTERSECT SELECT trim(c_mktsegment || '  ') FROM customer WHERE c_acctbal > 5000")
def trimmed_overlap(spark, d):
    cu = read(spark, d, "customer")
    return U.trimmed_overlap(cu.select(F.concat(F.lit(" "), "c_mktsegment").alias("name")), cu.where("c_acctbal > 5000").select(F.concat("c_mktsegment", F.lit("  ")).alias("name")), "name")


_DRAW = "(('0x' || substr(md5(vec_id::VARCHAR || '#4'), 1, 8))::BIGINT + 0.5) / 4294967296.0"


@query(f"""
WITH w AS ({_WORD}), e AS (SELECT * FROM w ORDER BY {_DRAW}, vec_id LIMIT 60),
m AS (SELECT a.vec_id, sum({_SIM}) / (SELECT count(*) - 1 FROM e) AS s FROM e a, e b WHERE a.vec_id <> b.vec_id GROUP BY 1) SELECT round(avg(s), 6) AS mean_pairwise FROM m""")
def pairwise_sampled(spark, d):
    return _r(U.sampled_pairwise(_words(spark, d), "vec_id", "w", 50, 60, 4), ["mean_pairwise"])


@query("SELECT o_orderkey, upper(o_orderpriority) AS looked_up FROM orders")
def memoised_lookup(spark, d):
    return U.memoised(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", F.upper, "looked_up").select("o_orderkey", "looked_up")


# densities of every supplier at seven temperatures; some series bend the wrong way or scatter
_RHO = "1.0 - 0.0008 * t - 0.000001 * t * t + CASE WHEN l_suppkey % 4 = 1 THEN 0.0004 * t * (l_suppkey % 3) ELSE 0 END + CASE WHEN l_suppkey % 5 = 0 THEN 0.01 * (l_linenumber % 2) ELSE 0 END"


@query(f"""
WITH p AS (SELECT DISTINCT l_suppkey, l_linenumber, (l_linenumber - 1) * 10.0::DOUBLE AS t FROM lineitem WHERE l_suppkey % 6 <> 2 OR l_linenumber < 3),
q AS (SELECT l_suppkey, t, (t - 50.0) / 50.0 AS x, ({_RHO})::DOUBLE AS y FROM p),
s AS (SELECT l_suppkey, count(*)::DOUBLE s0, sum(x) s1, sum(x*x) s2, sum(x*x*x) s3, sum(x*x*x*x) s4, sum(y) t0, sum(x*y) t1, sum(x*x*y) t2, avg(y) m FROM q GROUP BY 1 HAVING count(*) >= 3),
u AS (SELECT *, s0*(s2*s4-s3*s3)-s1*(s1*s4-s3*s2)+s2*(s1*s3-s2*s2) AS dt FROM s),
f AS (SELECT l_suppkey, m, CAST(s0 AS INTEGER) AS n, (t0*(s2*s4-s3*s3)-s1*(t1*s4-s3*t2)+s2*(t1*s3-s2*t2))/dt AS a, (s0*(t1*s4-s3*t2)-t0*(s1*s4-s3*s2)+s2*(s1*t2-t1*s2))/dt AS b, (s0*(s2*t2-t1*s3)-s1*(s1*t2-t1*s2)+t0*(s1*s3-s2*s2))/dt AS c FROM u),
r AS (SELECT f.l_suppkey, any_value(a) a, any_value(b) b, any_value(c) c, any_value(n) n, 1 - sum(pow(y - (a + b*x + c*x*x), 2)) / sum(pow(y - m, 2)) AS r2 FROM f JOIN q USING (l_suppkey) GROUP BY 1),
g AS (SELECT *, [CASE WHEN a + b*z + c*z*z > 0 THEN -(b + 2*c*z) / 50.0 / (a + b*z + c*z*z) END for z in [-1.0, -0.8, -0.6, -0.4, -0.2, 0.0, 0.2, 0.4, 0.6, 0.8, 1.0]] AS betas FROM r)
SELECT l_suppkey, round(betas[5], 9) AS beta_40, round(betas[11], 9) AS beta_100, round(r2, 6) AS r2, n FROM g WHERE r2 >= 0.99 AND len(list_filter(betas, lambda v: v <= 0)) = 0""")
def beta_fit(spark, d):
    p = read(spark, d, "lineitem").select("l_suppkey", "l_linenumber").where("l_suppkey % 6 <> 2 or l_linenumber < 3").distinct()
    p = p.withColumn("t", ((c("l_linenumber") - 1) * 10).cast("double")).withColumn("rho", F.expr(_RHO).cast("double"))
    fit = U.expansion_fits(p, ["l_suppkey"], "t", "rho", [10.0 * k for k in range(11)])
    return _r(fit.select("l_suppkey", "beta_40", "beta_100", "r2", c("n").cast("int").alias("n")), {"beta_40": 9, "beta_100": 9, "r2": 6})


_MERIT = "CASE WHEN {b} > 0 AND {s} > 0 THEN 0.12 * pow(({b} * (200.0 / p_retailprice * 1000.0) * ({s} * 1000.0)) / ({n} * 0.000001 * 0.12), 0.2813) END"


@query(f"""
WITH m AS (SELECT p_partkey, {_MERIT.format(b='(p_size / 100000.0)', s='0.8', n='5.0')} AS at_40, CASE WHEN p_size % 3 <> 0 THEN {_MERIT.format(b='(p_size / 100000.0)', s='0.7', n='2.0')} END AS at_100 FROM part)
SELECT p_partkey, round(at_100, 6) AS at_100, round(CASE WHEN at_40 IS NOT NULL AND at_100 IS NOT NULL THEN (at_40 + at_100) / 2 ELSE at_40 END, 6) AS average FROM m""")
def fom_average(spark, d):
    beta = c("p_size") / 100000.0
    known = F.when(c("p_size") % 3 != 0, F.lit(0.7))  # the density at 100 C isn't known for all
    at = lambda density, nu: M.merit_100(F.lit(0.12), F.lit(200.0), c("p_retailprice"), F.lit(nu), density, None, beta)
    p = read(spark, d, "part").select("p_partkey", at(F.lit(0.8), 5.0).alias("at_40"), at(known, 2.0).alias("at_100"))
    return _r(p.select("p_partkey", "at_100", M.merit_average(c("at_40"), c("at_100")).alias("average")), ["at_100", "average"])


@query()
def out_of_fold_classifier(spark, d):
    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars", F.length("lang").cast("double").alias("l")), "doc_id").withColumn("n_chars", c("n_chars").cast("double"))
    return ML.out_of_fold(x, "doc_id", ["n_chars", "l"], "quality", R.md5_fold(c("doc_id"), 3), 3, trees=3, depth=3, classify=True)


@query()
def nested_validation(spark, d):
    p = read(spark, d, "part").select("p_partkey", c("p_size").cast("double").alias("p_size"), "p_retailprice")
    return ML.out_of_fold(p, "p_partkey", ["p_size"], "p_retailprice", R.md5_fold(c("p_partkey"), 3), 3, trees=2, depths=(2, 3))


@query()
def quantile_intervals(spark, d):
    p = read(spark, d, "part").select("p_partkey", c("p_size").cast("double").alias("p_size"), "p_retailprice")
    return ML.interval_coverage(ML.quantile_leaves(p, ["p_size"], "p_retailprice")(p), "p_retailprice", "q10", "q90")


def _multinomial_sql(rows: str, key: str, weight: str, n: int, seed: int) -> str:
    """Every draw's place on the line of whole-unit weights, heavy rows first."""
    return f"""
WITH x AS (SELECT {key}, ({weight})::DOUBLE AS w, (('0x' || substr(md5({key}::VARCHAR || '#{seed}'), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS d FROM {rows}),
s AS (SELECT pow(2, floor(52 - log2(sum(w)))) AS scale FROM x WHERE w > 0), y AS (SELECT {key}, d, greatest(CAST(floor(w * scale + 0.5) AS BIGINT), 1) AS w FROM x, s WHERE x.w > 0),
t AS (SELECT sum(w)::BIGINT AS units FROM y),
o AS (SELECT {key}, w, sum(w) OVER (ORDER BY (w >= units / 4096.0) DESC, d, {key}) - w AS start FROM y, t),
u AS (SELECT CAST(floor(('0x' || substr(md5(i::VARCHAR || '#{seed}'), 1, 13))::BIGINT / 4503599627370496.0 * units) AS BIGINT) AS spot FROM range({n}) r(i), t)
SELECT {key}, count(*) AS copies FROM u JOIN o ON spot >= start AND spot < start + w GROUP BY 1"""


@query(_multinomial_sql("(SELECT doc_id FROM labels WHERE quality = 0)", "doc_id", "1.0", 300, 5))
def drawn_with_replacement(spark, d):
    return T.multinomial(read(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id", 300, 5)


@query(_multinomial_sql("orders", "o_orderkey", "CASE WHEN o_orderkey % 1000 = 1 THEN 20000000 ELSE o_totalprice END", 20_000, 6))
def drawn_by_weight(spark, d):
    weight = F.when(c("o_orderkey") % 1000 == 1, 20000000.0).otherwise(c("o_totalprice"))
    return T.multinomial(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 20_000, 6, weight).select("o_orderkey", "copies")


_U = "CAST(floor(('0x' || substr(md5(t::VARCHAR || '#{j}#3'), 1, 13))::BIGINT / 4503599627370496.0 * (n - {j})) AS BIGINT)"


@query(f"""
WITH p AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY (('0x' || substr(md5(p_partkey::VARCHAR || '#3'), 1, 8))::BIGINT + 0.5), p_partkey) - 1 AS number FROM part),
u AS (SELECT t, {", ".join(_U.format(j=j) + f" AS u{j}" for j in range(3))} FROM range(1000) r(t), (SELECT count(*) AS n FROM part)),
v AS (SELECT *, u1 + (u1 >= u0)::INT AS v1 FROM u), w AS (SELECT t, u0, v1, u2 + (u2 >= least(u0, v1))::INT AS v2, greatest(u0, v1) AS top FROM v),
e AS (SELECT t, unnest([u0, v1, v2 + (v2 >= top)::INT]) AS number FROM w)
SELECT CAST(t AS INTEGER) AS tournament, p_partkey FROM e JOIN p USING (number) QUALIFY row_number() OVER (PARTITION BY t ORDER BY p_retailprice DESC, p_partkey) = 1""")
def tournament_winners(spark, d):
    return T.tournaments(read(spark, d, "part").select("p_partkey", "p_retailprice"), "p_partkey", [c("p_retailprice").desc()], 1000, 3, 3).select("tournament", "p_partkey")


@query("""
WITH RECURSIVE o AS (SELECT DISTINCT p_retailprice AS x, 60.0::DOUBLE - p_size AS y FROM part),
r AS (SELECT x, y, 0 AS k FROM o UNION SELECT p.x, p.y, k + 1 FROM r JOIN o p ON r.x >= p.x AND r.y >= p.y AND (r.x > p.x OR r.y > p.y)),
f AS (SELECT x, y, max(k) AS front FROM r GROUP BY ALL)
SELECT p_partkey, CAST(front AS INTEGER) AS front FROM part JOIN f ON f.x = p_retailprice AND f.y = 60.0::DOUBLE - p_size""")
def every_front(spark, d):
    """All fronts at once, by longest chains over the cells of the plane."""
    o = read(spark, d, "part").select("p_partkey", c("p_retailprice").alias("x"), (60.0 - c("p_size")).alias("y"))
    return P.all_fronts(o, "x", "y", cell=5000).select("p_partkey", "front")
