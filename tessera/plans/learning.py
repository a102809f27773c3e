"""Queries over models that are grown here: quantile boosting, attribution, search, networks; the same in SQL where it can be told."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as R
from tessera.operators import boosting as B
from tessera.operators import gram as G
from tessera.operators import models as ML
from tessera.operators import network as N
from tessera.operators import search as S
from tessera.operators import sequence as Q
from tessera.plans.analytics import _r
from tessera.plans.registry import query, read
from tessera.session import dealt

c = F.col

# price by size, brand and length of the type's name; a fifth of the parts is held out
_FEATURES = {"size": ("CAST(p_size AS DOUBLE)", [5.0 * k for k in range(1, 10)]), "brand": ("CAST(substr(p_brand, 7, 2) AS DOUBLE)", [13.0, 22.0, 33.0, 42.0]), "kind": ("CAST(length(p_type) AS DOUBLE)", [14.0, 16.0, 18.0, 20.0, 22.0])}
_EDGES = [e for _, e in _FEATURES.values()]
_SHARES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
_TREES, _DEPTH, _RATE, _LEAST = 4, 2, 0.5, 20
_LOSSES = {m: B.pinball(a) for m, a in _SHARES.items()}


def _parts(spark, d):
    return read(spark, d, "part").select("p_partkey", c("p_retailprice").alias("y"), (F.pmod("p_partkey", F.lit(5)) != 0).alias("train"), *[F.expr(e).alias(f) for f, (e, _) in _FEATURES.items()])


def _fitted(parts, losses):
    return B.fit_boosted(parts, list(_FEATURES), "y", losses, trees=_TREES, depth=_DEPTH, rate=_RATE, least=_LEAST, edges=_EDGES, where={m: c("train") for m in losses})


def boosting_sql(shares: dict[str, float]) -> str:
    """Common tables of the same trees: r<t> (model, key, y, train, bins, pred after t trees), s<t> (splits), v<t> (leaves)."""
    case = lambda what: "CASE m " + " ".join(f"WHEN {k} THEN {what.format(a=a)}" for k, a in enumerate(shares.values())) + " END"
    bins = ", ".join("(" + " + ".join(f"(({e}) > {v})::INT" for v in edges) + ")" for e, edges in _FEATURES.values())
    at = "CASE s.f " + " ".join(f"WHEN {k} THEN bins[{k + 1}]" for k in range(len(_FEATURES))) + " END"
    with_ = [
        f"p AS MATERIALIZED (SELECT p_partkey, p_retailprice AS y, p_partkey % 5 <> 0 AS train, [{bins}] AS bins FROM part)",
        f"r0 AS MATERIALIZED (SELECT m, p_partkey, y, train, bins, {case('(SELECT quantile_cont(y, {a}) FROM p WHERE train)')} AS pred FROM p, range({len(shares)}) q(m))",
    ]
    for t in range(_TREES):
        g = f"CAST(floor(CASE WHEN y > pred THEN {case('{a}::DOUBLE')} ELSE {case('{a}::DOUBLE')} - 1 END * {B.STEPS} + 0.5) AS BIGINT)"
        with_.append(f"n{t}_0 AS MATERIALIZED (SELECT *, 0 AS node, {g} AS g FROM r{t})")
        for level in range(_DEPTH):
            n = f"n{t}_{level}"
            with_ += [
                f"h{n} AS (SELECT m, node, f, b, sum(g)::DOUBLE AS g, count(*) AS n FROM (SELECT m, node, g, unnest(bins) AS b, generate_subscripts(bins, 1) - 1 AS f FROM {n} WHERE train AND node >= {(1 << level) - 1}) GROUP BY ALL)",
                f"c{n} AS (SELECT *, sum(g) OVER u AS gl, sum(n) OVER u AS nl, sum(g) OVER o AS gt, sum(n) OVER o AS nt FROM h{n} WINDOW o AS (PARTITION BY m, node, f), u AS (PARTITION BY m, node, f ORDER BY b ROWS UNBOUNDED PRECEDING))",
                f"g{n} AS (SELECT *, gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) - gt * gt / nt AS gain FROM c{n} WHERE nl >= {_LEAST} AND nt - nl >= {_LEAST})",
                f"s{n} AS MATERIALIZED (SELECT m, node, f, b, nl::DOUBLE AS nl, nt::DOUBLE AS nt FROM g{n} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY m, node ORDER BY gain DESC, f, b) = 1)",
                f"n{t}_{level + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (node), CASE WHEN s.f IS NULL THEN x.node ELSE 2 * x.node + 1 + ({at} > s.b)::INT END AS node FROM {n} x LEFT JOIN s{n} s ON s.m = x.m AND s.node = x.node)",
            ]
        with_ += [
            f"s{t} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM sn{t}_{k}' for k in range(_DEPTH))})",
            f"v{t} AS MATERIALIZED (SELECT m, node, {case('quantile_cont(y - pred, {a})')} AS v FROM n{t}_{_DEPTH} WHERE train GROUP BY m, node)",
            f"r{t + 1} AS MATERIALIZED (SELECT x.m, p_partkey, y, train, bins, pred + {_RATE} * v AS pred FROM n{t}_{_DEPTH} x JOIN v{t} v ON v.m = x.m AND v.node = x.node)",
        ]
    return "WITH " + ",\n".join(with_)


@query(boosting_sql(_SHARES) + "\nSELECT p_partkey, " + ", ".join(f"round(max(pred) FILTER (m = {k}), 6) AS {m}" for k, m in enumerate(_SHARES)) + f" FROM r{_TREES} GROUP BY 1")
def boosted_quantiles(spark, d):
    parts = _parts(spark, d)
    models = _fitted(parts, _LOSSES)
    return _r(dealt(parts, B.SHARE).select("p_partkey", *[m.predict().alias(n) for n, m in models.items()]), list(_SHARES))


_LOSS = "avg(CASE WHEN y > pred THEN (y - pred) * a ELSE (y - pred) * (a - 1) END)"


@query(
    boosting_sql(_SHARES) + ",\nx AS (" + " UNION ALL ".join(f"SELECT {t} AS trees, * FROM r{t}" for t in range(_TREES + 1)) + f""")
SELECT {'CASE m ' + ' '.join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_SHARES)) + ' END'} AS model, CAST(trees AS INTEGER) AS trees, train, round({_LOSS} + 3e-10::DOUBLE, 6) AS loss, round(avg((y <= pred)::INT), 8) AS below, count(*) AS n
FROM (SELECT *, {'CASE m ' + ' '.join(f"WHEN {k} THEN {a}::DOUBLE" for k, a in enumerate(_SHARES.values())) + ' END'} AS a FROM x) GROUP BY 1, 2, 3"""
)
def quantile_stages(spark, d):
    """Pinball loss and coverage after every tree, on training and held-out rows."""
    parts = _parts(spark, d)
    models = _fitted(parts, _LOSSES)
    stages = [F.struct(F.lit(m).alias("model"), F.lit(t).alias("trees"), F.lit(_SHARES[m]).alias("a"), model.upto(t).predict().alias("pred")) for m, model in models.items() for t in range(_TREES + 1)]
    rows = dealt(parts, B.SHARE).select("y", "train", F.explode(F.array(*stages)).alias("r")).select("y", "train", "r.*")
    loss = F.when(c("y") > c("pred"), (c("y") - c("pred")) * c("a")).otherwise((c("y") - c("pred")) * (c("a") - 1))
    out = rows.groupBy("model", "trees", "train").agg(F.avg(loss).alias("loss"), F.avg((c("y") <= c("pred")).cast("int")).alias("below"), F.count(F.lit(1)).alias("n"))
    return _r(out.withColumn("loss", c("loss") + 3e-10), {"loss": 6, "below": 8})  # means of these prices end in exact halves


@query(
    boosting_sql(_SHARES) + ",\nx AS (" + " UNION ALL ".join(f"SELECT m, p_partkey, y, pred FROM r{_TREES} WHERE NOT train" for _ in (0,)) + """),
w AS (SELECT p_partkey, y, max(pred) FILTER (m = 0) AS low, max(pred) FILTER (m = 2) AS high FROM x GROUP BY ALL)
SELECT round(avg((y >= low AND y <= high)::INT), 6) AS coverage, round(avg(high - low), 6) AS width, count(*) AS n FROM w"""
)
def boosted_coverage(spark, d):
    from tessera.operators.models import interval_coverage

    parts = _parts(spark, d)
    models = _fitted(parts, _LOSSES)
    held = dealt(parts, B.SHARE).where(~c("train")).select("y", *[m.predict().alias(n) for n, m in models.items()])
    return _r(interval_coverage(held, "y", "q10", "q90"), ["coverage", "width"])


def _shapley_sql() -> str:
    """Shapley values by their definition: the expected prediction for every subset of known features."""
    p = len(_FEATURES)
    at = "CASE s.f " + " ".join(f"WHEN {k} THEN bins[{k + 1}]" for k in range(p)) + " END"
    parts = [boosting_sql({"q50": 0.5}), f"k AS (SELECT p_partkey, bins, k FROM p, range({1 << p}) q(k))"]
    for t in range(_TREES):
        parts.append(f"w{t}_0 AS (SELECT p_partkey, bins, k, 0 AS node, 1.0::DOUBLE AS w FROM k)")
        for level in range(_DEPTH):
            parts.append(
                f"w{t}_{level + 1} AS (SELECT x.p_partkey, x.bins, x.k, CASE WHEN s.f IS NULL THEN x.node ELSE 2 * x.node + 1 + side END AS node, CASE WHEN s.f IS NULL THEN x.w WHEN (x.k >> s.f) & 1 = 1 THEN x.w * (({at} > s.b)::INT = side)::INT ELSE x.w * CASE side WHEN 0 THEN s.nl ELSE s.nt - s.nl END / s.nt END AS w"
                f" FROM w{t}_{level} x CROSS JOIN range(2) q(side) LEFT JOIN sn{t}_{level} s ON s.node = x.node WHERE s.f IS NOT NULL OR side = 0)"
            )
    parts.append("e AS MATERIALIZED (SELECT p_partkey, k, sum(y) AS y FROM (" + " UNION ALL ".join(f"SELECT p_partkey, k, {_RATE} * w * v AS y FROM w{t}_{_DEPTH} x JOIN v{t} v ON v.node = x.node" for t in range(_TREES)) + ") GROUP BY ALL)")
    fact = [1, 1, 2, 6, 24]
    weight = "CASE bit_count(a.k::INT) " + " ".join(f"WHEN {s} THEN {fact[s] * fact[p - 1 - s]} / {fact[p]}.0::DOUBLE" for s in range(p)) + " END"
    start = "(SELECT quantile_cont(y, 0.5) FROM p WHERE train)"
    parts.append(f"f AS (SELECT a.p_partkey, i, sum({weight} * (b.y - a.y)) AS phi FROM e a CROSS JOIN range({p}) q(i) JOIN e b ON b.p_partkey = a.p_partkey AND b.k = a.k + (1 << i) WHERE (a.k >> i) & 1 = 0 GROUP BY ALL)")
    names = ", ".join(f"round(max(phi) FILTER (i = {k}), 6) AS shap_{f}" for k, f in enumerate(_FEATURES))
    return ",\n".join(parts) + f"\nSELECT p_partkey, round(any_value(e.y) + {start}, 6) AS base, {names}, round(any_value(r.pred), 6) AS prediction FROM f JOIN e USING (p_partkey) JOIN r{_TREES} r USING (p_partkey) WHERE e.k = 0 GROUP BY 1"


@query(_shapley_sql())
def tree_shap(spark, d):
    """The median model's prediction of every part, by feature."""
    parts = _parts(spark, d)
    model = _fitted(parts, {"q50": B.pinball(0.5)})["q50"]
    out = B.explain(dealt(parts, B.SHARE), model, ["p_partkey"])
    return _r(out, ["base", *[f"shap_{f}" for f in _FEATURES], "prediction"])


# ---------------------------------------------------------------- search, networks, held-out deciles


@query()
def search_trials(spark, d):
    """Trials of a Parzen search over ridge regressions on lineitem, some given up between folds."""
    li = read(spark, d, "lineitem")
    columns = {"q": c("l_quantity"), "qq": c("l_quantity") * c("l_quantity") / 50, "tax": c("l_tax") * 100, "off": c("l_discount") * 100, "line": c("l_linenumber")}
    objective = S.RidgeFolds(li, columns, c("l_extendedprice"), R.md5_fold(c("l_orderkey"), 5), 5)
    trials = S.search(objective, {"penalty": S.Between(1e-6, 1e2, log=True), "terms": S.Between(1, 5, whole=True)}, 40, 5, seed=1)
    return _r(S.trial_table(spark, trials), ["value", "best"], 3)


@query()
def network_out_of_fold(spark, d):
    """Held-out predictions of small networks for every part."""
    p = _parts(spark, d).withColumn("fold", F.pmod("p_partkey", F.lit(2)).cast("int"))
    return _r(N.out_of_fold(p, "p_partkey", list(_FEATURES), "y", "fold", 2, hidden=(6,), steps=8, slices=2), ["y_pred"], 4)


_HOLDOUT = "SELECT p_size::DOUBLE AS f, p_retailprice AS y, ((p_partkey * 37) % 1009)::DOUBLE + p_size / 100.0 AS d FROM part"
_MODEL = "[regr_intercept(y, f) FILTER (bin <> {k}), regr_slope(y, f) FILTER (bin <> {k})]"


@query(f"""
WITH x AS ({_HOLDOUT}), e AS (SELECT quantile_cont(d, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e, quantile_cont(d, [0.925, 0.95, 0.975]) AS t FROM x),
b AS (SELECT f, y, d, CAST(len(list_filter(e[2:10], lambda v: v < d)) AS INTEGER) AS bin, CAST(len(list_filter(t, lambda v: v <= d)) AS INTEGER) AS sub FROM x, e),
m AS (SELECT [{", ".join(_MODEL.format(k=k) for k in range(10))}] AS m FROM b), p AS (SELECT b.*, m[bin + 1][1] + m[bin + 1][2] * f AS p FROM b, m),
k AS (SELECT 'decile' AS kind, bin, y, d, p FROM p UNION ALL SELECT 'tail', sub, y, d, p FROM p WHERE bin = 9)
SELECT kind, bin, (SELECT count(*) FROM b) - CASE kind WHEN 'tail' THEN (SELECT count(*) FROM b WHERE bin = 9) ELSE count(*) END AS n_train, count(*) AS n_test, round(avg(d), 6) AS distance_mean, round(min(d), 6) AS distance_min, round(max(d), 6) AS distance_max,
 round(1 - sum(pow(p - y, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg(pow(p - y, 2))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae FROM k GROUP BY 1, 2""")
def decile_curve(spark, d):
    p = read(spark, d, "part").select(c("p_size").cast("double").alias("f"), c("p_retailprice").alias("y"), (((c("p_partkey") * 37) % 1009).cast("double") + c("p_size") / 100.0).alias("d"))
    return _r(ML.decile_holdout(p, "d", ["f"], "y"), ["distance_mean", "distance_min", "distance_max", "r2", "rmse", "mae"])


_TRIPLE = ["l_quantity", "l_extendedprice", "l_tax"]


@query("SELECT i, j, round(corr, 8) AS corr FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, corr({a}, {b}) AS corr FROM lineitem" for a in _TRIPLE for b in _TRIPLE) + ")")
def blocked_correlations(spark, d):
    """Correlations by matrix products of Arrow batches, summed by block."""
    m = G.moments(read(spark, d, "lineitem"), _TRIPLE, block=2)
    corr = G.correlations(m)
    rows = [(a, b, float(round(corr[i, j], 8))) for i, a in enumerate(_TRIPLE) for j, b in enumerate(_TRIPLE)]
    return spark.createDataFrame(rows, "i string, j string, corr double")


@query()
def sequence_curve(spark, d):
    """The loss of a recurrent model of the brands' and types' names, step by step."""
    p = read(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("text"))
    letters = [r.char for r in R.vocabulary(p, "text").orderBy("idx").collect()]
    _, curve = Q.fit(p, "text", Q.new(letters, 6, 12, 1), 6, 0.05)
    return spark.createDataFrame([(k, float(round(x, 3))) for k, x in enumerate(curve)], "step int, loss double")
