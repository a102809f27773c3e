"""Reports over runs and models: prediction cubes, generation and front statistics, comparisons, controls and rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.formulas import quadratic_fit
from tessera.operators.pareto import skyline2
from tessera.operators.quantiles import exact_quantiles, linear_spots
from tessera.operators.selection import groupwise_top, random_sample
from tessera.operators.similarity import mean_pairwise
from tessera.operators.windows import hypervolume


def median_by(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    return exact_quantiles(df, keys, value, linear_spots([0.5])).select(*keys, F.col("quantiles")[0].alias(name))


# ---------------------------------------------------------------- predictions of several models


def cube(df: DataFrame, key: str, models: dict[tuple[str, str, int], Column]) -> DataFrame:
    """key, prop, arch, fold, pred: the predictions of all models in long form, from one scan."""
    cells = F.array(*[F.struct(F.lit(p).alias("prop"), F.lit(a).alias("arch"), F.lit(f).alias("fold"), c.cast("double").alias("pred")) for (p, a, f), c in models.items()])
    return df.select(key, F.explode(cells).alias("c")).select(key, "c.*")


def arch_values(long: DataFrame, key: str) -> DataFrame:
    """Each architecture's mean over its folds."""
    return long.groupBy(key, "prop", "arch").agg(F.avg("pred").alias("arch_mean"))


def wide(df: DataFrame, keys: list[str], levels: list[str], names: list[tuple], agg: Column) -> DataFrame:
    """A pivot over several columns at once; names are the combinations, joined by _ in the result."""
    joined = df.withColumn("_cell", F.concat_ws("_", *[F.col(x).cast("string") for x in levels]))
    return joined.groupBy(*keys).pivot("_cell", ["_".join(map(str, n)) for n in names]).agg(agg)


def consensus_gates(values: DataFrame, key: str, gates: list[tuple[str, str, float]]) -> DataFrame:
    """key and for every (prop, sense, limit): mean, sd, pass, marginal (limit within one sd) and how many architectures pass; then all_pass, any_marginal."""
    aggs = []
    for p, sense, limit in gates:
        v = F.when(F.col("prop") == p, F.col("arch_mean"))
        ok = v <= limit if sense == "max" else v >= limit
        aggs += [F.avg(v).alias(f"{p}_mean"), F.stddev_samp(v).alias(f"{p}_sd"), F.count_if(ok).alias(f"{p}_n_arch_pass")]
    out = values.groupBy(key).agg(*aggs)
    for p, sense, limit in gates:
        m, s = F.col(f"{p}_mean"), F.col(f"{p}_sd")
        out = out.withColumn(f"{p}_pass", F.coalesce(m <= limit if sense == "max" else m >= limit, F.lit(False))).withColumn(f"{p}_marginal", F.coalesce(F.abs(m - limit) <= s, F.lit(False)))
    every = lambda end: [F.col(f"{p}_{end}") for p, _, _ in gates]
    return out.withColumn("all_pass", F.least(*every("pass")) if len(gates) > 1 else every("pass")[0]).withColumn("any_marginal", F.greatest(*every("marginal")) if len(gates) > 1 else every("marginal")[0])


def relative_spread(consensus: DataFrame, group: str) -> DataFrame:
    """The median over rows of sd and of 100 sd / |mean|, for every group."""
    return median_by(consensus, [group], F.col("sd"), "sd").join(median_by(consensus, [group], 100 * F.col("sd") / F.abs("mean"), "relative"), group)


def refit_control(df: DataFrame, full: str, folds: list[str], sense: str, limit: float, keys: list[str] = ()) -> DataFrame:
    """How a model of all data and the mean of the fold models pass a gate, and how far they are apart."""
    keys = list(keys)
    mean = sum((F.col(f) for f in folds[1:]), F.col(folds[0])) / len(folds)
    spread = F.sqrt(sum(((F.col(f) - mean) * (F.col(f) - mean) for f in folds[1:]), (F.col(folds[0]) - mean) * (F.col(folds[0]) - mean)) / (len(folds) - 1))
    ok = lambda x: x <= limit if sense == "max" else x >= limit
    rows = df.select(*keys, F.col(full).alias("_full"), mean.alias("_mean"), spread.alias("_sd"))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok(F.col("_full"))).alias("full_pass"), F.count_if(ok(F.col("_mean"))).alias("fold_pass"), F.avg(F.col("_mean") - F.col("_full")).alias("mean_shift")
    )
    shift, sd = median_by(rows, keys, F.col("_mean") - F.col("_full"), "median_shift"), median_by(rows, keys, F.col("_sd"), "median_fold_sd")
    return out.join(shift, keys).join(sd, keys) if keys else out.join(F.broadcast(shift)).join(F.broadcast(sd))


# ---------------------------------------------------------------- generations and fronts


def generation_report(df: DataFrame, keys: list[str], values: list[str], valid: Column) -> DataFrame:
    """Mean, sd, min and max of every value, and how many rows are valid."""
    stats = [f(v).alias(f"{v}_{n}") for v in values for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "min"), (F.max, "max"))]
    ok = F.coalesce(valid, F.lit(False))
    return df.groupBy(*keys).agg(*stats, F.count_if(ok).alias("n_valid"), (100 * F.avg(ok.cast("double"))).alias("pct_valid"))


def front_report(df: DataFrame, keys: list[str], x: str, y: str, ref: tuple[float, float], values: list[str], valid: Column) -> DataFrame:
    """generation_report with the size of the first front and the area that it covers (both objectives maximised)."""
    front = skyline2(df, x, y, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_front"))
    return generation_report(df, keys, values, valid).join(front, keys, "left").join(hypervolume(df, keys, x, y, ref), keys, "left").fillna(0, ["n_front", "hypervolume"])


def compare_methods(df: DataFrame, method: str, category: str, gain: str, price: str, ref: tuple[float, float], cheap: float) -> DataFrame:
    """For every method and category: the front of high gain and low price, its area, extent and number of cheap members."""
    keys = [method, category]
    points = df.withColumn("_low", -F.col(price))
    front = skyline2(points, gain, "_low", keys)
    spread = lambda c: F.max(c) - F.min(c)
    out = front.groupBy(*keys).agg(F.count(F.lit(1)).alias("front_size"), F.max(gain).alias("best"), spread(gain).alias("gain_spread"), spread(price).alias("price_spread"), F.count_if(F.col(price) < cheap).alias("cheap_count"))
    return out.join(hypervolume(front, keys, gain, "_low", ref), keys, "left").fillna(0.0, ["hypervolume"])


def skyline_by_bins(df: DataFrame, objectives: list[str], by: str, width: float) -> DataFrame:
    """The three-objective skyline of what is left when each bin of one objective keeps its two-objective skyline.

    A quick heuristic: the pruned rows of one bin can't dominate rows of another, so it may keep more than the exact skyline.
    """
    from tessera.operators.pareto import skyline

    x, y = (o for o in objectives if o != by)
    binned = df.withColumn("_bin", F.floor(F.col(by) / width))
    return skyline(skyline2(binned, x, y, ["_bin"]).drop("_bin"), objectives)


def top_summary(df: DataFrame, config: list[str], run: str, value: str, key: str, k: int = 10) -> DataFrame:
    """For every configuration, over its runs: best value, mean of the best k, and rows."""
    keys = [*config, run]
    best = groupwise_top(df, keys, [[F.col(value).desc(), F.col(key)]], k).groupBy(*keys).agg(F.avg(value).alias("_top"))
    per_run = df.groupBy(*keys).agg(F.max(value).alias("_best"), F.count(F.lit(1)).alias("_n")).join(best, keys)
    stats = [f(c).alias(f"{n}_{s}") for c, n in (("_best", "best"), ("_top", "top"), ("_n", "n_valid")) for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return per_run.groupBy(*config).agg(F.count(F.lit(1)).alias("n_runs"), *stats)


def restarts(stagnant: DataFrame, keys: list[str], order: str, window: int, most: int) -> DataFrame:
    """n_restarts so far: one whenever the steps without improvement reach a multiple of the window, `most` at most.  Follows windows.stagnation."""
    hit = ((F.col("stagnant") > 0) & (F.col("stagnant") % window == 0)).cast("int")
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return stagnant.withColumn("n_restarts", F.least(F.sum(hit).over(upto), F.lit(most)))


def expansion_fits(df: DataFrame, keys: list[str], t: str, rho: str, at: list[float], least: int = 3, steady: float = 0.99) -> DataFrame:
    """keys, beta_<t> for every temperature, r2 and n of the quadratic density fit of each group, from one pass of sums.

    Groups with fewer points, a poorer fit or a beta that isn't positive everywhere are left out.
    """
    known = df.where(F.col(t).isNotNull() & F.col(rho).isNotNull())
    x, y = (F.col(t) - 50.0) / 50.0, F.col(rho).cast("double")  # centred, for the conditioning of the sums
    power = lambda k: F.pow(x, F.lit(float(k)))
    sums = {f"s{k}": power(k) for k in (1, 2, 3, 4)} | {f"t{k}": power(k) * y for k in (0, 1, 2)} | {"yy": y * y}
    s = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(f"_{n}") for n, e in sums.items()]).where(F.col("n") >= least)
    a, b, c = quadratic_fit(F.col("n"), [F.col(f"_s{k}") for k in (1, 2, 3, 4)], [F.col(f"_t{k}") for k in (0, 1, 2)])
    names = [f"beta_{v:g}" for v in at]

    def fitted(f: Column) -> Column:
        """All results of one group from its coefficients, which are computed once."""
        rest = F.col("_yy") - f["a"] * F.col("_t0") - f["b"] * F.col("_t1") - f["c"] * F.col("_t2")
        spread = F.col("_yy") - F.col("_t0") * F.col("_t0") / F.col("n")

        def beta(v: float) -> Column:
            z = (v - 50.0) / 50.0
            level = f["a"] + f["b"] * z + f["c"] * (z * z)
            return F.when(level > 0, -(f["b"] + f["c"] * (2 * z)) / 50.0 / level)

        return F.struct(F.array(*map(beta, at)).alias("betas"), F.when(spread > 0, 1 - rest / spread).otherwise(0.0).alias("r2"))

    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    good = lambda r: F.struct(r["betas"].alias("betas"), r["r2"].alias("r2"), ((r["r2"] >= steady) & ~F.exists(r["betas"], lambda v: v <= 0)).alias("ok"))
    out = s.select(*keys, "n", once(once(F.struct(a.alias("a"), b.alias("b"), c.alias("c")), fitted), good).alias("_r")).where("_r.ok")
    return out.select(*keys, *[F.get("_r.betas", F.lit(k)).alias(n) for k, n in enumerate(names)], F.col("_r.r2").alias("r2"), "n")


# ---------------------------------------------------------------- counts and rates


def distinct_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def rates(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """The share of rows with each flag, missing ones left out, and the number of rows."""
    return df.groupBy(*keys).agg(*[F.avg(f.cast("double")).alias(n) for n, f in flags.items()], F.count(F.lit(1)).alias("n"))


def merge_report(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of both tables, in both, only new, and in all."""
    both = old.select(key, F.lit(1).alias("_o"), F.lit(0).alias("_n")).union(new.select(key, F.lit(0), F.lit(1))).where(F.col(key).isNotNull())
    each = both.groupBy(key).agg(F.max("_o").alias("_o"), F.max("_n").alias("_n"))
    return each.agg(
        F.sum("_o").alias("n_old"), F.sum("_n").alias("n_new"), F.count_if((F.col("_o") == 1) & (F.col("_n") == 1)).alias("n_overlap"), F.count_if(F.col("_o") == 0).alias("n_added"), F.count(F.lit(1)).alias("n_merged")
    )


def for_category(df: DataFrame, category: str, biodegradable: str = "is_biodegradable", stable: str = "is_stable") -> DataFrame:
    """The rows that a category's name asks for: bio_* the biodegradable ones, *_stable the stable ones; absent columns ask for nothing."""
    for wanted, column in ((category.startswith("bio_"), biodegradable), (category.endswith("_stable"), stable)):
        if wanted and column in df.columns:
            df = df.where(F.coalesce(F.col(column), F.lit(False)))
    return df


def renumber_by_size(df: DataFrame, cluster: str, order: str, name: str = "rank") -> DataFrame:
    """Clusters numbered from 0 by falling size, the one that appears first if tied.

    Clusters of one size are numbered inside the size; the sizes, far fewer than rows, carry the running count.
    """
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_size"), F.min(order).alias("_first"))
    inside = Window.partitionBy("_size").orderBy("_first", cluster)
    above = Window.orderBy(F.col("_size").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row for each size that occurs
    before = sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(above), F.lit(0))).drop("_c")
    ranked = sizes.withColumn("_in", F.row_number().over(inside) - 1).join(before, "_size").select(cluster, (F.col("_before") + F.col("_in")).cast("int").alias(name))
    return df.join(ranked, cluster)


def trimmed_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values that both tables have once blanks at the ends are gone."""
    return a.select(F.trim(column).alias(column)).intersect(b.select(F.trim(column).alias(column)))


def sampled_pairwise(df: DataFrame, key: str, word: str, exact: int, sample: int, seed: int = 0) -> DataFrame:
    """The mean similarity over all pairs of up to `exact` rows, else over the pairs of a fixed hash sample."""
    return mean_pairwise(df if df.limit(exact + 1).count() <= exact else random_sample(df, key, sample, seed), key, word)


def memoised(df: DataFrame, column: str, compute: Callable[[Column], Column], name: str) -> DataFrame:
    """A costly function once for each distinct value, joined back to all rows; missing values give the function of null."""
    known = df.select(F.col(column).alias("_value")).distinct().withColumn(name, compute(F.col("_value")))
    return df.join(known, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")
