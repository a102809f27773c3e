"""Boosting, attribution, search and networks against plain Python."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting as B
from tessera.operators import network as N
from tessera.operators import search as S
from tessera.operators import sequence as Q


def rows_of(n=600, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 6)).round(2)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0.3, 4.0, 0.0) * (x[:, 2] > 0) + r.normal(size=n) * (1 + np.abs(x[:, 3]))
    return [(k, *map(float, x[k]), float(y[k])) for k in range(n)]


NAMES = [f"f{k}" for k in range(6)]
SCHEMA = "key long, " + ", ".join(f"{n} double" for n in NAMES) + ", y double"


@pytest.fixture(scope="module")
def data():
    return rows_of()


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def models(table):
    losses = {"mean": B.squared(), "q10": B.pinball(0.1), "q90": B.pinball(0.9)}
    return losses, B.fit_boosted(table, NAMES, "y", losses, trees=10, depth=2, rate=0.5, least=10, bins=16)


def plain_prediction(model, x):
    out = model.base
    for t in model.trees:
        node = 0
        while t.feature[node] >= 0:
            v = x[t.feature[node]]
            node = 2 * node + 1 + (not (v is not None and v <= t.cut[node]))
        out += model.rate * t.value[node]
    return out


def plain_boosting(rows, alpha, edges, trees, depth, rate, least):
    """The same trees by loops over rows."""
    y = np.array([r[-1] for r in rows])
    bins = np.array([[sum(e < v for e in edge) for v, edge in zip(r[1:-1], edges)] for r in rows])
    unit = 2.0 ** math.ceil(math.log2(y.max() - y.min()))
    best = lambda v: np.quantile(v, alpha) if alpha is not None else v.mean()
    pred = np.full(len(y), best(y))
    for _ in range(trees):
        g = np.floor((np.where(y > pred, alpha, alpha - 1) if alpha is not None else (y - pred) / unit) * B.STEPS + 0.5)
        node = np.zeros(len(y), int)
        for level in range(depth):
            for k in range((1 << level) - 1, (2 << level) - 1):
                own = node == k
                found = None
                for f in range(bins.shape[1]):
                    for b in sorted(set(bins[own, f])):
                        left = own & (bins[:, f] <= b)
                        nl, n = left.sum(), own.sum()
                        if nl >= least and n - nl >= least:
                            gl, gt = g[left].sum(), g[own].sum()
                            gain = gl * gl / nl + (gt - gl) * (gt - gl) / (n - nl) - gt * gt / n
                            if gain > 0 and (found is None or gain > found[0]):
                                found = gain, f, b
                if found:
                    node[own] = 2 * k + 1 + (bins[own, found[1]] > found[2])
        step = np.zeros(len(y))
        for k in set(node):
            step[node == k] = best((y - pred)[node == k])
        pred = pred + rate * step
    return pred


def test_predictions_follow_the_trees(table, data, models):
    _, fitted = models
    for model in fitted.values():
        got = {r.key: r.p for r in table.select("key", model.predict().alias("p")).collect()}
        assert all(abs(got[r[0]] - plain_prediction(model, r[1:-1])) < 1e-9 for r in data)


def test_loss_falls_with_trees_and_intervals_cover(table, models):
    losses, fitted = models
    rows = {(r.model, r.trees): r.loss for r in B.staged_losses(table, fitted, losses, "y", [0, 1, 3, 10]).collect()}
    for m in losses:
        curve = [rows[m, t] for t in (0, 1, 3, 10)]
        assert all(a > b for a, b in zip(curve, curve[1:])), (m, curve)
    assert rows["mean", 10] < 0.35 * rows["mean", 0]
    inside = table.select(F.avg(((F.col("y") >= fitted["q10"].predict()) & (F.col("y") <= fitted["q90"].predict())).cast("double"))).first()[0]
    assert 0.75 < inside < 0.9


@pytest.mark.parametrize("few", [B.FEW, 0])
def test_trees_as_by_loops(table, data, monkeypatch, few):
    """Also with leaf quantiles by counted slices."""
    monkeypatch.setattr(B, "FEW", few)
    edges = [[-1.0, 0.0, 0.5, 1.0], [0.3], [0.0], [], [-0.5, 0.5], [0.1]]
    losses = {"mean": B.squared(), "q25": B.pinball(0.25)} if few else {"q25": B.pinball(0.25)}
    trees = 3 if few else 1
    fitted = B.fit_boosted(table, NAMES, "y", losses, trees=trees, depth=2, rate=0.7, least=15, edges=edges)
    for m, loss in losses.items():
        want = plain_boosting(data, loss.alpha, edges, trees, 2, 0.7, 15)
        got = {r.key: r.p for r in table.select("key", fitted[m].predict().alias("p")).collect()}
        assert np.allclose([got[r[0]] for r in data], want, atol=1e-9)


def test_more_trees_than_are_evaluated_on_the_fly(table, monkeypatch):
    fit = lambda: B.fit_boosted(table, NAMES[:2], "y", {"m": B.squared()}, trees=5, depth=1, bins=4)["m"]
    far = fit()
    monkeypatch.setattr(B, "REFRESH", 2)
    near = fit()
    assert [t.feature for t in near.trees] == [t.feature for t in far.trees]
    assert np.allclose([t.value for t in near.trees], [t.value for t in far.trees])


def test_training_rows_samples_and_missing_values(spark, table):
    rows = [(k, None if k % 3 == 0 else float(k % 7), 5.0 if k % 3 == 0 else 1.0) for k in range(90)] + [(100, 1.0, None), (101, float("nan"), 5.0)]
    df = spark.createDataFrame(rows, "key long, a double, y double")
    fitted = B.fit_boosted(df, ["a"], "y", {"all": B.squared(), "some": B.squared()}, trees=1, depth=1, rate=1.0, least=5, where={"some": F.col("key") < 30})
    got = {r.key: (r.p, r.q) for r in df.select("key", fitted["all"].predict().alias("p"), fitted["some"].predict().alias("q")).collect()}
    assert abs(got[0][0] - 5) < 1e-12 and abs(got[1][0] - 1) < 1e-12 and abs(got[101][1] - 5) < 1e-12
    assert fitted["some"].trees[0].cover[0] == 30 and fitted["all"].trees[0].cover[0] == 91
    half = B.fit_boosted(table, NAMES, "y", {"m": B.squared()}, trees=2, depth=1, key="key", subsample=0.5)["m"]
    assert all(200 < t.cover[0] < 400 for t in half.trees) and half.trees[0].cover != half.trees[1].cover
    none = B.fit_boosted(df.where("key < 0"), ["a"], "y", {"m": B.pinball(0.5)}, trees=1, depth=1)["m"]
    assert df.select(none.predict().alias("p")).distinct().collect()[0].p == 0.0


# ---------------------------------------------------------------- attribution


def expected(model, x, known):
    def at(t, node):
        f = t.feature[node]
        if f < 0:
            return t.value[node]
        left, right = 2 * node + 1, 2 * node + 2
        if f in known:
            return at(t, left if x[f] is not None and x[f] <= t.cut[node] else right)
        return (t.cover[left] * at(t, left) + t.cover[right] * at(t, right)) / t.cover[node]

    return model.base + model.rate * sum(at(t, 0) for t in model.trees)


def test_attribution_against_all_subsets(spark, table, data):
    model = B.fit_boosted(table, NAMES, "y", {"m": B.squared()}, trees=4, depth=4, rate=0.6, least=5, bins=12)["m"]
    assert any(len(seen) < 4 for t in model.trees for seen, _ in B.leaf_paths(t))  # a feature twice on a path
    some = spark.createDataFrame([*data[:12], (-1, None, 0.0, None, 1.0, 2.0, 3.0, 0.0)], SCHEMA)
    for r in B.explain(some.withColumn("_s0", F.lit("x")), model, ["key", "y", "_s0"]).collect():
        x = next(d for d in [*data, (-1, None, 0.0, None, 1.0, 2.0, 3.0, 0.0)] if d[0] == r.key)[1:-1]
        want = [0.0] * 6
        for i in range(6):
            rest = [j for j in range(6) if j != i]
            for n in range(6):
                w = math.factorial(n) * math.factorial(5 - n) / math.factorial(6)
                for s in itertools.combinations(rest, n):
                    want[i] += w * (expected(model, x, {*s, i}) - expected(model, x, set(s)))
        got = [r[f"shap_{n}"] for n in NAMES]
        assert np.allclose(got, want, atol=1e-9)
        assert abs(r.base + sum(got) - r.prediction) < 1e-9 and abs(r.prediction - plain_prediction(model, x)) < 1e-9
        assert abs(r.base - expected(model, x, set())) < 1e-9


# ---------------------------------------------------------------- search


def bowl(params, fold):
    """Least at a = 0.3, b = 1e-3, kind = 'y'; folds differ a little."""
    return (params["a"] - 0.3) ** 2 + 0.05 * (math.log10(params["b"]) + 3) ** 2 + (params["kind"] != "y") * 0.3 + 0.001 * ((fold * 7) % 5) + 0.01 * abs(params["n"] - 4)


SPACE = {"a": S.Between(0.0, 1.0), "b": S.Between(1e-6, 1.0, log=True), "kind": S.Choice(("x", "y", "z")), "n": S.Between(1, 9, whole=True)}


def test_search_beats_random_draws():
    wins = 0
    for seed in range(7):
        led = S.best(S.search(bowl, SPACE, 60, 3, seed))
        plain = S.best(S.search(bowl, SPACE, 60, 3, seed, random_only=True))
        wins += led.value < plain.value
    assert wins >= 6


def test_trials_are_pruned_between_folds_and_repeatable(spark):
    calls = []
    trials = S.search(lambda p, k: calls.append(k) or bowl(p, k), SPACE, 40, 4, 3)
    assert trials == S.search(bowl, SPACE, 40, 4, 3)
    pruned = [t for t in trials if t.pruned]
    assert pruned and all(1 < len(t.folds) < 4 for t in pruned) and not any(t.pruned for t in trials[:10])
    assert len(calls) == sum(len(t.folds) for t in trials)
    for t in pruned:  # worse than the median of the trials completed before it
        others = [np.mean(o.folds[: len(t.folds)]) for o in trials[: t.number] if not o.pruned]
        assert np.mean(t.folds) > np.median(others)
    assert all(isinstance(t.params["n"], int) and 1 <= t.params["n"] <= 9 and 1e-6 <= t.params["b"] <= 1 and 0 <= t.params["a"] <= 1 for t in trials)
    rows = S.trial_table(spark, trials).orderBy("trial").collect()
    assert [r.state == "pruned" for r in rows] == [t.pruned for t in trials] and rows[-1].best == S.best(trials).value
    assert all(a.best >= b.best for a, b in zip(rows, rows[1:]))


def test_densities_are_densities():
    s = S.Between(2.0, 5.0)
    grid = np.linspace(2, 5, 3001)
    d = s.density([2.0, 2.1, 4.9], list(grid))
    assert abs(d.mean() - 1) < 0.01 and d.min() > 0  # over the unit range
    assert S.Choice(("a", "b")).density(["a", "a", "a"], ["a", "b"]).tolist() == [4 / 5, 1 / 5]


def test_ridge_folds_against_plain_fits(table, data):
    columns = {n: F.col(n) for n in NAMES[:3]}
    folds = S.RidgeFolds(table, columns, F.col("y"), F.pmod("key", F.lit(3)).cast("int"), 3)
    x = np.array([[1.0, *r[1:4]] for r in data])
    y = np.array([r[-1] for r in data])
    k = np.array([r[0] % 3 for r in data])
    for terms in (1, 3):
        for fold in range(3):
            a, b = x[k != fold][:, : 1 + terms], y[k != fold]
            g = a.T @ a
            p = np.diag(0.1 * np.diag(g))
            p[0, 0] = 0
            w = np.linalg.solve(g + p, a.T @ b)
            want = np.sqrt(np.mean((x[k == fold][:, : 1 + terms] @ w - y[k == fold]) ** 2))
            assert abs(folds({"penalty": 0.1, "terms": terms}, fold) - want) < 1e-9


def test_search_over_boosted_trees(spark, table):
    objective = S.boosted_folds(table.withColumn("fold", F.pmod("key", F.lit(2)).cast("int")), NAMES[:3], "y", "fold")
    space = {"trees": S.Between(1, 3, whole=True), "depth": S.Choice((1, 2)), "rate": S.Between(0.1, 1.0), "least": S.Choice((5, 20))}
    trials = S.search(objective, space, 3, 2, startup=2)
    assert len(trials) == 3 and all(0 < t.value < 10 for t in trials)


# ---------------------------------------------------------------- networks


def test_gradient_against_differences():
    r = np.random.default_rng(0)
    sizes = [3, 4, 2, 1]
    flat, x, y = N.start(sizes, 1) + 0.1, r.normal(size=(7, 3)), r.normal(size=7)
    loss, g = N.gradient(sizes, flat, x, y)
    assert abs(loss - 0.5 * ((N.forward(sizes, flat, x) - y) ** 2).sum()) < 1e-12
    for k in range(len(flat)):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        want = (N.gradient(sizes, flat + step, x, y)[0] - N.gradient(sizes, flat - step, x, y)[0]) / 2e-6
        assert abs(g[k] - want) < 1e-6


@pytest.mark.parametrize("fan_in", [64, 1])
def test_sums_over_tasks(spark, table, monkeypatch, fan_in):
    monkeypatch.setattr(N, "FAN_IN", fan_in)
    rows = table.select(F.array("f0", "f1").alias("x"), F.col("y"), F.array(F.col("key") < 100, F.lit(True)).alias("use")).repartition(5)
    sizes = [2, 3, 1]
    weights = [N.start(sizes, 1), N.start(sizes, 2)]
    got = N.summed(rows, sizes, weights)
    own = [(np.array(r.x), r.y, r.use) for r in rows.collect()]
    for k in range(2):
        x, y = np.array([a for a, _, u in own if u[k]]), np.array([b for _, b, u in own if u[k]])
        loss, g = N.gradient(sizes, weights[k], x, y)
        assert got[k][0] == len(y) and abs(got[k][1] - loss) < 1e-8 and np.allclose(got[k][2], g)


def test_networks_learn_and_are_kept(spark, table, tmp_path):
    df = table.withColumn("fold", F.pmod("key", F.lit(2)).cast("int")).unionByName(spark.createDataFrame([(9999, *[None] * 6, 1.0, 0)], SCHEMA + ", fold int"))
    nets, curves = N.fit_networks(df, "key", NAMES, "y", {"a": F.col("fold") == 0, "b": F.col("fold") == 1}, hidden=(8,), steps=30, rate=0.05, slices=2)
    assert all(np.mean([c[m] for c in curves[-4:]]) < 0.4 * curves[0][m] for m in (0, 1))
    N.save(spark, nets, str(tmp_path / "nets"))
    back = N.load(spark, str(tmp_path / "nets"))
    rows = N.predict(df, nets, ["key", "y"]).collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in N.predict(df, back, ["key", "y"]).collect()]
    by = {r.key: r for r in rows}
    assert by[9999].a is None and np.mean([(r.a - r.y) ** 2 for r in rows if r.a is not None]) < np.var([r.y for r in rows])
    out = N.out_of_fold(df, "key", NAMES, "y", "fold", 2, hidden=(4,), steps=6, slices=2).collect()
    assert len(out) == 600 and all(r.y_pred is not None for r in out)


# ---------------------------------------------------------------- sequences


def test_sequence_gradient_against_differences():
    m = Q.new(["a", "b"], 2, 3, 4)
    tokens, size = Q._padded([[2, 3, 3], [3], []])
    aim = np.array([-1.0, -2.0, -3.0])
    for weigh, loss in ((lambda x: -np.ones(3), lambda x: -x.sum()), (lambda x: -2 * (aim - x), lambda x: ((aim - x) ** 2).sum())):
        _, g = Q.log_probability(m, tokens, size, weigh)
        for k in range(len(m.weights)):
            step = np.zeros(len(m.weights))
            step[k] = 1e-6
            at = lambda d: loss(Q.log_probability(Q.Sequences(m.alphabet, m.wide, m.hidden, m.weights + d), tokens, size)[0])
            assert abs(g[k] - (at(step) - at(-step)) / 2e-6) < 1e-6
    # all strings of up to three characters and what is longer make one distribution
    every = [list(c) for n in range(3) for c in itertools.product([2, 3], repeat=n)]
    assert np.exp(Q.log_probability(m, *Q._padded(every))[0]).sum() < 1


def test_strings_are_learnt_and_steered(spark):
    texts = ["abab", "ab", "ababab", None, "abz", ""] * 10
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").repartition(3)
    prior, curve = Q.fit(df, "t", Q.new(["a", "b", "c"], 4, 8, 1), 40, 0.05)
    assert curve[-1] < 0.5 * curve[0]
    seeds = spark.range(300).withColumnRenamed("id", "seed")
    one, two = ({r.seed: (r.text, r.log_p) for r in Q.sample(x, prior, 12).collect()} for x in (seeds, seeds.repartition(7)))
    assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in two.items()}
    assert np.mean([set(t) <= {"a", "b"} and "aa" not in t and "bb" not in t for t, _ in one.values()]) > 0.7
    scored = spark.createDataFrame([("ab", 1.0), ("abab", 0.0), ("ababab", 0.0)] * 5, "t string, s double")
    agent, losses = Q.policy_steps(scored, "t", "s", prior, prior, 3.0, 15, 0.02)
    assert losses[-1] < 0.7 * losses[0]
    short = lambda m: np.mean([r.text == "ab" for r in Q.sample(seeds, m, 12).collect()])
    assert short(agent) > short(prior)


def test_equal_strings_are_one_row_that_counts_for_all(spark, monkeypatch):
    texts, m = ["ab"] * 5000 + ["b"] * 3000 + ["", "zz", None], Q.new(["a", "b"], 2, 3, 4)
    df = spark.createDataFrame([(t, 0.5 * (k % 2)) for k, t in enumerate(texts)], "t string, s double")
    seen, inner = [], Q._summed
    monkeypatch.setattr(Q, "_summed", lambda rows, *more: seen.append((rows.count(), inner(rows, *more))) or seen[-1][1])
    Q.fit(df, "t", m, 1)
    tokens, size = Q._padded([[2, 3], [3], []])
    times = np.array([5000, 3000, 1])
    logp, g = Q.log_probability(m, tokens, size, lambda x: -times.astype(float))
    rows, (n, loss, found) = seen[0]
    assert rows == 3 and n == 5000 * 3 + 3000 * 2 + 1
    assert abs(loss + times @ logp) < 1e-6 and np.abs(found - g).max() < 1e-6
    prior = Q.new(["a", "b"], 2, 3, 5)
    Q.policy_steps(df, "t", "s", m, prior, 3.0, 1)
    rows, (n, loss, _) = seen[1]
    assert rows == 5 and n == 8001
    gap = Q.log_probability(prior, tokens, size)[0] - logp
    assert abs(loss - sum((gap[k] + 3.0 * s) ** 2 * c for k, s, c in ((0, 0, 2500), (0, 0.5, 2500), (1, 0, 1500), (1, 0.5, 1500), (2, 0, 1)))) < 1e-5


def test_costly_rows_are_dealt_out(spark):
    from tessera.session import dealt, stash

    few = stash(spark.range(5000).coalesce(1), "few")
    assert dealt(few, 10_000).rdd.getNumPartitions() == 1
    parts = dealt(few, 1000).rdd.glom().map(len).collect()
    assert len(parts) == 5 and sum(parts) == 5000 and max(parts) < 1100
    assert dealt(few, 1000, "id").rdd.getNumPartitions() == 5


def test_binned_rows_are_dealt_out(spark, monkeypatch):
    df = spark.range(0, 3000, 1, 1).select((F.col("id") % 40).cast("double").alias("x"), (F.col("id") * 37 % 101).cast("double").alias("y"))
    settings = {"trees": 2, "depth": 2, "edges": [[10.0, 20.0, 30.0]]}
    whole = B.fit_boosted(df, ["x"], "y", {"q": B.pinball(0.3)}, **settings)
    files, inner = [], B.stash_evenly
    monkeypatch.setattr(B, "stash_evenly", lambda *a: files.append(inner(*a)) or files[-1])
    monkeypatch.setattr(B, "SHARE", 300)
    assert B.fit_boosted(df, ["x"], "y", {"q": B.pinball(0.3)}, **settings) == whole
    assert len(files[0].inputFiles()) == 10 and files[0].rdd.getNumPartitions() > 1
