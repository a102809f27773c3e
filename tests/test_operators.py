"""Edge cases on hand-made frames: missing values, ties, empty tables, degenerate groups."""

import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import formulas as M
from tessera.functions import text as R
from tessera.operators import aggregates as A
from tessera.operators import gates as G
from tessera.operators import joins as J
from tessera.operators import models as ML
from tessera.operators import pareto as P
from tessera.operators import quantiles as EQ
from tessera.operators import selection as T
from tessera.operators import similarity as S
from tessera.operators import windows as W

c = F.col


def test_missing_fails_gates(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, float("nan")), (4, 20.0)], "k int, v double").withColumn("v", G.no_nan("v"))
    out = {r.k: r.is_valid for r in G.gate(df, [("v", ">=", 6.0)]).collect()}
    assert out == {1: 0, 2: 0, 3: 0, 4: 1}


def test_optional_column(spark):
    df = spark.createDataFrame([(1, 5.0)], "k int, v double")
    assert G.gate(df, [("v", "<=", 6.0), ("dc", "<=", 2.0)], optional={"dc"}).first().is_valid == 1


def test_prune_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 2.0, None), (3.0, 2.0, 1.0)], "a double, b double, x double")
    assert G.prune_columns(df, ["a", "b", "x"]) == ["a"]


def test_zone_missing_is_red(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.5,), (9.0,)], "v double")
    assert [r[0] for r in df.select(G.zone(c("v"), 2.0, 3.0)).collect()] == ["red", "green", "amber", "red"]


def test_keep_best_is_idempotent_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, 5.0, 2), (1, 5.0, 1), (2, None, 3)], "k int, v double, i int")
    order = [c("v").desc(), c("i")]
    once = T.keep_best(df, ["k"], order)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, T.keep_best(once, ["k"], order).collect()), key=str) == [(1, 5.0, 1), (2, None, 3)]


def test_stratified_takes_one_at_least(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(50)], "k int, g string")
    got = {r.g: r.n for r in T.stratified(df, ["g"], "k", 0.1).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 4, "b": 1}


@pytest.mark.parametrize("n", [1, 2, 3, 20, 5000])
def test_tournaments(spark, monkeypatch, n):
    """Exactly so many winners, and the best row wins as often as it is drawn."""
    monkeypatch.setattr(T, "PARTS", 3)
    df = spark.createDataFrame([(i, float(i * 7919 % 100003)) for i in range(n)], "k int, f double")
    out = T.tournaments(df, "k", [c("f").desc()], 200, 3).collect()
    assert sorted(r.tournament for r in out) == list(range(200))
    if n <= 3:
        assert {r.f for r in out} == {max(i * 7919 % 100003 for i in range(n))}
    if n == 20:
        ranks = [sum(r.f < i * 7919 % 100003 for i in range(n)) for r in out]
        for best in (0, 1, 2):  # P(winner is the best left) by the hypergeometric distribution
            p = math.comb(19 - best, 2) / math.comb(20, 3)
            assert abs(ranks.count(best) - 200 * p) < 4 * math.sqrt(200 * p * (1 - p)), best


def test_tournaments_draw_from_all_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "k int")
    assert {r.k for r in T.tournaments(df, "k", [c("k")], 400, 1).collect()} == set(range(50))
    assert T.tournaments(df.limit(0), "k", [c("k")], 5, 2).count() == 0
    numbers = sorted(r.n for r in T.row_numbers(df.union(df), "k", 1, "n").collect())
    assert numbers == list(range(100))


@pytest.mark.parametrize("heavy", [2, 4096])
def test_draws_with_replacement_are_exactly_n(spark, monkeypatch, heavy):
    """One row has half of the weight; with few heavy rows the others go by slices."""
    monkeypatch.setattr(T, "PARTS", 4)
    df = spark.createDataFrame([(i, 1.0 if i else 2500.0, "x") for i in range(2501)] + [(-1, None, "x"), (-2, -3.0, "x"), (None, 5.0, "x")], "k int, w double, copies_ string").repartition(4)
    rows = T.multinomial(df, "k", 5000, 3, c("w"), heavy).collect()
    assert sum(r.copies for r in rows) == 5000 and len({r.k for r in rows}) == len(rows)
    own = {r.k: r.copies for r in rows}
    assert abs(own[0] - 2500) < 4 * 36 and not {-1, -2} & set(own)
    spread = [own.get(i, 0) for i in range(1, 2501)]
    assert abs(sum(x * (x - 1) for x in spread) / len(spread) - 1) < 0.2  # as a Poisson number of mean 1
    assert T.multinomial(df, "k", 0).count() == 0 and T.multinomial(df.limit(0), "k", 9).count() == 0
    one = T.multinomial(df.where("k = 5"), "k", 5000).collect()
    assert [(r.k, r.copies) for r in one] == [(5, 5000)]


def test_replay_buffer(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(40)], "k int, g int, v double")
    assert [r.k for r in T.replay_buffer(df, "g", [c("v").desc()], 3, 4).collect()] == [39, 38, 37, 36]


def test_bracket(spark):
    rows = [("direct", 298.0, 4.0), ("near", 290.0, 1.0), ("near", 310.0, 3.0), ("far", 200.0, 1.0), ("far", 310.0, 2.0), ("one", 290.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, t double, e double")
    got = {r.k: (r.method, r.value) for r in J.bracket(df, ["k"], "t", "e", 298.0, 30.0).collect()}
    assert got["direct"] == ("direct", 4.0) and got["near"][0] == "interpolated" and math.isclose(got["near"][1], 1.8)
    assert got["far"] == ("none", None) and got["one"] == ("none", None)


def test_interpolate_clamps(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(J.interpolate(c("x"), [(1.0, 10.0), (2.0, 20.0)])).collect()] == [10.0, 15.0, 20.0, None]


def test_grid_without_survivors(spark):
    df = spark.createDataFrame([(1.0, 1.0, 3)], "a double, b double, v int")
    out = {(r.a_min, r.b_max): (r.n, r.best) for r in J.threshold_grid(df, "a", [0.0, 5.0], "b", [2.0], "v").collect()}
    assert out == {(0.0, 2.0): (1, 3), (5.0, 2.0): (0, None)}


def _quantile_bins(values, q):
    edges = sorted(set(np.quantile(values, np.linspace(0, 1, q + 1))))
    return [max(sum(e < v for e in edges) - 1, 0) for v in values]


def test_qcut_ties(spark):
    values = [1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 4.0, 9.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    assert [r.bin for r in W.qcut(df, "v", 4).orderBy("i").collect()] == _quantile_bins(values, 4)


def test_cut_constant_and_edges(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)], "i int, v double")
    assert [r.bin for r in W.cut(df, "v", 5).orderBy("i").collect()] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert {r.bin for r in W.cut(df.withColumn("v", F.lit(2.0)), "v", 5).collect()} == {0}


def test_fills(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, None), (2, 1, None)], "g int, t int, v double")
    assert [r.f for r in W.fill_both(df, ["g"], ["t"], "v", "f").orderBy("g", "t").collect()] == [5.0, 5.0, 5.0, None]


def test_running_total_matches(spark):
    r = random.Random(3)
    rows = [(float(x), r.randint(0, 9)) for x in r.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "x double, n int")
    got = {q.x: q.s for q in W.running_total(df, "x", {"n": "s"}).collect()}
    total = 0
    for x, n in sorted(rows):
        total += n
        assert got[x] == total
    assert W.running_total(df.where("x < 0"), "x", {"n": "s"}).count() == 0


def test_crowding_small_fronts(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 3, 1.0), (1, 4, 2.0), (1, 5, 4.0)], "f int, k int, x double")
    got = {r.k: r.crowding for r in W.crowding(df, ["f"], ["x"], "k").collect()}
    assert got[1] == got[2] == got[3] == got[5] == 1e308 and got[4] == 1.0


def _front(points):
    return {i for i, p in enumerate(points) if not any(q[0] >= p[0] and q[1] >= p[1] and q != p for q in points)}


@settings(max_examples=5, deadline=None)
@given(points=st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=0, max_size=25))
def test_skylines_match_definition(spark, points):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "k long, x double, y double")
    want = _front(points)
    assert {r.k for r in P.skyline2(df, "x", "y").select("k").collect()} == want
    assert {r.k for r in P.skyline(df, ["x", "y"]).select("k").collect()} == want


def test_front_ranks_cover(spark):
    df = spark.createDataFrame([(i, float(i % 3), float(-i)) for i in range(6)], "k long, x double, y double")
    ranked = P.front_ranks(df, ["x", "y"], "k")
    assert ranked.count() == 6
    assert P.survivors(df, ["x", "y"], "k", 3).count() == 3


def test_hypervolume_grows(spark):
    pts = [("a", 1.0, 3.0), ("a", 2.0, 2.0)]
    hv = lambda rows: W.hypervolume(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y", (0.0, 0.0)).first().hypervolume
    assert hv(pts) == 5.0 and hv(pts + [("a", 3.0, 1.0)]) == 6.0 and hv(pts + [("a", 1.0, 1.0)]) == 5.0


def test_median_and_conformal(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.2), ("b", 1.0), ("b", 9.0), ("x", 3.0)], "g string, v double")
    assert {r.g: r["median"] for r in A.median_if_steady(df, ["g"], "v", 0.5).collect()} == {"a": 1.1, "x": 3.0}
    r = list(np.random.default_rng(0).normal(size=37))
    q = A.conformal_quantile(spark.createDataFrame([("g", float(x)) for x in r], "g string, r double"), ["g"], c("r"), 0.1).first().q
    assert math.isclose(q, np.quantile(np.abs(r), min(0.9 * 38 / 37, 1)), rel_tol=1e-9)


def test_minmax_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (float("inf"), None)], "a double, b double")
    got = [(r.a_scaled, r.b_scaled) for r in A.minmax(df, {"a": False, "b": False}).collect()]
    assert got == [(0.0, 0.5), (1.0, 0.5), (0.0, 0.0)]


def test_price_penalty(spark):
    df = spark.createDataFrame([(2.9,), (3.0,), (4.5,), (6.0,), (None,), (float("nan"),)], "p double")
    got = [r[0] for r in df.select(M.cosine_penalty(c("p"), 3.0, 6.0)).collect()]
    assert got[0] == got[1] == got[4] == got[5] == 1.0 and got[3] == 0.0 and math.isclose(got[2], 0.5)
    assert df.select(M.cosine_penalty(c("p"), 6.0, 3.0).alias("x")).agg(F.min("x")).first()[0] == 1.0


def test_viscosity_undefined(spark):
    df = spark.createDataFrame([(10.0, 3.0), (-1.0, 3.0), (0.1, 0.05), (3.0, 10.0)], "a double, b double")
    got = [r[0] for r in df.select(M.viscosity_index(c("a"), c("b"))).collect()]
    assert got[0] is not None and got[1:] == [None, None, None]


def test_quadratic_fit(spark):
    x = np.arange(8.0)
    y = 2 - 0.5 * x + 0.25 * x**2
    row = spark.createDataFrame([(8, *(float((x**k).sum()) for k in (1, 2, 3, 4)), *(float((x**k * y).sum()) for k in (0, 1, 2)))], "n int, a double, b double, c double, d double, e double, f double, g double")
    got = row.select(*M.quadratic_fit(c("n"), [c(k) for k in "abcd"], [c(k) for k in "efg"])).first()
    assert np.allclose(list(got), [2, -0.5, 0.25])


def test_folds_are_stable(spark):
    import hashlib

    keys = ["CCO", "c1ccccc1", "", "é"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(R.md5_fold(c("k"), 5)).collect()]
    assert got == [int(hashlib.md5(k.encode()).hexdigest(), 16) % 5 for k in keys]


def test_text_functions(spark):
    df = spark.createDataFrame([("C(C)C1CC1",), ("C(C",), ("C)(",), ("C.C",)], "s string")
    assert [r[0] for r in df.select(R.balanced(c("s"))).collect()] == [True, False, False, True]
    assert [r[0] for r in df.select(R.fragments(c("s"))).collect()] == [1, 1, 1, 2]
    assert df.limit(1).select(R.encode(c("s"), {"C": 1}, 0)).first()[0][:3] == [1, 0, 1]
    v = spark.createDataFrame([(" cis-α-pinene (x) ",)], "n string").select(R.name_variants(c("n"))).first()[0]
    assert "alpha-pinene" in v


def test_ngram_generator_learns_from_every_row(spark, tmp_path):
    from tessera.plans import catalogue

    spark.createDataFrame([(k, "zq" if k >= 20 else "zab") for k in range(400)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r.text for r in catalogue.queries()["ngram_generator"](spark, str(tmp_path)).collect()]
    assert len(got) == 100 and got.count("zq") > 80 and set(got) <= {"zq", "zab"}


def test_generated_by_joins(spark):
    texts = spark.createDataFrame([("^^^abab$",), ("^^^abba$",), ("^^^bé$",), ("^^^cdcdcd",), (None,)], "text string")
    counts, seeds = R.ngrams(texts, "text", 3), spark.range(40).withColumnRenamed("id", "seed")
    held, joined = ({r.seed: r.text for r in R.generate_from(counts, seeds, 3, 5, "^^^", "$", most=m).collect()} for m in (1000, 1))
    assert held == joined and len(held) == 40 and len(set(held.values())) > 2


def test_ledoit_wolf_against_numpy():
    x = np.random.default_rng(1).normal(size=(40, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0], [0, 0, 3.0]])
    x = x - x.mean(0)
    cov = x.T @ x / len(x)
    shrunk, s = ML.ledoit_wolf(len(x), cov, float((np.sum(x**2, 1) ** 2).mean()))
    mu = np.trace(cov) / 3
    d2 = np.sum((cov - mu * np.eye(3)) ** 2) / 3
    b2 = min(np.mean([np.sum((np.outer(r, r) - cov) ** 2) for r in x]) / 3 / len(x), d2)
    assert math.isclose(s, b2 / d2, rel_tol=1e-9) and np.allclose(shrunk, (1 - s) * cov + s * mu * np.eye(3))


def test_similarity(spark):
    df = spark.createDataFrame([(1, 0b111), (2, 0b011), (3, 0), (4, 0b111)], "k long, w long")
    got = {r.k: r.mean_similarity for r in S.mean_tanimoto(df, "k", "w").collect()}
    assert math.isclose(got[1], (2 / 3 + 0 + 1) / 3) and got[3] == 0
    cl = {r.k: r.cluster for r in S.leaders(df.withColumn("g", F.lit(0)), "g", "k", "w", "k", 0.6).collect()}
    assert cl == {1: 0, 2: 0, 3: 1, 4: 0}
    words = df.withColumn("w", F.when(F.col("k") == 3, F.lit(-1).cast("long")).otherwise(F.col("w")))
    best = {r.k: r.best_similarity for r in S.against(words.where("k > 1"), words, "k", "w").collect()}
    assert best == {2: pytest.approx(2 / 3), 3: pytest.approx(3 / 64), 4: 1.0}
    assert S.sign_word(F.array(*[F.lit(1.0)] * 64)) is not None
    row = spark.range(1).select(S.sign_word(F.array(*[F.lit(1.0)] * 64)).alias("a"), S.sign_word(F.array(F.lit(1.0), F.lit(-1.0))).alias("b")).first()
    assert row.a == -1 and row.b == -(1 << 63)


def test_leaders_in_rounds(spark):
    r = random.Random(2)
    rows = [(k % 2, k, r.getrandbits(12) | (r.getrandbits(1) << 63)) for k in range(60)]
    rows = [(g, k, w - (1 << 64) if w >= 1 << 63 else w) for g, k, w in rows]
    df = spark.createDataFrame(rows, "g long, k long, w long")
    whole, parts = ({(x.g, x.k): x.cluster for x in S.leaders(df, "g", "k", "w", "k", 0.5, head=h).collect()} for h in (100, 4))
    assert whole == parts and len(whole) == 60


def test_nearest_against_all_pairs(spark):
    r = np.random.default_rng(4)
    v = r.integers(-2, 3, (90, 3)).astype(float)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "k long, v array<double>")
    got = {(x.k, x.rank): (x.neighbour, round(x.distance, 9)) for x in S.nearest(df, "k", "v", 4).collect()}
    for k in range(90):
        d = np.sqrt(((v - v[k]) ** 2).sum(1))
        want = [(int(j), round(float(d[j]), 9)) for j in np.lexsort((np.arange(90), d)) if j != k][:4]
        assert [got[k, n + 1] for n in range(4)] == want


@settings(max_examples=6, deadline=None)
@given(values=st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, float("inf")])), max_size=40))
def test_exact_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([("a" if i % 3 else None, v) for i, v in enumerate(values)], "g string, v double")
    for keys in ([], ["g"]):
        got = {tuple(r[k] for k in keys): r for r in EQ.exact_quantiles(df, keys, F.col("v"), EQ.linear_spots([0, 0.3, 0.5, 1])).collect()}
        groups = {}
        for i, v in enumerate(values):
            if v is not None:
                groups.setdefault(("a" if i % 3 else None,) if keys else (), []).append(v)
        assert set(got) == set(groups)
        for k, held in groups.items():
            assert got[k].n == len(held)
            if all(map(math.isfinite, held)):
                assert np.allclose(got[k].quantiles, np.quantile(held, [0, 0.3, 0.5, 1]), rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("cell, values", [(1000, 30), (10, 30), (10, 6), (40, 1000)])
def test_all_fronts_as_by_peeling(spark, cell, values):
    """Also where ties fall on the edges of cells, and where few points make many fronts."""
    r = random.Random(cell + values)
    rows = [(k, float(r.randint(0, values)), float(r.randint(0, values))) for k in range(160)] + [(999, None, 1.0), (998, float("nan"), 1.0)]
    if values == 1000:
        rows = [(k, float(k + r.randint(0, 3)), float(k + r.randint(0, 3))) for k in range(160)]
    left = {(x, y) for _, x, y in rows if x is not None and x == x}
    want, n = {}, 0
    while left:
        front = {p for p in left if not any(q != p and q[0] >= p[0] and q[1] >= p[1] for q in left)}
        want |= {p: n for p in front}
        left -= front
        n += 1
    got = P.all_fronts(spark.createDataFrame(rows, "k int, x double, y double"), "x", "y", cell).collect()
    assert len(got) == sum(x is not None and x == x for _, x, _ in rows)
    assert all(want[g.x, g.y] == g.front for g in got)
    if values == 1000:
        assert n > 60


@pytest.mark.parametrize("few", [300, 40])
def test_quantiles_of_heavy_tails(spark, monkeypatch, few):
    """Groups over the bound: a far outlier, one value that comes very often, infinities; what is ordered at last is few rows."""
    monkeypatch.setattr(EQ, "FEW", few)
    groups = {"tail": [float(k) for k in range(1, 5001)] + [1e300], "often": [7.0] * 900 + [float(k) for k in range(300)], "small": [3.0, 1.0], None: [math.inf, -math.inf] * 60 + [float(k) for k in range(800)]}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double").repartition(4)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999]
    located, seen = EQ._located, []
    monkeypatch.setattr(EQ, "_located", lambda rows, wanted: seen.append(rows.groupBy("_key").agg(F.countDistinct("_v").alias("d")).agg(F.max("d")).first()[0]) or located(rows, wanted))
    got = {r.g: r for r in EQ.exact_quantiles(df, ["g"], F.col("v"), EQ.linear_spots(shares)).collect()}
    assert set(got) == set(groups) and seen[0] <= 300
    for g, values in groups.items():
        assert got[g].n == len(values)
        ordered = sorted(values)
        for q, s in zip(got[g].quantiles, shares):
            a = (len(ordered) - 1) * s
            low, high = ordered[math.floor(a)], ordered[math.ceil(a)]
            assert q == low or abs(q - (low + (high - low) * (a - math.floor(a)))) <= 1e-9 * max(1, abs(low), abs(high)), (g, s, q)


def test_running_total_of_heavy_tails(spark):
    from tessera.operators import windows as W

    values = [float(k) for k in range(1, 3000)] + [1e300, -1e300]
    df = spark.createDataFrame([(v, k % 7) for k, v in enumerate(values)], "v double, n int").repartition(4)
    got = {r.v: r.t for r in W.running_total(df, "v", {"n": "t"}).collect()}
    total, want = 0, {}
    for v, n in sorted((v, k % 7) for k, v in enumerate(values)):
        want[v] = total = total + n
    assert got == want
    edges = [1.0, 2.0, 2.5, 9.0]
    rows = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.0, 2.2, 2.5, 3.0, 9.0, 99.0)], "v double").select(EQ.slice_of(F.col("v"), edges).alias("s")).collect()
    assert [r.s for r in rows] == [0, 0, 1, 1, 2, 2, 3, 3, 4]


def test_stratified_with_hot_stratum(spark):
    df = spark.range(400).withColumn("s", F.when(F.col("id") < 390, "hot").otherwise(F.col("id").cast("string")))
    got = T.stratified(df, ["s"], "id", 0.1, 5)
    sizes = {r.s: r["count"] for r in got.groupBy("s").count().collect()}
    assert sizes.pop("hot") == 39 and set(sizes.values()) == {1} and len(sizes) == 10
    assert got.columns == df.columns


def test_skyline_in_blocks(spark):
    r = random.Random(7)
    points = [(i, float(r.randint(0, 30)), float(r.randint(0, 30)), float(r.randint(0, 30))) for i in range(150)]
    df = spark.createDataFrame(points, "k long, x double, y double, z double")
    want = {p[0] for p in points if not any(all(a >= b for a, b in zip(q[1:], p[1:])) and q[1:] != p[1:] for q in points)}
    assert {x.k for x in P.skyline(df, ["x", "y", "z"], block=5).collect()} == want
    plan = P.skyline(df, ["x", "y", "z"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("rows", [[], [(1, 2.0)]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "k long, v double")
    assert P.skyline2(df, "v", "v").count() == len(rows)
    assert T.top_k(df, [c("v")], 3).count() == len(rows)
    assert W.cut(df, "v", 4).count() == len(rows)


def test_model_selection(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 3))
    rows = [(i, float(a), float(a) * 2.0 + 0.001 * i, float(b), 1.0, float(3 * a - 2 * b + 0.1 * e)) for i, (a, b, e) in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, a double, a2 double, b double, same double, y double").cache()
    kept = ML.select_features(df, ["a", "a2", "b", "same"], "y")
    assert "b" in kept and len({"a", "a2"} & set(kept)) == 1 and "same" not in kept
    curve = ML.eliminate(df, ["a", "b"], "y", R.md5_fold(c("k"), 3))
    assert [n for n, *_ in curve] == [2, 1] and curve[0][1] < curve[1][1]
    assert len(ML.random_search(df, ["a", "b"], "y", R.md5_fold(c("k"), 3), 2)) == 2
    model = ML._gbt().fit(ML._assembled(df, ["a", "b"], "y"))
    assert ML.permutation_importance(model, df, ["a", "b"], "y", "k")[0][0] == "a"
    assert ML.embed(df.withColumn("v", F.array("a", "b")), "v").first().embedding_low is not None
    assert ML.out_of_domain_curve(df.withColumn("p", c("y") + c("a")), "a", "y", "p").count() == 10


def test_words_meet_in_small_blocks():
    r = np.random.default_rng(3)
    a, b = (np.concatenate([[0, -1], r.integers(-(1 << 63), 1 << 63, n, dtype=np.int64)]) for n in (1500, 5000))
    out, cells = np.full((len(a), len(b)), -1.0), 0
    for rows, others, sim in S._blocks(a, b):
        out[rows, others] = sim
        cells = max(cells, sim.size)
    assert cells <= S.STEP * S.BLOCK < 1 << 20  # a tile of any length costs no more
    both, either = (np.bitwise_count(f(a[:, None], b[None, :]).view(np.uint64)).astype(float) for f in (np.bitwise_and, np.bitwise_or))
    assert (out == np.divide(both, either, out=np.zeros_like(both), where=either > 0)).all()
    assert not list(S._blocks(a, b[:0])) and not list(S._blocks(a[:0], b))


def test_predictions_are_grouped_in_bounded_tasks(spark, monkeypatch):
    from tessera.plans import studies

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    monkeypatch.setattr(studies, "_SHARE", 20)
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    for q in (studies.consensus_gates, studies.two_level_pivot):
        parts = q(spark, sf).rdd.glom().map(len).collect()
        assert sum(parts) == n and len(parts) == -(-n // 20) and max(parts) <= 60
